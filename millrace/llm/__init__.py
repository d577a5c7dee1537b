"""Operators for training data: top-N groups, abuse scores, packing, mixing, splitting.

Nothing outside this subpackage imports it.
"""
