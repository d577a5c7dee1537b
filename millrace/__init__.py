"""millrace: a PySpark-native engine for page-view, social, dispatch and change-feed workloads.

Operators take DataFrames and return DataFrames; reading and writing live in
``millrace.sources``.  The optional subpackage ``millrace.llm`` holds the
training-data operators and is imported by nothing in the rest of the package.
"""
