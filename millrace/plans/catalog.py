"""All queries of the core package and their SQL."""

from millrace.plans import problems, workloads

QUERIES = {**workloads.QUERIES, **problems.QUERIES}
ORACLE = {**workloads.ORACLE, **problems.ORACLE}
