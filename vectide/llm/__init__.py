"""Training-data operators: deduplication, tokenisation, scoring, filtering.

Nothing outside this folder imports it.  Every operator takes and returns
DataFrames; `queries.py` holds the thin registered queries.
"""
