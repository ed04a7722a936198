"""Training-data operators: scoring, deduplication, packing and formatting of text at corpus scale.

Nothing outside this subpackage imports it.  Every module has a general operator working on
DataFrames; ``entry`` binds the operators to the benchmark tables.
"""
