"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it. Every operator takes and returns
DataFrames; Python code runs inside Arrow tasks over bounded chunks of rows.
"""
