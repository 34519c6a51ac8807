"""Operators for training-data pipelines over document, page and label tables.

Nothing outside this package imports it. Every operator takes and returns DataFrames; numpy
and Arrow code runs inside tasks only, on batches Spark hands out.
"""
