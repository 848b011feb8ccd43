"""Operators for training-data pipelines. Nothing else in the package imports this one.

Operators take a DataFrame and column names, read only those columns (so extra columns
cannot clash), and return a DataFrame. Text work runs in ``mapInArrow``: Arrow batches are cut
into slices of bounded bytes, words are split and dictionary-encoded in C++, and Python handles
each distinct word once.
"""
