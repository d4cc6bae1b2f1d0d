"""Operators for building training corpora: near-duplicate joins, private data, secrets, scores, tokens and packing.

Nothing outside this subpackage imports it. Every operator takes and returns DataFrames.
"""
