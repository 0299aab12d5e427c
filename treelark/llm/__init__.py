"""Operators that large training-data pipelines need, beside the retrieval engine.

Nothing outside this subpackage imports it.
"""
