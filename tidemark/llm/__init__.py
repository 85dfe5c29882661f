"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
