"""Operators for building training data out of large document tables.

Nothing outside this subpackage imports it.
"""
