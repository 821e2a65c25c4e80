"""Operators for large training corpora, each a DataFrame-to-DataFrame function.

Nothing outside this subpackage imports it.
"""
