"""Operators that prepare text and vectors for training corpora.

Nothing outside this subpackage imports it; it may be removed as a whole.
"""
