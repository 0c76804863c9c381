"""Operators for building training corpora at scale.

Nothing outside this package imports it.  Each module holds one operator with a
general interface; ``queries`` derives the contract queries from them.
"""
