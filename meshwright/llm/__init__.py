"""Operators for preparing training data at scale.

Every module holds one operator with a general interface, plus the thin query
that applies it to the synthetic tables.  Nothing outside this package imports it.
"""
