"""Operators for the preparation of training data.

Each module is one operator with its own general interface; ``queries``
registers the thin queries.  Nothing outside this folder imports it.
"""
