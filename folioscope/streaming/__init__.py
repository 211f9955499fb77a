"""Continuous forms of the batch operators."""
