"""Operators for large text collections: filtering, de-duplication, mixing, encoding.

Nothing outside this folder imports it.
"""
