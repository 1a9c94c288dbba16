"""Corpus preparation operators for large text collections.

Each module holds one operator; ``queries`` registers them.  Nothing outside
this subpackage imports it.
"""
