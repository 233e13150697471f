"""Corpus preparation operators for training data: detection, dedup, mixing and encoding.

Nothing outside this subpackage imports it; ``queries.py`` holds its registered queries.
"""
