"""Operators for building language-model training corpora.

Nothing outside this subpackage imports it; ``queries.py`` holds the thin
registered queries, the other modules hold one operator each.
"""
