"""Operators for preparing language-model training data at scale.

Every module holds one operator with a general interface; ``queries`` holds the
thin registered queries that shape the operators' results.
"""
