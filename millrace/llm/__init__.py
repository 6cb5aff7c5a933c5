"""Operators for training-data corpora.

Each module holds one operator with a general interface; ``queries`` applies
them to the test tables and derives the digest columns that are compared.
Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""
