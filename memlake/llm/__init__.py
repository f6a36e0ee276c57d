"""Corpus preparation operators: classifiers, deduplication, mixing, encoding, extraction.

Nothing else in the library imports this subpackage; it imports only Spark,
numpy and the public tokenizer libraries.
"""
