"""Readers and writers for corpora, vocabularies and embedding tables."""
