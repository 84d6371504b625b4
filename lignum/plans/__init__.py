"""Registered query plans over the shared tables."""

from lignum.plans import curation, doc_trees, files, probe, results, training, vocab_vectors  # noqa: F401
