"""Readers and writers of corpora, catalogs, results and predictions."""
