"""Readers and writers for corpora, feature tables, models and reports."""
