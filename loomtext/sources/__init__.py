"""Readers and writers of corpora, pages and saved indexes."""
