"""Operators over documents, postings, passages and rankings."""
