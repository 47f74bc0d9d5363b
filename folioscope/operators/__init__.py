"""Operators of the document search engine."""
