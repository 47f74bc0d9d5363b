"""Streaming of the document search engine."""
