"""Plans of the document search engine."""
