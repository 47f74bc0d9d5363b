"""Sources of the document search engine."""
