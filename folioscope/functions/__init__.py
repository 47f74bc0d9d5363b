"""Functions of the document search engine."""
