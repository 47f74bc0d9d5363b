"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; ``registry`` holds its
queries. Executors need the package on their path (``--py-files`` or installed).
"""
