"""Training-data operators on corpora of documents, pages and vectors.

Nothing outside this subpackage imports it.
"""
