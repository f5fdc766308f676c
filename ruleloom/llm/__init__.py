"""Training-data operators: filtering, deduplication, encoding, packing and sharding of documents.

Nothing outside this subpackage imports it.  Each module holds one operator with a general
interface (a DataFrame in, a DataFrame out); ``queries`` holds the thin registered queries.
"""
