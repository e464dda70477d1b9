"""Corpus operators for training-data pipelines (HTML, quality, WARC, dedup,
secrets, token counts, packing, vector search, SentencePiece).

Each module holds one operator with its own general interface; ``queries``
registers the thin ``opN_<name>`` queries and their oracle SQL.
"""
