"""Registered queries over the driver's tables, with their SQL."""

from newsloom.plans import audience, books, corpus, desk, health, texts

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _part in (audience, books, health, texts, corpus, desk):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
FLAGSHIP = "feed_v2"
