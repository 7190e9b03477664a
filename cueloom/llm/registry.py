"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from cueloom.llm import conversations, embeddings, language, media, minhash, mixing, negatives, packing, secrets, sharding, tokens, toxicity, warc

MODULES = (minhash, embeddings, packing, sharding, media, mixing, toxicity, secrets, warc, tokens, conversations, language, negatives)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
