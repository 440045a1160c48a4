"""Operators for training-data pipelines, with their queries and SQL."""

from importlib import import_module

MODULES = ("sharding", "licenses", "media", "toxicity", "sentencepiece_bpe", "quality", "mixing", "simhash", "tokens", "chat", "spelling", "lexical", "setsketch")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f".{m}", __name__).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in import_module(f".{m}", __name__).ORACLES.items()}
