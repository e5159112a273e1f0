"""All queries of this subpackage and the SQL of those that SQL can express."""

import importlib

MODULES = ("chunked_bpe", "curve_packing", "hidden_markov", "host_rules", "lang_spans", "media", "merkle_manifest", "minmax_dedup", "repeat_dedup", "token_files", "toxic_lexicon", "unigram_count", "whitening")


def _merged(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.queries_{m}"), name)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("SQL")
