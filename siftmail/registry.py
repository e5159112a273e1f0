"""All queries of the library's own operators and their SQL."""

import importlib

MODULES: tuple[str, ...] = ("urls", "events", "texts", "decoders", "mailbox", "mailfiles")


def _merged(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"siftmail.plans.{m}"), name)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("SQL")
