"""All registered queries and their oracles, in the order of the operator inventory."""

from importlib import import_module

SECTIONS = ["ingest", "predicates", "joins", "aggregates", "ordering", "merge", "enrich", "classify", "search",
            "safety", "evaluate", "monitor"]


def _merged(attribute: str) -> dict:
    out = {}
    for section in SECTIONS:
        out.update(getattr(import_module(f"marquee.plans.{section}"), attribute))
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracles() -> dict:
    return _merged("ORACLES")
