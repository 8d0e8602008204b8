"""Loads every family of registered queries."""

from __future__ import annotations

from importlib import import_module

from poolcall.plans.registry import ORACLES, QUERIES

FAMILIES = ["genotype_calls", "label_reports", "tag_calls", "species_calls", "site_selection", "text_ingest", "pileups", "contamination", "pool_reports", "haplotypes", "scalars"]


def _load() -> None:
    for f in FAMILIES:
        import_module(f"poolcall.plans.{f}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracles() -> dict:
    _load()
    return dict(ORACLES)
