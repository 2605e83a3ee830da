"""Registered queries: operators over views of the given tables, each with its SQL."""

from __future__ import annotations

from .registry import ORACLES, QUERIES


def load() -> tuple[dict, dict]:
    from . import catalog_queries, governance_queries, matching_queries, model_queries, text_queries  # noqa: F401

    return dict(QUERIES), dict(ORACLES)
