"""All market queries, by the name of their operator."""

from __future__ import annotations

from .queries import ORACLE_SQL, QUERIES, backtests, chains, feeds, indicators, ledger, market, models, research, strategies, texts, validation, vols  # noqa: F401  importing a module registers its queries
