"""All registered queries of the card library and their DuckDB twins."""

from __future__ import annotations

from cardloom.plans import accounts, cards, events, sources

QUERIES = cards.QUERIES | accounts.QUERIES | events.QUERIES | sources.QUERIES
ORACLES = cards.ORACLES | accounts.ORACLES | events.ORACLES | sources.ORACLES
