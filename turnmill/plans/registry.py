"""Every query of the library with its DuckDB SQL, where SQL can express it."""

from __future__ import annotations

from turnmill.plans import changes, chat, docs, extra, graph, log, raw, raw_more
from turnmill.plans.base import ORACLE_SQL, QUERIES

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "changes", "chat", "docs", "extra", "graph", "log", "raw", "raw_more"]

FLAGSHIP = "t1_turn_token_profile"
