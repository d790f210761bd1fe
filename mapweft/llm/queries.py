"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from mapweft.llm import q_native, q_near, q_search, q_text

QUERIES = {**q_native.QUERIES, **q_near.QUERIES, **q_text.QUERIES, **q_search.QUERIES}
ORACLES = {**q_native.ORACLES, **q_search.ORACLES}
