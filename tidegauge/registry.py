"""All queries outside the llm subpackage, with their SQL."""

from __future__ import annotations

from .plans import t1, t2, t3, t4

QUERIES: dict = {}
ORACLES: dict = {}
for _m in (t1, t2, t3, t4):
    QUERIES.update(_m.QUERIES)
    ORACLES.update(_m.ORACLES)
