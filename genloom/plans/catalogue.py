"""All queries of the library outside the optional subpackage."""

from __future__ import annotations

from genloom.plans import algorithms, discovery, formats, relational, structures

QUERIES: dict = {}
ORACLES: dict = {}
for _m in (discovery, relational, structures, formats, algorithms):
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
