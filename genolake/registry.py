"""The registered queries and the SQL that another engine runs for the same rows."""

from __future__ import annotations

from .plans import compare, files, fit, formats, generate, reads, realism, segments

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _plan in (compare, segments, fit, realism, generate, formats, files, reads):
    QUERIES |= _plan.QUERIES
    ORACLES |= _plan.ORACLES
