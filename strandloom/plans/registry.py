"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from strandloom.plans import events, further, matrices, more, sequences, tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for family in (tables, matrices, sequences, events, more, further):
    QUERIES |= family.R.queries
    ORACLES |= family.R.oracles
