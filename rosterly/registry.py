"""All queries over the reference tables and, where SQL can say the same, their SQL."""

from __future__ import annotations

from rosterly.plans import catalogue, puzzles, solving

QUERIES = {**solving.QUERIES, **puzzles.QUERIES, **catalogue.QUERIES}
SQL = {**solving.SQL, **puzzles.SQL, **catalogue.SQL}
