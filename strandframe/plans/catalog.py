"""Named queries over the driver's tables, and the SQL they are held against."""

from __future__ import annotations

from . import graphs, intervals, library, sequences

QUERIES = {**sequences.QUERIES, **intervals.QUERIES, **graphs.QUERIES, **library.QUERIES}
ORACLES: dict[str, str] = {**sequences.ORACLES, **intervals.ORACLES, **graphs.ORACLES, **library.ORACLES}
