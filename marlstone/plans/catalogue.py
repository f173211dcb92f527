"""All registered queries of the analytics side, each with the SQL that must give the same rows."""

from __future__ import annotations

from . import detection, files, quality, scenes

_PARTS = (quality, detection, scenes, files)
FLAGSHIP = "q_map"
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
