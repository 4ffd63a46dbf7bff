"""All registered queries of the library's own operators and the SQL that they are checked against."""

from . import binary, bounds, bundles, cascades, causality, codes, dense, files, more, nets, numeric, palettes, search, shapes, streams  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
