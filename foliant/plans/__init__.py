"""Whole queries over the given tables; importing this registers them all."""

from . import assembly, critical, documents, evidence, frames, geometry, layout, metrics, readings, report, roles, sources, streams, tables, text
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "assembly", "critical", "documents", "evidence", "frames", "geometry", "layout", "metrics", "readings", "report", "roles", "sources", "streams", "tables", "text"]
