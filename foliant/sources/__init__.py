"""Scans of page text, evidence dumps and recogniser output, and sinks for documents."""

from . import evidence, integrity, pages, recogniser, render

__all__ = ["evidence", "integrity", "pages", "recogniser", "render"]
