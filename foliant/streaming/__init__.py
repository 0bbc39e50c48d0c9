"""Streams of pages and of audit events."""

from . import events, pages

__all__ = ["events", "pages"]
