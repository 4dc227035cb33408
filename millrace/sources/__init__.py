"""Scans, the record catalog and packed groups of files."""

from .tables import load, load_stream

__all__ = ["load", "load_stream"]
