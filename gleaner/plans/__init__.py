"""Queries over the tables of a folder."""

from . import announcements, deals, entities, ledger, records, text
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "deals", "entities", "ledger", "records", "text"]
