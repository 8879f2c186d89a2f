"""Registered queries over the test tables, with their SQL."""

from . import campaigns, cases, datasets, metrics, projection, questions, retrieval, tables, verify, windows
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "campaigns", "cases", "datasets", "metrics", "projection", "questions", "retrieval", "tables", "verify", "windows"]
