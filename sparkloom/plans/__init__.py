"""Queries: operators bound to the driver's tables. Importing this package registers them all."""

from . import curation, files, resuming, scoring, sequences, texts  # noqa: F401
from .registry import ORACLES, QUERIES, Tables, query  # noqa: F401
