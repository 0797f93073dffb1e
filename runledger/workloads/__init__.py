"""Registered queries over the test tables, each with the SQL that must give the same rows."""

from . import (aggregates, corrections, endpoints, expressions, joins, logs, mutations, passes, plans, selections,  # noqa: F401
               sources, streams)
from .registry import ORACLES, QUERIES  # noqa: F401
