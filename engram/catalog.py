"""Every registered query of the organizational-memory operators, with its SQL oracle."""

from __future__ import annotations

from .plans import access, graph, integrate, joins, ledger, lists, passes, retrieval, streams, texts  # noqa: F401
from .plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "op_a4"
