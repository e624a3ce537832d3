"""Every query by name, with its SQL."""

from __future__ import annotations

from .oracles import ORACLES
from .queries import QUERIES, entry

__all__ = ["ORACLES", "QUERIES", "entry"]
