"""Registered queries and the DuckDB SQL they are checked against."""

from bruit.plans.oracles import ORACLES
from bruit.plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
