"""Operations for large training-data pipelines, each a DataFrame function.

``QUERIES`` and ``ORACLES`` map registered query names to callables and to
DuckDB SQL.  Nothing outside this subpackage imports it.
"""

from bruit.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
