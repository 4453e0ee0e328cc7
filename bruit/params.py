"""Parameters of the event engine, with the defaults of its configuration."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    west: float = -130.0
    east: float = -65.0
    south: float = 20.0
    north: float = 55.0
    cell: float = 0.2
    radius: float = 1.0
    epsilon: float = 0.2
    min_points: int = 3
    reach_min: float = 0.0
    reach_max: float = 0.45
    min_size: int = 4
    min_users: int = 2
    recall_seconds: int = 7 * 86400
    history_seconds: int = 86400
    period_seconds: int = 3600
    temporal_share: float = 0.1
    spatial_share: float = 0.1
    temporal_deviations: float = 1.0
    spatial_deviations: float = 3.0
    locked: int = 3
    #: Seeds meet every message; more than this many would make that a large product.
    max_seeds: int = 10_000
    #: Rows of a block are at most 2 to the power of this; pivots bound the angles of vectors.
    block_bits: int = 11
    pivots: int = 8

    @property
    def reach_cells(self) -> int:
        """Chebyshev distance in cells within which messages may be neighbours."""
        return math.ceil(self.radius / self.cell - 1e-9)
