"""A broadcast bitmap of fixed size that spares shuffle before an exact join.

It has ``2**BITS`` bits whatever the number of keys; a key that is not in it
has no partner, a key that is in it still goes through the join.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 24


def bitmap(keys: DataFrame, column: str) -> Broadcast:
    """Bitmap of a bigint column; at most ``2**(BITS-6)`` cells reach the driver."""
    slot = f"({column} & {(1 << BITS) - 1})"
    cells = (keys.select(F.expr(f"shiftright({slot}, 6)").alias("cell"),
                         F.expr(f"shiftleft(1L, cast({slot} & 63 as int))").alias("bit"))
             .groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow())
    table = np.zeros(1 << (BITS - 6), dtype=np.int64)
    table[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy()
    return keys.sparkSession.sparkContext.broadcast(table.view(np.uint64))


def listed(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which uint64 keys may be in the bitmap."""
    slot = keys & np.uint64((1 << BITS) - 1)
    return (table[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) != 0
