"""One row per tile, joined to the many points or cells of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import settled

#: So many rows of one tile each are broadcast; a row is some tens of bytes.
BROADCAST_TILES = 100_000
#: Beyond that, a tile's points or cells are dealt to so many tasks.
SALTS = 64


def with_tiles(df: DataFrame, tiles: DataFrame, computed: bool = False) -> DataFrame:
    """df with the columns of its tile's row. The rows are computed once (unless they are already) and counted: a bounded number is
    broadcast, so that points aren't shuffled by a few hot tiles; more are copied to salts, which cut the hot ones."""
    tiles = tiles if computed else settled(tiles)
    if tiles.limit(BROADCAST_TILES + 1).count() <= BROADCAST_TILES:
        return df.join(F.broadcast(tiles), "tile")
    copies = tiles.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int")).join(copies, ["tile", "_salt"]).drop("_salt")
