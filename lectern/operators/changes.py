"""What changed between two listings of files (path, modified, size)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(before: DataFrame, after: DataFrame, key: str = "path", signature: tuple[str, ...] = ("modified", "size")) -> DataFrame:
    """(path, change): 'new', 'modified' or 'deleted'.  Paths are unique within a listing; repeated rows of one collapse."""
    b = before.groupBy(F.col(key).alias("path")).agg(F.max(F.struct(*signature)).alias("b"))
    a = after.groupBy(F.col(key).alias("path")).agg(F.max(F.struct(*signature)).alias("a"))
    change = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "deleted").when(~F.col("a").eqNullSafe(F.col("b")), "modified")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change is not null")


def signature(listing: DataFrame, key: str = "path", columns: tuple[str, ...] = ("modified", "size")) -> str:
    """One string for a listing, whatever its order: equal listings have equal signatures."""
    h = F.xxhash64(key, *columns)
    r = listing.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x"), F.coalesce(F.sum(F.shiftright(h, 16)), F.lit(0)).alias("s")).first()
    return f"{r['n']}-{r['x']}-{r['s']}"


def is_stale(saved: str, listing: DataFrame) -> bool:
    return signature(listing) != saved
