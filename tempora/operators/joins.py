"""As-of joins and interval masks without row-by-row matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.buckets import micros


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, tolerance_micros: int | None = None) -> DataFrame:
    """Each left row with the latest right row at or before its time, of equal keys (null equals null), within the tolerance.

    Both sides are united, and the last right row is carried along each key's time line: one shuffle
    on the keys. Right columns that clash are prefixed with ``right_``; right keys and time go.
    """
    if tolerance_micros is not None and tolerance_micros < 0:
        raise ValueError("the tolerance must not be negative")
    for k in keys:
        if k not in left.columns or k not in right.columns:
            raise ValueError(f"both sides need the key {k!r}")
    carried = [c for c in right.columns if c not in keys and c != right_time]
    named = {c: f"right_{c}" if c in left.columns else c for c in carried}
    left_row = F.struct(*(F.col(f"`{c}`") for c in left.columns))
    right_row = F.struct(F.col(right_time).alias("__time"), *(F.col(f"`{c}`") for c in carried))
    key = F.struct(*(F.col(k) for k in keys)) if keys else F.lit(0)
    a = left.select(key.alias("__key"), micros(F.col(left_time)).alias("__at"), F.lit(1).alias("__side"), left_row.alias("__left"))
    b = right.where(F.col(right_time).isNotNull()).select(key.alias("__key"), micros(F.col(right_time)).alias("__at"), F.lit(0).alias("__side"), right_row.alias("__right"))
    both = a.unionByName(b, allowMissingColumns=True)
    line = Window.partitionBy("__key").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__found", F.last("__right", ignorenulls=True).over(line)).where("__side = 1")
    near = F.col("__at").isNotNull() & F.col("__found").isNotNull()
    if tolerance_micros is not None:
        near &= F.col("__at") - micros(F.col("__found.__time")) <= tolerance_micros
    return found.select("__left.*", *(F.when(near, F.col(f"__found.`{c}`")).alias(named[c]) for c in carried))


def mask_tombstones(points: DataFrame, tombstones: DataFrame, keys: list[str], time: str = "ts") -> DataFrame:
    """Rows that no (keys, min_ts, max_ts) covers; bounds are inclusive."""
    t = tombstones.select(*(F.col(k).alias(f"__{k}") for k in keys), "min_ts", "max_ts")
    hit = F.col(time).between(F.col("min_ts"), F.col("max_ts"))
    for k in keys:
        hit &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return points.join(t, hit, "left_anti")
