"""Places of rows within a key, by a range sort over all partitions: no window holds the rows of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.session import written

#: monotonically_increasing_id() has the partition above these bits and the row below.
ROW_BITS = 33


def joined(a: DataFrame, b: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join by columns of the same names where null equals null; the columns are those of ``a``."""
    other = b.withColumnsRenamed({c: f"_of_{i}" for i, c in enumerate(names)})
    on = F.lit(True)
    for i, c in enumerate(names):
        on &= F.col(c).eqNullSafe(F.col(f"_of_{i}"))
    return a.join(other, on, how).drop(*[f"_of_{i}" for i in range(len(names))])


def placed(df: DataFrame, keys: list[str], order: list[str], place: str = "pos", total: str | None = None) -> DataFrame:
    """``df`` with the place of each row (long, from 0) among the rows of its keys in ascending order, nulls first.

    The rows are dealt to partitions by ranges of (keys, order), sorted and written to the
    shared folder; then each partition's rows of a key are counted, and the counts of the
    partitions before are added. A window sees one row for each key and partition only, so
    a key may hold any share of the rows. Rows that are equal in keys and order lie in one
    partition: give ``order`` a column that tells them apart. ``total`` names a column for
    the number of rows of the key. An empty table stays empty.
    """
    by = [F.col(c) for c in (*keys, *order)]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    lined = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_row", F.monotonically_increasing_id())
    rows, _ = written(lined, "placed")
    rows = rows.withColumn("_part", F.shiftright("_row", ROW_BITS))
    own = W.partitionBy(*keys)
    counts = rows.groupBy(*keys, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    if total:
        counts = counts.withColumn("_total", F.sum("_n").over(own))
    made = [(F.col("_row") - F.col("_first") + F.col("_before")).alias(place)] + ([F.col("_total").alias(total)] if total else [])
    return joined(rows, counts, [*keys, "_part"]).select(*df.columns, *made)
