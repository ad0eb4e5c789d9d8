"""Rows by place in an order: range-sorted files with an index of what each holds, and a digest of ordered rows.

A table is stored once, sorted over all its files; a small index has each file's first place and count.
A row at any place is then one file's row, and a row's place is its file's first place plus its own
place in the file, so neither needs a window over the whole table.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Spark's row numbers have a partition's number above so many bits.
LOW_BITS = 33


class Positions:
    """A table in the order of some columns, group by group (such as splits), with places that count from 0 in each group."""

    def __init__(self, spark: SparkSession, path: str, group: str | None, schemas: tuple | None = None):
        """`schemas` of the rows and the index are needed where the table may be empty."""
        self.spark, self.path, self.group = spark, path, group
        read = [spark.read.schema(s) for s in schemas] if schemas else [spark.read] * 2
        self.rows, self.index = read[0].parquet(f"{path}/rows"), read[1].parquet(f"{path}/index")

    @classmethod
    def build(cls, rows: DataFrame, order: Sequence[str], path: str, group: str | None = None, files: int | None = None) -> Positions:
        """Stores the rows under `path`, in `files` files (by default as many as the session's shuffles have), and their index.

        Rows equal in all of the order's columns are in any order among themselves. One shuffle; places come from the sorted files.
        """
        spark, keys = rows.sparkSession, [*([group] if group else []), *order]
        ranged = rows.repartitionByRange(files, *keys) if files else rows.repartitionByRange(*keys)
        number = F.monotonically_increasing_id()
        ranged = ranged.sortWithinPartitions(*keys).select("*", F.shiftright(number, LOW_BITS).cast("int").alias("_file"), number.bitwiseAND(F.lit((1 << LOW_BITS) - 1)).alias("_at"))
        ranged.write.partitionBy("_file").parquet(f"{path}/rows")
        held = spark.read.schema(ranged.schema).parquet(f"{path}/rows")
        of = [F.col(group).alias("_group")] if group else [F.lit(None).cast("string").alias("_group")]
        each = held.groupBy(*of, "_file").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
        before = Window.partitionBy("_group").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file and group
        index = each.withColumn("_from", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        index.write.parquet(f"{path}/index")
        return cls(spark, path, group, (ranged.schema, index.schema))

    def at(self, place: int, group=None) -> DataFrame:
        """The row at a place of a group; no row beyond its end. Reads the index and, of one file, what may hold the row."""
        own = self.index.where(F.col("_group").eqNullSafe(F.lit(group))).where((F.col("_from") <= place) & (place < F.col("_from") + F.col("_rows")))
        found = own.first() if place >= 0 else None
        if found is None:
            return self.rows.drop("_file", "_at").limit(0)
        return self.rows.where((F.col("_file") == found["_file"]) & (F.col("_at") == found["_first"] + place - found["_from"])).drop("_file", "_at")

    def placed(self) -> DataFrame:
        """All rows with `place`; the index, a row for each file and group, is joined by Spark as its size allows."""
        group = F.col(self.group) if self.group else F.lit(None).cast("string")
        index = self.index.select("_group", F.col("_file").alias("_of"), "_first", "_from")
        joined = self.rows.join(index, (F.col("_file") == F.col("_of")) & group.eqNullSafe(F.col("_group")))
        return joined.withColumn("place", F.col("_from") + F.col("_at") - F.col("_first")).drop("_of", "_file", "_at", "_first", "_from", "_group")


def ordered_digest(rows: DataFrame, order: Sequence[str], text: Column, scratch: str, fan: int = 1024, files: int | None = None, levels: int | None = None) -> DataFrame:
    """(rows, digest): a SHA-256 tree over the rows' texts in order, the same however they are partitioned.

    Leaves are the SHA-256 of each text; `fan` digests in a row, joined without anything between, make
    one of the next level, up to a single one. No rows give the SHA-256 of nothing. With `levels` no
    more levels than these are made, and the greatest digest of the last stands for it: of more rows
    than fan ** levels it doesn't tell all changes.
    """
    positions = Positions.build(rows.select(*order, F.sha2(text, 256).alias("_h")), order, f"{scratch}/digest-{uuid.uuid4().hex}", files=files)
    level = positions.placed().select("place", F.col("_h").alias("h"))
    n = left = positions.index.agg(F.sum("_rows")).first()[0] or 0
    made = 0
    while (left > 1 or (left == n and left)) and made != levels:
        made += 1
        listed = level.groupBy(F.floor(F.col("place") / fan).alias("place")).agg(F.sort_array(F.collect_list(F.struct("place", "h"))).alias("l"))
        level = listed.select("place", F.sha2(F.array_join("l.h", ""), 256).alias("h"))
        n, left = -1 if n == left else n, -(-left // fan)
    count = positions.index.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"))
    whole = level.agg(F.coalesce(F.max("h"), F.sha2(F.lit(""), 256)).alias("digest"))
    return count.crossJoin(F.broadcast(whole))  # one row each
