"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in an order shuffled by a hash, are dealt into blocks. In an ideal mix all
sources that have blocks left flow side by side, each in proportion to its weight; when one ends, the
others share its part. Block i of a source is released at the slot in which its ideal flow begins and
is due by the one in which it ends. Earliest deadline first fills one slot after another and meets
every deadline (the ideal flow itself is a fractional schedule that does, so a whole one exists, and
this rule finds it): after any number of slots each source is less than one block from its target.

With n blocks and weight w for each source, the ideal flow has handed out t(v) = sum of min(n, w v)
blocks by virtual time v, and block i flows from v = i / w to (i + 1) / w; so each block's window is
a little arithmetic on whole numbers. Only counts reach the driver, which fills the slots.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrelflow.llm.common import arrow_rows, settled, shared_dir

#: Slices of a source that rank their documents apart from one another.
SLICES = 1024
#: A schedule has about so many blocks at most; of more rows than that many blocks hold, blocks are larger.
MOST_BLOCKS = 4_000_000
#: With more sources than this, blocks go by virtual time.
MOST_SOURCES = 1 << 20
#: Ranges of virtual time that are ranked apart, and blocks that are made by one row of a source.
RANGES, CHUNK = 512, 4096
#: Slots that the driver fills at a time.
STEP = 1 << 20


def _key(source: str | None) -> str:
    return "" if source is None else f"s{source}"


class Flow:
    """The ideal flow of sources of so many blocks and these weights; in whole numbers throughout."""

    def __init__(self, blocks: Sequence[int], weights: Sequence[int]):
        self.n, self.w = np.array(blocks, np.int64), np.array(weights, np.int64)
        large = int(self.w.max(initial=1)) * int(self.n.max(initial=1)) * max(1, len(self.n)) >= 1 << 60
        self.kind = object if large else np.int64
        ends = np.argsort(self.n / self.w, kind="stable")
        # While the first k sources to end are over, t(v) = done[k] + share[k] * v; t is the least of these lines.
        self.done = np.append(0, np.cumsum(self.n[ends].astype(self.kind)))
        self.share = np.append(np.cumsum(self.w[ends][::-1].astype(self.kind))[::-1], 0)
        self.ended = (self.n / self.w)[ends]

    def flown(self, source: np.ndarray, i: np.ndarray, up: int) -> np.ndarray:
        """t(i / w) of each block's source, rounded down, or up."""
        k = np.searchsorted(self.ended, i / self.w[source])
        near = np.clip(k[None, :] + np.arange(-2, 3)[:, None], 0, len(self.n))  # as the search is in floats
        own = self.w[source].astype(self.kind)
        scaled = (self.done[near] * own + self.share[near] * i.astype(self.kind)).min(axis=0)
        return ((scaled + up * (own - 1)) // own).astype(np.int64)

    def released(self, slot: int) -> np.ndarray:
        """How many blocks of each source have windows that begin before a slot."""
        source, low, high = np.arange(len(self.n)), np.zeros_like(self.n), self.n.copy()
        while (low < high).any():
            middle = (low + high) // 2
            before = (self.flown(source, middle, 0) < slot) & (low < high)
            low, high = np.where(before, middle + 1, low), np.where(before | (low >= high), high, middle)
        return low


def schedule_parts(blocks: Sequence[int], weights: Sequence[int], step: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(source, number of the block in it) of all slots in order, `step` slots at a time, by earliest deadline first.

    Holds the sources and the windows that begin in a step, however many blocks there are.
    """
    flow = Flow(blocks, weights)
    total, first = int(flow.n.sum()), np.cumsum(flow.n) - flow.n
    ready, next_block = [], np.zeros_like(flow.n)
    for begin in range(0, total, step):
        end = min(begin + step, total)
        upto = flow.released(end)
        count = upto - next_block
        source = np.repeat(np.arange(len(count)), count)
        at = np.arange(len(source)) - np.repeat(np.cumsum(count) - count, count) + next_block[source]
        release, deadline, next_block = flow.flown(source, at, 0), flow.flown(source, at + 1, 1), upto
        order = np.argsort(release, kind="stable")
        waiting, due, ids = release[order].tolist(), deadline[order].tolist(), (first[source] + at)[order].tolist()
        filled, j = [], 0
        for t in range(begin, end):
            while j < len(waiting) and waiting[j] <= t:
                heapq.heappush(ready, (due[j], ids[j]))
                j += 1
            deadline, block = heapq.heappop(ready)
            if deadline <= t:
                raise AssertionError("a deadline was missed")
            filled.append(block)
        filled = np.array(filled, np.int64)
        own = np.searchsorted(first + flow.n, filled, "right")
        yield own, filled - first[own]


def schedule(blocks: Sequence[int], weights: Sequence[int]) -> np.ndarray:
    """The slot of each block, source by source, by earliest deadline first."""
    n = np.array(blocks, np.int64)
    slots, first, begin = np.zeros(n.sum(), np.int32), np.cumsum(n) - n, 0
    for source, block in schedule_parts(blocks, weights):
        slots[first[source] + block] = np.arange(begin, begin + len(source))
        begin += len(source)
    return slots


def planned_slots(spark: SparkSession, keys: Sequence[str], blocks: Sequence[int], weights: Sequence[int], step: int = STEP) -> DataFrame:
    """(_key, _block, slot) of all blocks, as a Parquet table in the shared folder that is written step by step."""
    path, begin, names = f"{shared_dir(spark).rstrip('/')}/mix-slots-{uuid.uuid4().hex}", 0, pa.array(keys, pa.string())
    for source, block in schedule_parts(blocks, weights, step):
        part = pa.table({"_key": names.take(pa.array(source)), "_block": pa.array(block), "slot": pa.array(np.arange(begin, begin + len(source)))})
        spark.createDataFrame(part).write.mode("append").parquet(path)
        begin += len(source)
    return spark.read.schema("_key string, _block long, slot long").parquet(path)


def tempered_weights(counts: Mapping[str | None, int], power: float = 0.5, units: int = 1000) -> dict:
    """Whole weights in proportion to count ** power, about `units` together, or as many as give the least 10."""
    total = sum(n**power for n in counts.values())
    units = max(units, math.ceil(10 * total / min((n**power for n in counts.values()), default=1)))
    return {s: max(1, round(units * n**power / total)) for s, n in counts.items()}


def row_hash(docs: DataFrame, seed: int) -> Column:
    """A hash of all columns of a row."""
    plain = [F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    return F.xxhash64(F.lit(seed), *plain)


def virtual_slots(counted: DataFrame, weights: Mapping[str | None, int] | None, block: int, power: float = 0.5) -> DataFrame:
    """(_key, _block, slot) of all blocks of the sources (source, n), by virtual time."""
    spark, key = counted.sparkSession, F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    own = counted.select(key.alias("_key"), F.col("n"))
    if weights is None:
        own = own.withColumn("_w", F.pow(F.col("n").cast("double"), F.lit(power)))
    else:
        given = spark.createDataFrame([(_key(s), float(w)) for s, w in weights.items()], "_key string, _w double")
        own = own.join(given, "_key", "left").withColumn("_w", F.coalesce("_w", F.lit(1.0)))
    own = own.withColumn("_part", F.pmod(F.xxhash64("_key"), F.lit(RANGES)))
    like = F.row_number().over(Window.partitionBy("_part").orderBy("_w", "_key"))
    own = own.withColumn("_u", F.pmod(like * F.lit((5**0.5 - 1) / 2) + F.col("_part") / F.lit(float(RANGES)), F.lit(1.0)))

    last = F.floor((F.col("n") - 1) / block).cast("long")  # a source's last block
    chunks = own.withColumn("_last", last).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_last") / CHUNK))))
    chunks = chunks.repartition("_key", "_chunk")
    begin = F.col("_chunk") * CHUNK
    blocks = chunks.select("_key", "_w", "_u", F.explode(F.sequence(begin, F.least(begin + CHUNK - 1, F.col("_last")))).alias("_block"))
    blocks = settled(blocks.select("_key", "_block", ((F.col("_block") + F.col("_u")) / F.col("_w")).alias("_time")))

    cuts = blocks.agg(F.percentile_approx("_time", [i / RANGES for i in range(1, RANGES)], 10_000)).first()[0]
    cuts = np.unique(np.array(cuts or [], float))

    def ranged(batch: pa.RecordBatch):
        at = np.searchsorted(cuts, batch.column("_time").to_numpy(zero_copy_only=False), "right")
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], [*batch.schema.names, "_range"])

    blocks = arrow_rows(blocks, ranged, "_key string, _block long, _time double, _range int")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over RANGES rows at most
    sizes = blocks.groupBy("_range").agg(F.count("*").alias("_size"))
    offsets = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_from"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy("_time", "_key", "_block")) - 1
    return blocks.withColumn("_nth", rank).join(F.broadcast(offsets), "_range").select("_key", "_block", (F.col("_from") + F.col("_nth")).cast("long").alias("slot"))


def mix_sources(docs: DataFrame, weights: Mapping[str | None, int] | None = None, block: int = 16, seed: int = 7, bounded: bool = True) -> DataFrame:
    """The rows of docs with slot, place and position; in order of position they follow the weights.

    `weights` are whole numbers per source (1 for a source that isn't in it); by default they go with
    the square roots of the sources' row counts. A block has `block` rows, or more where MOST_BLOCKS
    of them wouldn't hold the table; a source's last may have fewer. `place` counts from 0 in the
    block, position = slot * rows of a block + place. Every row stays, repeated rows too. A null
    source is a source of its own; null texts and ids are rows like others. Within a source rows go
    by a hash of all their columns, then by these hashes' second half, so a row's position depends on
    the table's rows alone; rows equal in all columns are exchanged at will. A weight below 1 raises
    ValueError. Columns slot, place and position are replaced.

    One count per source reaches the driver, and the schedule (four bytes a block) is broadcast. With
    more than MOST_SOURCES sources there is no schedule: these are held to their weights (the square
    roots themselves) by virtual time, and a source of share p is within one block and p times a small
    sum over all sources of its target.

    Without `bounded` one rule holds at every size: blocks keep `block` rows and all sources are on the
    schedule. The driver then holds a count for each source and fills the slots step by step into the
    shared folder, where a table of more than STEP blocks finds them by a join.
    """
    if weights is not None and any(w < 1 or w != int(w) for w in weights.values()):
        raise ValueError("weights are whole numbers of 1 or more")
    spark = docs.sparkSession
    docs = docs.drop("slot", "place", "position")
    counted = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.count("*").alias("n"))
    some = counted.limit(MOST_SOURCES + 1).collect() if bounded else counted.toArrow().to_pylist()
    planned = stepwise = None
    if not bounded or len(some) <= MOST_SOURCES:
        counts = {r["source"]: r["n"] for r in sorted(some, key=lambda r: _key(r["source"]))}
        block = max(block, -(-sum(counts.values()) // MOST_BLOCKS)) if bounded else block
        chosen = tempered_weights(counts) if weights is None else {s: weights.get(s, 1) for s in counts}
        blocks = [-(-n // block) for n in counts.values()]
        keys = list(map(_key, counts))
        if not bounded and sum(blocks) > STEP:
            stepwise = planned_slots(spark, keys, blocks, list(chosen.values()), STEP)
        else:
            slots = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(blocks)), pa.int32()), pa.array(schedule(blocks, list(chosen.values()))))
            planned = F.broadcast(spark.createDataFrame(pa.table({"_key": pa.array(keys, pa.string()), "_slots": slots})))

    order = row_hash(docs, seed)
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))  # as _key(), never null
    rows = docs.select(F.struct("*").alias("_row"), key.alias("_key"), order.alias("_order"), row_hash(docs, seed + 1).alias("_tie"))  # apart from names of ours
    rows = rows.withColumn("_slice", F.shiftrightunsigned("_order", 64 - (SLICES - 1).bit_length()).cast("int"))
    sizes = rows.groupBy("_key", "_slice").agg(F.count("*").alias("_size"))
    before = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_key", "_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    # Ranks and offsets go by the same two columns, so whole rows are shuffled once.
    within = Window.partitionBy("_key", "_slice").orderBy("_order", "_tie")
    rows = rows.withColumn("_rank", F.row_number().over(within))
    rows = rows.join(offsets, ["_key", "_slice"])
    rank = F.col("_offset") + F.col("_rank") - 1
    rows = rows.withColumn("_block", F.floor(rank / block).cast("long")).withColumn("place", (rank % block).cast("int"))
    position = (F.col("slot") * block + F.col("place")).alias("position")
    if planned is None:
        rows = rows.join(virtual_slots(counted, weights, block) if stepwise is None else stepwise, ["_key", "_block"])
    else:
        rows = rows.join(planned, "_key").withColumn("slot", F.get("_slots", F.col("_block").cast("int")).cast("long"))
    return rows.select("_row.*", "slot", "place", position)
