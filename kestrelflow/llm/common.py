"""Helpers that several corpus operators share: Arrow text access, word hashing, shared folders."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from kestrelflow.functions.batches import BATCH_BYTES, small_batches  # noqa: F401

#: Bytes of text that one numpy step holds at a time; a longer document is a step of its own.
STEP_BYTES = 1 << 18
#: A key with more than one in so many of all rows is hot; fewer than so many keys are.
HOT = 512
#: Rows of a few numbers that a task of packed() gets at least, where there are more than cores.
PACKED = 1 << 16


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a new local one where it is unset and Spark runs locally."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not place:
        place = tempfile.mkdtemp(prefix="kestrelflow-")
        spark.conf.set("spark.checkpoint.dir", place)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(place)
    return place


@contextmanager
def run_once(spark: SparkSession):
    """Queries made within are run once: Spark removes their shuffle files as soon as their result is written."""
    conf, key = spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        yield
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def settled(frame: DataFrame) -> DataFrame:
    """The same rows, computed once and read back from the shared checkpoint folder."""
    shared_dir(frame.sparkSession)
    with run_once(frame.sparkSession):
        return frame.select("*").checkpoint()


def packed(frame: DataFrame, rows: int, wide: int = 1) -> DataFrame:
    """The same rows of a settled frame in no more partitions than so many rows (or fewer), each as wide as `wide` rows of a few numbers, need.

    A settled frame has a partition for each task that made it, mostly a few rows each, and each later
    scan would be as many tasks, with as many shuffle files and lines in the event log.
    """
    return frame.coalesce(max(frame.sparkSession.sparkContext.defaultParallelism, -(-rows * wide // PACKED)))


def stored(frame: DataFrame, name: str, by: str | None = None, **options: str) -> DataFrame:
    """The same rows as a Parquet table in the shared folder, in a folder for each value of `by` if it is given; use it for wide rows such as texts."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with run_once(spark):
        frame.write.options(**options).parquet(path, partitionBy=by)
    return spark.read.schema(frame.schema).parquet(path)


def released(spark: SparkSession, *tables: DataFrame) -> None:
    """Frees disk: deletes tables made by stored() that nothing reads again, and has Spark clean up after frames that are gone.

    Spark removes shuffle and checkpoint files when the driver's garbage collector finds their frame
    unreachable, which may be long after a job that needs the room has begun.
    """
    hadoop, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    for table in tables:
        for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            place = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            place.getFileSystem(hadoop).delete(place, True)
    gc.collect()
    jvm.System.gc()


def most_frequent(counts: DataFrame, n: str, most: int) -> tuple[int, bool]:
    """The least count from which at most so many rows have it or more, found by a sixteenth of a power of two, and whether all rows do."""
    part = F.floor(F.log2(n) * 16).alias("part")
    parts = sorted(((r["part"], r["rows"], r["least"]) for r in counts.groupBy(part).agg(F.count("*").alias("rows"), F.min(n).alias("least")).collect()), reverse=True)
    rows, least = 0, np.iinfo(np.int64).max
    for _, more, low in parts:
        rows += more
        if rows > most:
            return int(least), False
        least = low
    return int(least), True


def hot_keys(counts: DataFrame, members: str, total: int) -> list[Row]:
    """The rows of `counts` (a row for each key) whose key has more than one in HOT of all rows: fewer than HOT."""
    return counts.where(F.col(members) * HOT > total).collect()


def lookup(rows: DataFrame, table: DataFrame, key: str | list[str], members: str, total: int) -> DataFrame:
    """rows joined with a table of one row for each key, none of which is a text.

    `members` of the table is how many rows have the key (or more), `total` a bound of its sum. Keys
    of many rows are joined by a broadcast of their fewer than HOT table rows, so a hot key's rows
    stay where they are.
    """
    hot = hot_keys(table, members, total)
    if not hot:
        return rows.join(table, key)
    few = F.broadcast(rows.sparkSession.createDataFrame(hot, table.schema))
    rest = rows.join(few.select(key), key, "left_anti").join(table.where(F.col(members) * HOT <= total), key)
    return rows.join(few, key).unionByName(rest)


def shared(spark: SparkSession, thing) -> Callable:
    """A function that gives tasks this object: its attributes are broadcast, its class travels with the function."""
    held, kind = spark.sparkContext.broadcast(vars(thing)), type(thing)

    def get():
        own = object.__new__(kind)
        own.__dict__.update(held.value)
        return own

    return get


def arrow_rows(frame: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches):
        for batch in batches:
            yield from work(batch)

    return small_batches(frame).mapInArrow(run, schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows in them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of rows with at most so many bytes together, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i], ..., starts[i] + sizes[i] - 1 of all i in a row."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the one of splitmix64) over an array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


#: Lowest n bytes of a 64-bit word.
LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def blocks_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, as one little-endian number; behind the end are zeros."""
    return np.ndarray((len(data) + 1,), "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,))


def _further(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans of over eight bytes, and for each further block its span's place among them, its number and each span's first block."""
    long = np.flatnonzero(lengths > 8)
    count = (lengths[long] - 1) // 8
    begin = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(long)), count)
    return long, owner, np.arange(len(owner)) - begin[owner] + 1, begin


def span_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte strings data[start : start + length].

    Every block of eight bytes is mixed with its number before the blocks are summed, and the length
    goes in at the end; the sum has no algebra that swaps of bytes or blocks could use.
    """
    block, seed = blocks_of(data), np.uint64(0x9E3779B97F4A7C15)
    total = mix(mix((block[starts] & LOW_BYTES[np.minimum(lengths, 8)]) + seed))
    long, owner, nth, begin = _further(lengths)
    if len(long):
        part = block[starts[long][owner] + 8 * nth] & LOW_BYTES[np.minimum(lengths[long][owner] - 8 * nth, 8)]
        total[long] += np.add.reduceat(mix(mix(part + seed) + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), begin)
    return mix(total + lengths.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def same_spans(data, starts, lengths, other, other_starts, other_lengths) -> np.ndarray:
    """True where data[start : start + length] has the bytes of its counterpart in `other`."""
    a, b = blocks_of(data), blocks_of(other)
    same = lengths == other_lengths
    same &= (a[starts] ^ b[other_starts]) & LOW_BYTES[np.minimum(lengths, 8)] == 0
    some = np.flatnonzero(same)
    long, owner, nth, begin = _further(lengths[some])
    if len(long):
        long = some[long]
        differ = (a[starts[long][owner] + 8 * nth] ^ b[other_starts[long][owner] + 8 * nth]) & LOW_BYTES[np.minimum(lengths[long][owner] - 8 * nth, 8)]
        same[long] = np.bitwise_or.reduceat(differ, begin) == 0
    return same


class WordHasher:
    """64-bit hashes of the words of many texts at once.

    Words are the longest runs of bytes for which `separator` is false; with `fold` A-Z count as a-z.
    """

    def __init__(self, separator: np.ndarray, fold: bool = True):
        self.separator, self.folded = separator, np.arange(256, dtype=np.uint8)
        if fold:
            self.folded[ord("A") : ord("Z") + 1] = self.folded[ord("a") : ord("z") + 1]

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' first bytes and lengths, and for each text the index of its first word (and the end)."""
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = ~self.separator[data]
        edge = np.diff(inside)
        cut = offsets[1:-1]
        cut = np.unique(cut[(inside[cut] & inside[cut + 1]) == 1])  # words that meet where one text ends and the next begins
        starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(cut):
            starts, stops = np.sort(np.append(starts, cut)), np.sort(np.append(stops, cut))
        return starts, stops - starts, np.searchsorted(starts, offsets)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the words, their first bytes, and for each text the index of its first word (and the end)."""
        starts, lengths, first = self.spans(data, offsets)
        return span_hashes(self.folded[data], starts, lengths), starts, first


def ascii_space() -> np.ndarray:
    """True for the bytes x20 and x09 to x0D."""
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def not_letter() -> np.ndarray:
    """True for ASCII bytes other than letters and digits; bytes of longer characters are parts of words."""
    table = np.zeros(256, bool)
    table[[i for i in range(128) if not re.match(r"[A-Za-z0-9]", chr(i))]] = True
    return table


def sequences(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words in each text and each text's first run; a shorter text is one run."""
    counts = np.diff(first)
    factor = odd_numbers(size, 0x5EED)
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    at = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(runs, out=at[1:])
    rows = np.repeat(np.arange(len(counts)), runs)
    start = np.arange(at[-1]) - at[:-1][rows] + first[:-1][rows]
    total, last = np.zeros(len(start), np.uint64), first[1:][rows]
    padded = np.append(words, np.zeros(size, np.uint64))
    for k in range(size):
        part = padded[start + k] * factor[k]
        part[start + k >= last] = np.uint64(k)
        total += part
    return mix(total), at
