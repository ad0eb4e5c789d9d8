"""Importance resampling towards a target's distribution of word runs.

A batch's texts are joined with a sentinel that no word can hold, and one regular expression pass
finds all words. A feature is a run of words; positions of the sentinels tell each word's text, so runs
that reach into the next text are masked before the features' buckets are counted. What a bucket
counts in the documents and in the target gives its gain; a document's weight is the mean gain of its
features, and adding Gumbel noise (a hash of the id) to the weights draws without replacement.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrelflow.llm.common import small_batches, stored

SENTINEL = b"\xff"  # in no UTF-8 text
WORD, NO_WORD = re.compile(rb"[0-9a-z\x80-\xfe]+|\xff"), re.compile(rb"[^0-9a-z\x80-\xfe]")
FOLD = bytes(range(256)).lower()[:-1] + b"\xfe"
#: Bytes of joined text whose words are held at a time; one longer word is held whole.
PIECE = 1 << 20


def features(texts: list[bytes], most: int, buckets: int, piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Pieces of (text, bucket, words in a run) of all runs of 1 to `most` words of the texts."""
    joined = SENTINEL.join(t.translate(FOLD) for t in texts)
    at, text, kept = 0, 0, []
    while at < len(joined):
        cut = NO_WORD.search(joined, min(at + piece, len(joined)))
        end = cut.start() + 1 if cut else len(joined)
        words = kept + WORD.findall(joined, at, end)
        mark = np.fromiter(map(SENTINEL.__eq__, words), bool, len(words))
        ends = np.flatnonzero(mark)
        of = text + np.searchsorted(ends, np.arange(len(words)))
        codes = list(map(crc32, words))
        for size in range(1, most + 1):
            if size > 1:
                codes = list(map(crc32, words[size - 1 :], map(crc32, repeat(b" "), codes[:-1])))
            last = np.arange(size - 1, len(words))
            whole = (of[last] == of[: len(last)]) & ~mark[last] & (last >= len(kept))
            yield of[last][whole], np.array(codes, np.int64)[whole] % buckets, size
        keep = min(most - 1, len(words))
        kept = words[len(words) - keep :]
        text += len(ends) - int(mark[len(words) - keep :].sum())
        at = end


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def bucket_counts(docs: DataFrame, most: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket: counted by task, summed by Spark, one row a bucket."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, bucket, _ in features(_texts(batch), most, buckets):
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "n"])

    each = small_batches(docs.select(F.col("text").cast("string").alias("text"))).mapInArrow(count, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in each.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed share in the target over that in the source) of each bucket."""
    size, all_source, all_target = len(source), float(source.sum()), float(target.sum())
    return np.array(
        [math.floor(1000 * math.log((t + 1) * (all_source + size) / ((s + 1) * (all_target + size)))) for s, t in zip(source.astype(float).tolist(), target.astype(float).tolist(), strict=True)],
        np.int64,
    )


def weighted(docs: DataFrame, gains: np.ndarray, most: int) -> DataFrame:
    """(doc_id, n_features, n_words, weight) for each row."""
    held, kind = docs.sparkSession.sparkContext.broadcast(gains), docs.schema["doc_id"].dataType.simpleString()

    def weigh(batches):
        gains = held.value
        for batch in batches:
            n = batch.num_rows
            count, words, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for of, bucket, size in features(_texts(batch), most, len(gains)):
                found = np.bincount(of, minlength=n)
                count += found
                words += found if size == 1 else 0
                total += np.bincount(of, gains[bucket], n).astype(np.int64)  # exact: far below 2 ** 53
            weight = total // np.maximum(count, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (count, words, weight))], ["doc_id", "n_features", "n_words", "weight"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return small_batches(rows).mapInArrow(weigh, f"doc_id {kind}, n_features long, n_words long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, most_words: int = 1, buckets: int = 10_000, least_words: int = 20, seed: int = 2024
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): the draw of `percent` percent of docs that look most like the target.

    Words are runs of ASCII letters (A-Z as a-z), digits and characters beyond ASCII; features are
    runs of 1 to `most_words` words joined by a blank, hashed by crc32. Only documents of at least
    `least_words` words are drawn from; floor(percent * their number / 100) are drawn, by highest
    score, ties to the smaller doc_id, then the fewer features and the smaller weight. rank counts
    from 1; it is null for those not drawn. Null and wordless texts have no features and weight 0. A
    null doc_id has no noise, so its score and rank are null and it isn't drawn from. Repeated rows
    are rows of their own. An empty target makes every gain a function of the documents alone; no
    rows give no rows. Other columns are ignored.

    The driver gets a count for each bucket, and for each different score a count: scores are whole
    numbers, with gains and noise of at most 1000 * ln(2 ** 64) or so to either side, so these are
    fewer than 200,000 whatever the table's size. Scores spread by the noise, so rows are ranked by score in
    many tasks; only drawn rows are shuffled.
    """
    spark = docs.sparkSession
    gains = bucket_gains(bucket_counts(docs, most_words, buckets), bucket_counts(target, most_words, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = weighted(docs, gains, most_words).withColumn("score", (F.col("weight") + noise).cast("long"))
    scored = stored(scored, "resample-scores")
    able = F.coalesce((F.col("n_words") >= least_words) & F.col("score").isNotNull(), F.lit(False))

    tied = scored.where(able).groupBy("score").agg(F.count("*").alias("n")).toArrow()
    score, n = (tied.column(c).to_numpy().astype(np.int64) for c in ("score", "n"))
    order = np.argsort(-score)
    score, before = score[order], np.cumsum(n[order]) - n[order]
    drawn = percent * int(n.sum()) // 100
    some = before < drawn
    offsets = spark.createDataFrame(pa.table({"score": score[some], "before": before[some]}))
    offsets = F.broadcast(offsets)

    columns = ["doc_id", "n_features", "weight", "score"]
    order = Window.partitionBy("score").orderBy("doc_id", "n_features", "weight")
    rank = F.col("before") + F.row_number().over(order)
    top = scored.where(able).join(offsets, "score").withColumn("rank", F.when(rank <= drawn, rank).cast("long"))
    rest = scored.where(able).join(offsets, "score", "left_anti").unionByName(scored.where(~able))
    return top.select(*columns, "rank").unionByName(rest.select(*columns, F.lit(None).cast("long").alias("rank")))
