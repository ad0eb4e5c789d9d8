"""Near-duplicate groups by b-bit MinHash.

Each text becomes its set of word shingles. `bands` x `rows` minima of the set are kept: a hash of
each band's minima finds candidates, and the lowest two bits of every minimum, packed into longs,
estimate the similarity of a pair from bit counts, corrected for chance agreement of two bits.
What may be similar is settled on the full sets.

Equal sets collapse first. In each band bucket all members are compared with one member only, so a
bucket of any size makes as many pairs as it has rows. Buckets with members not linked to that one
meet their best linked member too. Then a last pass compares members of one bucket that lie in
different components and whose count of shingles found nowhere else, and a finer signature, leave
room for a link. So no link within a bucket is lost.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrelflow.llm.common import (
    WordHasher,
    arrow_rows,
    ascii_space,
    lookup,
    mix,
    odd_numbers,
    packed,
    released,
    sequences,
    settled,
    steps,
    stored,
    utf8,
)
from kestrelflow.llm.components import connected_components

BITS = 2
#: A row with its bands and signature is as wide as so many rows of a few numbers.
WIDE = 8
#: Minima in the finer signatures of the second pass, which only documents of mixed buckets get.
FINER = 1280


def shingle_sets(column: pa.Array, size: int, hasher: WordHasher):
    """For each text of the column, in order, its distinct shingle hashes in ascending order."""
    data, offsets = utf8(column)
    for i, j in steps(offsets):
        a, b = offsets[i], offsets[j]
        words, _, first = hasher.words(data[a:b], offsets[i : j + 1] - a)
        runs, at = sequences(words, first, size)
        for k in range(j - i):
            part = np.sort(runs[at[k] : at[k + 1]])
            yield part[np.append(True, part[1:] != part[:-1])] if len(part) else part


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n, set_a, set_b, bands, sig) of (doc_id, text): the set's size, two hashes of the
    whole set, a hash for each band and the packed low bits. An empty set has no bands."""
    factors, words = odd_numbers(bands * rows, 77), -(-bands * rows * BITS // 64)

    def work(batch: pa.RecordBatch):
        hasher = WordHasher(ascii_space())
        n, set_a, set_b, keys, sigs = [], [], [], [], []

        def flush(sets: list[np.ndarray]) -> None:
            sizes = np.array([len(x) for x in sets], np.int64)
            n.extend(sizes.tolist())
            full = np.flatnonzero(sizes)
            whole = np.concatenate(sets)
            a, b, band, sig = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64), None, None
            if len(full):
                at = np.append(0, np.cumsum(sizes[full]))[:-1]
                a[full] = np.add.reduceat(mix(whole + np.uint64(11)), at)
                b[full] = np.bitwise_xor.reduceat(mix(whole + np.uint64(13)), at)
                minima, room = np.empty((bands * rows, len(full)), np.uint64), np.empty_like(whole)
                for k, factor in enumerate(factors):
                    np.multiply(whole, factor, out=room)
                    np.minimum.reduceat(room, at, out=minima[k])
                minima = mix(minima)
                weights = odd_numbers(rows, 5)[None, :, None]
                salt = np.arange(1, bands + 1, dtype=np.uint64)[:, None] << np.uint64(40)
                band = mix((minima.reshape(bands, rows, -1) * weights).sum(1) + salt).T
                low = (minima >> np.uint64(64 - BITS)).T
                low = np.pad(low, ((0, 0), (0, words * 64 // BITS - low.shape[1]))).reshape(len(full), words, 64 // BITS)
                sig = np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), 2)
            set_a.extend(a.view(np.int64).tolist())
            set_b.extend(b.view(np.int64).tolist())
            place = dict(zip(full.tolist(), range(len(full)), strict=True))
            for i in range(len(sets)):
                p = place.get(i)
                keys.append([] if p is None else band[p].view(np.int64))
                sigs.append([] if p is None else sig[p].view(np.int64))

        held, count = [], 0
        for s in shingle_sets(batch.column("text"), size, hasher):
            held.append(s)
            count += len(s)
            if count > 40_000 or len(held) * len(factors) > 200_000:
                flush(held)
                held, count = [], 0
        if held:
            flush(held)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(set_a, pa.int64()), pa.array(set_b, pa.int64()),
                pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.list_(pa.int64())),
            ],
            ["doc_id", "n", "set_a", "set_b", "bands", "sig"],
        )

    return arrow_rows(docs, work, "doc_id long, n long, set_a long, set_b long, bands array<long>, sig array<long>")


def estimated(a: Column, b: Column, positions: int) -> Column:
    """Similarity by bit counts: agreeing positions, less what two random low-bit values agree by chance."""
    words = -(-positions * BITS // 64)
    differ = F.lit(0)
    for i in range(words):
        x = a[i].bitwiseXOR(b[i])
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    chance = 0.5**BITS
    return (1 - differ / F.lit(float(positions)) - chance) / (1 - chance)


def least_estimate(threshold: float, positions: int, deviations: float = 5.0) -> float:
    """An estimate so many standard deviations below the threshold; less is not examined further."""
    chance = 0.5**BITS
    agree = threshold + (1 - threshold) * chance
    return threshold - deviations * math.sqrt(agree * (1 - agree) / positions) / (1 - chance)


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose full sets have 100 * intersection >= percent * union."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def work(batch: pa.RecordBatch):
        hasher, keep = WordHasher(ascii_space()), []
        sets = zip(
            shingle_sets(batch.column("text_a"), size, hasher), shingle_sets(batch.column("text_b"), size, hasher), strict=True
        )
        for x, y in sets:
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return arrow_rows(pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b"), work, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 32, rows: int = 5) -> DataFrame:
    """Components of documents linked by 100 * intersection >= percent * union of their word shingles.

    Takes doc_id (long) and text; other columns are ignored. Returns (doc_id, n_shingles,
    component_id) with a row for each input row, repeated rows included. Null or wordless texts
    have no shingles and are linked with nothing, but rows of one id have its one component; texts of
    fewer words than a shingle are one shingle. A null doc_id is linked with nothing and has a null component. No rows give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    released(spark)
    signed = settled(signatures(docs, shingle, bands, rows))
    every = signed.count()
    signed = packed(signed, every, WIDE)
    full = signed.where("n > 0 and doc_id is not null")
    ratio, least = percent / 100, least_estimate(percent / 100, bands * rows)

    # Equal sets have equal bands and signatures, so any of them will do.
    sets = ["set_a", "set_b", "n"]
    one = settled(
        full.groupBy(*sets).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.count("*").alias("copies"))
    )
    one = packed(one, every, WIDE)
    repeated = _ids_of_several_sets(signed, one, sets, every)
    reps = one.select("rep", "n", "bands", "sig")

    members = reps.select("rep", F.explode("bands").alias("key")).repartition("key")
    buckets = members.groupBy("key").agg(F.count("*").alias("members"), F.min_by("rep", F.xxhash64("rep", "key")).alias("pivot"))
    shared = settled(members.join(buckets.where("members > 1"), "key").select("key", "rep", "pivot"))
    most = shared.count()  # a bound of the rows of all that is made of them, up to the last pass
    shared = packed(shared, most)
    traits = reps.select("rep", "n", "sig")
    texts = stored(docs.join(shared.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), "neardup-texts")

    paired = shared.where("rep <> pivot").select("key", F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"))
    tried = paired.select("a", "b").distinct()
    for end in ("a", "b"):
        tried = tried.join(traits.select(F.col("rep").alias(end), F.col("n").alias(f"n_{end}"), F.col("sig").alias(f"sig_{end}")), end)
    near = (F.least("n_a", "n_b") >= ratio * F.greatest("n_a", "n_b")) & (
        estimated(F.col("sig_a"), F.col("sig_b"), bands * rows) >= least
    )
    tried = packed(settled(tried.where(near).select("a", "b")), most)
    links = packed(settled(confirmed(tried, texts, shingle, percent)), most)

    # Where a member isn't linked to the pivot, the bucket meets its best linked member.
    unsettled = paired.join(links, ["a", "b"], "left_anti").select("key").distinct()
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("degree"))
    open_rows = shared.select("key", "rep").join(unsettled, "key").join(degree, "rep", "left").select("key", "rep", F.coalesce("degree", F.lit(0)).alias("degree"))
    open_rows = open_rows.repartition("key")
    hubs = open_rows.groupBy("key").agg(F.max(F.struct("degree", F.xxhash64("rep").alias("h"), "rep"))["rep"].alias("hub"))
    second = open_rows.join(hubs, "key").where("rep <> hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))
    second = packed(settled(second.distinct().join(tried, ["a", "b"], "left_anti")), most)
    links = links.unionByName(packed(settled(confirmed(second, texts, shingle, percent)), most))
    tried = tried.unionByName(second)

    # What is left: members of one bucket in different components.
    released(spark)
    known = packed(settled(connected_components(links.unionByName(repeated))), most + every)
    open_rows = packed(settled(_mixed(shared, known)), most)
    open_texts = stored(texts.join(open_rows.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), "neardup-open")
    lone = _lone_shingles(open_texts, shingle).withColumnRenamed("doc_id", "rep")
    finer = signatures(open_texts, shingle, 1, FINER).select(F.col("doc_id").alias("rep"), F.col("sig").alias("fine"), "n")
    room = reps.join(finer, ["rep", "n"]).join(lone, "rep", "left").withColumn("lone", F.coalesce("lone", F.lit(0)))
    open_rows = open_rows.join(room, "rep").where(F.col("n") - F.col("lone") >= ratio * F.col("n"))
    x, y = open_rows.alias("x"), open_rows.alias("y")
    both = F.least(F.expr("x.n - x.lone"), F.expr("y.n - y.lone"))
    rest = x.join(
        y,
        F.expr("x.key = y.key and x.rep < y.rep and x.label <> y.label")
        & (100 * both >= percent * (F.expr("x.n + y.n") - both))
        & (estimated(F.col("x.sig"), F.col("y.sig"), bands * rows) >= least)
        & (estimated(F.col("x.fine"), F.col("y.fine"), FINER) >= least_estimate(percent / 100, FINER))
        & F.expr("x.key = array_intersect(x.bands, y.bands)[0]"),
    ).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    rest = settled(confirmed(rest.distinct().join(tried, ["a", "b"], "left_anti"), texts, shingle, percent))
    last = rest.count()

    components = known
    if last:
        rest, stars = packed(rest, last), known.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        components = connected_components(stars.unionByName(rest))
    label = F.coalesce("component", "rep").alias("component_id")
    of_sets = settled(one.select(*sets, "rep", "copies").join(components, F.col("rep") == F.col("node"), "left").select(*sets, "copies", label))
    of_sets = packed(of_sets, every)
    released(spark, texts, open_texts)  # not before, as stages that Spark has left unfinished may still read them
    out = lookup(full.select("doc_id", *sets), of_sets, sets, "copies", every)
    out = out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = signed.where("n = 0 or doc_id is null").join(components, F.col("doc_id") == F.col("node"), "left")
    return out.unionByName(alone.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")))


def _ids_of_several_sets(signed: DataFrame, one: DataFrame, sets: list[str], every: int) -> DataFrame:
    """Links (a, b) between an id whose rows have different sets, an empty one among them or not, and the least ids of those sets."""
    extremes = signed.where("doc_id is not null").groupBy("doc_id")
    extremes = extremes.agg(*(f(c).alias(f"{c}_{end}") for c in sets for end, f in (("lo", F.min), ("hi", F.max))))
    several = settled(extremes.where(" or ".join(f"{c}_lo <> {c}_hi" for c in sets)).select("doc_id"))
    several = packed(several, every)
    if several.isEmpty():
        return several.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    of = signed.where("n > 0").select("doc_id", *sets).join(several, "doc_id", "left_semi").distinct().join(one.select(*sets, "rep"), sets)
    return packed(settled(of.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))), every)


def _mixed(shared: DataFrame, known: DataFrame) -> DataFrame:
    """(key, rep, label) of the buckets whose members lie in several components so far."""
    labelled = shared.select("key", "rep").join(known.withColumnRenamed("node", "rep"), "rep", "left")
    labelled = labelled.select("key", "rep", F.coalesce("component", "rep").alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    return labelled.join(mixed.select("key"), "key")


def _lone_shingles(texts: DataFrame, size: int) -> DataFrame:
    """(doc_id, lone): how many of a text's shingles are in no other of these texts."""

    def work(batch: pa.RecordBatch):
        hasher = WordHasher(ascii_space())
        for doc, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text"), size, hasher), strict=True):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(s), doc, np.int64)), pa.array(s.view(np.int64))], ["doc_id", "shingle"]
            )

    each = arrow_rows(texts, work, "doc_id long, shingle long")
    alone = each.groupBy("shingle").agg(F.count("*").alias("times"), F.min("doc_id").alias("doc_id")).where("times = 1")
    return alone.groupBy("doc_id").agg(F.count("*").alias("lone"))
