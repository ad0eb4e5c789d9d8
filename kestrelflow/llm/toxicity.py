"""A toxicity classifier that is held to the same score when identity terms are swapped.

A text's features are which words it has, whole and by their beginnings (all languages use endings),
hashed into a fixed space. A logistic regression over them weighs each feature by how much more
often it occurs in toxic texts. For labelled texts that name a group, versions with the group's term
swapped for another of its kind are made, and the squared change of the score is a penalty.

Training takes a bounded sample of labelled rows; scoring takes every row and whole texts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrelflow.llm.common import LOW_BYTES, WordHasher, blocks_of, mix, not_letter, shared, small_batches, span_hashes, steps, utf8

#: Terms for groups of people, by kind; a term is swapped for the next of its row.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"), ("transgender", "cisgender"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "bisexual", "straight"), ("homosexual", "heterosexual"),
    ("black", "white", "asian", "latino"), ("african", "european", "american", "arab", "chinese", "mexican", "indian"),
    ("immigrants", "natives"), ("refugees", "citizens"), ("old", "young"), ("elderly", "teenage"), ("disabled", "blind", "deaf"),
)

DIMENSIONS_BITS = 20
BEGINNINGS = (4, 5, 6, 7, 8)
#: Training takes so many labelled rows of either class at most, those with the least hash of their id.
MOST_ROWS = {1: 2000, 0: 4000}
#: Longer texts are not learnt from (they are scored whole), so what reaches the driver has a bound.
MOST_CHARS = 1 << 16
#: A model weighs so many features at most: of those in two texts or more, the ones whose share of toxic
#: texts is furthest from chance. The others weigh nothing.
MOST_FEATURES = 1 << 15


def held_out(doc_id: Column) -> Column:
    """True for the fold that is never learnt from: crc32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Features:
    """Hashed features of many texts: for each, one id per word and per beginning of 4 to 8 bytes of a word."""

    def __init__(self):
        self.hasher = WordHasher(not_letter())

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Feature ids and the texts they belong to; an id may come several times."""
        starts, lengths, first = self.hasher.spans(data, offsets)
        rows = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        low = self.hasher.folded[data]
        begin = blocks_of(low)[starts]
        out, owners = [mix(span_hashes(low, starts, lengths) + np.uint64(1))], [rows]
        for size in BEGINNINGS:
            long = np.flatnonzero(lengths > size)
            out.append(mix(mix(begin[long] & LOW_BYTES[size]) + np.uint64(size + 1)))
            owners.append(rows[long])
        return (np.concatenate(out) >> np.uint64(64 - DIMENSIONS_BITS)).astype(np.int64), np.concatenate(owners)

    def of_column(self, column: pa.Array):
        """(first row, ids, rows within) by steps."""
        data, offsets = utf8(column)
        for i, j in steps(offsets):
            ids, rows = self.ids(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield i, ids, rows


def swapped(text: str) -> list[str]:
    """The text with its identity terms swapped for the next, and for the one before, of their kind; none if it has none."""
    steps_ahead, steps_back = {}, {}
    for row in IDENTITY_TERMS:
        for i, term in enumerate(row):
            steps_ahead[term], steps_back[term] = row[(i + 1) % len(row)], row[i - 1]
    pattern = _identity_pattern()
    if not pattern.search(text):
        return []
    made = [pattern.sub(lambda m, to=to: to[m[0].lower()], text) for to in (steps_ahead, steps_back)]
    return list(dict.fromkeys(made))


def _identity_pattern() -> re.Pattern:
    return re.compile(r"\b(?:" + "|".join(t for row in IDENTITY_TERMS for t in row) + r")\b", re.IGNORECASE)


class Model:
    """Weights of the hashed features and a bias; `score` gives values from 0 to 1."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def scores(self, column: pa.Array, features: Features) -> np.ndarray:
        total = np.full(len(column), self.bias)
        for first, ids, rows in features.of_column(column):
            value = self.weights[ids]
            some = np.flatnonzero(value)
            key = np.unique((rows[some] << DIMENSIONS_BITS) | ids[some])  # a feature counts once a text
            sums = np.bincount(key >> DIMENSIONS_BITS, self.weights[key & ((1 << DIMENSIONS_BITS) - 1)])
            total[first : first + len(sums)] += sums
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def sample(docs: DataFrame, labels: DataFrame, most: dict[int, int] = MOST_ROWS, most_chars: int = MOST_CHARS) -> DataFrame:
    """(doc_id, text, toxic): what training takes, never of the held-out fold; a row for each id.

    An id that is labelled both 0 and 1 is left out. Where docs has several texts of one id, the one
    with the least hash is taken; null texts and texts of over `most_chars` characters are not.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most")).where("toxic = _most").drop("_most")
    parts = [known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for kind, n in most.items()]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most sum(most) rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.where(F.length("text") <= most_chars).join(chosen, "doc_id")
    return texts.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("doc_id", "text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, most: dict[int, int] = MOST_ROWS, penalty: float = 1.0) -> Model:
    """A model of the sampled labelled rows. Without toxic rows among them every score is below 1e-20."""

    def run(batches):
        features = Features()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            versions, owner, kind = [], [], []
            for i, text in enumerate(texts):
                every = [text, *swapped(text)]
                versions += every
                owner += [i] * len(every)
                kind += range(len(every))
            ids = [np.zeros(0, np.int32)] * len(versions)
            for first, found, rows in features.of_column(pa.array(versions, pa.string())):
                key = np.unique((rows << DIMENSIONS_BITS) | found)
                row, begin = np.unique(key >> DIMENSIONS_BITS, return_index=True)
                for r, part in zip(row, np.split(key, begin[1:]), strict=False):
                    ids[first + r] = (part & ((1 << DIMENSIONS_BITS) - 1)).astype(np.int32)
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), pa.array(kind, pa.int32()), batch.column("toxic").take(at), pa.array(ids, pa.list_(pa.int32()))],
                ["doc_id", "version", "toxic", "ids"],
            )

    rows = small_batches(sample(docs, labels, most)).mapInArrow(run, "doc_id long, version int, toxic int, ids array<int>")
    got = rows.toArrow()
    order = np.lexsort((got.column("version").to_numpy(), got.column("doc_id").to_numpy()))
    toxic, version = got.column("toxic").to_numpy()[order], got.column("version").to_numpy()[order]
    column = got.column("ids").combine_chunks().take(pa.array(order))
    ids, sizes = column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())
    model = train(ids, sizes, toxic, version, penalty)
    del got, column, ids
    pa.default_memory_pool().release_unused()
    return model


def train(ids: np.ndarray, sizes: np.ndarray, toxic: np.ndarray, version: np.ndarray, penalty: float, rounds: int = 300) -> Model:
    """Penalised logistic regression by gradient steps (Adam) over texts given as lists of feature ids.

    Rows with version 0 are labelled texts; those after one with version > 0 are its swapped versions.
    """
    plain = version == 0
    y = toxic[plain].astype(float)
    if not y.any():
        return Model(np.zeros(1 << DIMENSIONS_BITS), -50)
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    space, yes, no = 1 << DIMENSIONS_BITS, y.sum(), len(y) - y.sum()
    in_toxic = np.bincount(ids[(plain & (toxic == 1))[row]], minlength=space).astype(float)
    in_clean = np.bincount(ids[(plain & (toxic == 0))[row]], minlength=space).astype(float)
    ratio = np.log((in_toxic + 1) / (yes + 2)) - np.log((in_clean + 1) / (no + 2))
    # How far from chance a feature's toxic share is; only features that tell something are kept.
    seen = in_toxic + in_clean
    share = yes / (yes + no)
    deviation = np.abs(in_toxic - seen * share) / np.sqrt(np.maximum(seen, 1) * share * (1 - share) + 1)
    deviation[seen < 2] = 0
    chosen = np.sort(np.argsort(-deviation, kind="stable")[:MOST_FEATURES])
    chosen = chosen[deviation[chosen] > 2]
    number = np.full(space, -1, np.int32)
    number[chosen] = np.arange(len(chosen))
    column = number[ids]
    some = column >= 0
    row, column = row[some], column[some]
    value = ratio[chosen][column]
    weight = np.where(y == 1, len(y) / (2 * yes), len(y) / max(2 * no, 1))
    weight = np.minimum(weight, 4 * weight.min()) / len(y)
    origin = np.flatnonzero(plain)[np.cumsum(plain) - 1]  # of each row, the labelled text it was made of
    other = np.flatnonzero(~plain)

    def gradient(w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        margin = np.bincount(row, w[column] * value, len(sizes)) + b
        p = 1 / (1 + np.exp(-np.clip(margin, -50, 50)))
        pull = np.zeros(len(sizes))
        pull[plain] = weight * (p[plain] - y)
        if len(other):
            change = 2 * penalty * (p[other] - p[origin[other]]) / len(other)
            pull[other] += change * p[other] * (1 - p[other])
            np.add.at(pull, origin[other], -change * p[origin[other]] * (1 - p[origin[other]]))
        return np.bincount(column, pull[row] * value, len(chosen)) + 1e-4 * w, pull.sum()

    w, b = np.zeros(len(chosen)), float(np.log((yes + 1) / (no + 1)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        g, gb = gradient(w, b)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        scale = 0.1 * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w -= scale * m / (np.sqrt(v) + 1e-8)
        b -= scale * mb / (np.sqrt(vb) + 1e-8)
    full = np.zeros(space)
    full[chosen] = w * ratio[chosen]
    return Model(full, b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs, repeated rows included.

    Null and empty texts get the score of no feature. held_out is false for a null doc_id; other
    columns are ignored. The model has a fixed size and is broadcast.
    """
    held = shared(docs.sparkSession, model)

    def run(batches):
        own, features = held(), Features()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own.scores(batch.column("text"), features))], ["doc_id", "score"])

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = small_batches(docs).mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    held = shared(docs.sparkSession, model)

    def run(batches):
        own, features = held(), Features()
        for batch in batches:
            yield batch.filter(pa.array(own.scores(batch.column("text"), features) < threshold))

    return small_batches(docs).mapInArrow(run, docs.schema)
