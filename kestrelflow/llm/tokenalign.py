"""Alignment of two tokenizers' tokens over the same bytes.

Each text is encoded by a byte-level BPE (A) and a sentence-piece model (B). Token ends are cumulative
byte counts; an end-to-index dictionary for each side, and the intersection of their keys, give the
places where tokens of both sides end. These cut both id lists into groups, and within a group each
pair of tokens whose bytes overlap is a link. How often a pair of ids is linked is counted over all
documents, and every document's links are then looked up in these counts.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelflow.llm.common import most_frequent, ragged, released, same_spans, shared, small_batches, span_hashes, steps, stored, utf8
from kestrelflow.llm.tokens import Merges, token_starts

#: Bytes of text that are encoded and aligned at a time; one longer text is held whole.
STEP = 1 << 21
#: Id pairs whose counts every task holds: the most frequent ones. The rest are joined.
MOST_HELD = 1 << 20


class ByteLevel:
    """Encoder by a byte-level vocabulary: each different pre-token of a step is merged once, all of them side by side."""

    def __init__(self, merges: Merges):
        self.merges, self.bytes = merges, merges.bytes
        self.length = np.array([len(b) for b in self.bytes], np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, each text's first (and the end), and whether its ids' bytes are as many as its own."""
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        starts = lead[token_starts(chars, np.searchsorted(lead, offsets), self.merges.classes)]
        lengths = np.diff(np.append(starts, len(data)))
        _, where, back = np.unique(span_hashes(data, starts, lengths), return_index=True, return_inverse=True)
        other = np.flatnonzero(~same_spans(data, starts, lengths, data, starts[where][back], lengths[where][back]))
        back[other] = len(where) + np.arange(len(other))  # equal hashes, other bytes
        where = np.append(where, other)
        left: list = []
        count = self.merges.symbols_left(data, starts[where], lengths[where], left)
        row, ids = (np.concatenate(x) for x in zip(*left, strict=True))
        ids = ids[np.argsort(row, kind="stable")]
        begin, sizes = np.cumsum(count) - count, count[back]
        out = ids[ragged(begin[back], sizes)]
        first = np.append(0, np.cumsum(sizes))[np.searchsorted(starts, offsets)]
        ends = np.append(0, np.cumsum(self.length[out]))[first]
        return out, first, np.diff(ends) == np.diff(offsets)


class Pieces:
    """Encoder of the sentencepiece library."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.library = own = SentencePieceProcessor(model_proto=model)
        self.bytes = [
            bytes([int(own.id_to_piece(i)[3:5], 16)]) if own.is_byte(i) else own.id_to_piece(i).replace("▁", " ").encode()
            for i in range(own.get_piece_size())
        ]
        self.length = np.array([len(b) for b in self.bytes], np.int64)

    def encode(self, texts: list[str], wanted: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ByteLevel.encode(); `wanted` has the bytes to compare with."""
        lists = self.library.encode(texts, num_threads=1)
        good = [b"".join([self.bytes[i] for i in ids]) == w for ids, w in zip(lists, wanted, strict=True)]
        first = np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int64)
        return np.fromiter(chain.from_iterable(lists), np.int64, first[-1]), first, np.array(good, bool)


def common_ends(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int]]:
    """Indices of the tokens of either side that end where one of the other side ends, in order."""
    at_a, at_b = dict(zip(ends_a, range(len(ends_a)))), dict(zip(ends_b, range(len(ends_b))))
    both = sorted(at_a.keys() & at_b.keys())
    return [at_a[e] for e in both], [at_b[e] for e in both]


def links_of(last_a: np.ndarray, last_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices (a, b) of all overlapping tokens of the groups that end at these indices, and how many each group has.

    A group of p and q tokens has p + q - 1 links, as no two of its inner ends are equal. Where p or q
    is 1 the one token meets all of the other side; in other groups the sorted inner ends of both
    sides tell which tokens meet.
    """
    first_a, first_b = np.append(0, last_a[:-1] + 1), np.append(0, last_b[:-1] + 1)
    p, q = last_a - first_a + 1, last_b - first_b + 1
    many = p + q - 1
    at = np.cumsum(many) - many
    a, b = np.repeat(first_a, many), np.repeat(first_b, many)
    step = np.arange(len(a)) - np.repeat(at, many)
    a += np.where(np.repeat(q == 1, many), step, 0)
    b += np.where(np.repeat(p == 1, many), step, 0)
    mixed = np.flatnonzero((p > 1) & (q > 1))
    if len(mixed):
        ia, ib = ragged(first_a[mixed], p[mixed]), ragged(first_b[mixed], q[mixed])
        ends = np.unique(np.append(ends_a[ia], ends_b[ib]))  # the groups' ranges of bytes lie one after the other
        place = ragged(at[mixed], many[mixed])
        a[place] = ia[np.searchsorted(ends_a[ia], ends)]
        b[place] = ib[np.searchsorted(ends_b[ib], ends)]
    return a, b, many


class Aligner:
    """Both encoders, and the decimal forms of ids that the group digest is made of."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        most = max(len(a.bytes), len(b.bytes))
        said = [f"{i}," for i in range(most)]
        self.size = np.array([len(x) for x in said], np.int64)
        self.wide = int(self.size.max())
        self.digits = np.frombuffer("".join(x.ljust(self.wide) for x in said).encode(), np.uint8)

    def texts(self, texts: list[str | None]):
        """Arrays (n_a, n_b, n_groups, n_links), digests, and the different id pairs of each text with their counts."""
        n, width = len(texts), len(self.b.bytes)
        numbers, digests = np.zeros((4, n), np.int64), [""] * n
        some = [i for i, t in enumerate(texts) if t]
        none = digests, np.zeros(n + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not some:
            return numbers, *none
        raw = [(" " + texts[i]).encode() for i in some]
        offsets = np.append(0, np.cumsum([len(r) for r in raw]))
        ids_a, first_a, good_a = self.a.encode(np.frombuffer(b"".join(raw), np.uint8), offsets)
        ids_b, first_b, good_b = self.b.encode([texts[i] for i in some], raw)
        keep = np.flatnonzero(good_a & good_b)
        if not len(keep):
            return numbers, *none
        count_a, count_b = np.diff(first_a)[keep], np.diff(first_b)[keep]
        ids_a, ids_b = ids_a[ragged(first_a[keep], count_a)], ids_b[ragged(first_b[keep], count_b)]
        first_a, first_b = np.append(0, np.cumsum(count_a)), np.append(0, np.cumsum(count_b))
        ends_a, ends_b = np.cumsum(self.a.length[ids_a]), np.cumsum(self.b.length[ids_b])
        last_a, last_b, groups = [], [], []
        for k in range(len(keep)):
            at_a, at_b = common_ends(ends_a[first_a[k] : first_a[k + 1]].tolist(), ends_b[first_b[k] : first_b[k + 1]].tolist())
            last_a.append(np.array(at_a, np.int64) + first_a[k])
            last_b.append(np.array(at_b, np.int64) + first_b[k])
            groups.append(len(at_a))
        last_a, last_b, groups = np.concatenate(last_a), np.concatenate(last_b), np.array(groups)
        a, b, many = links_of(last_a, last_b, ends_a, ends_b)
        of_group = np.repeat(np.arange(len(keep)), groups)
        links = np.bincount(of_group, many, len(keep)).astype(np.int64)

        row = np.array(some)[keep]
        numbers[:, row] = count_a, count_b, groups, links
        pair, times = np.unique(np.repeat(np.arange(len(keep)), links) * (len(self.a.bytes) * width) + ids_a[a] * width + ids_b[b], return_counts=True)
        each = np.zeros(n, np.int64)
        each[row] = np.bincount(pair // (len(self.a.bytes) * width), minlength=len(keep))

        # Tokens of A of a group, then those of B, each with the mark behind it.
        size_a, size_b = np.diff(np.append(-1, last_a)), np.diff(np.append(-1, last_b))
        every, mark = np.empty(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
        place_a = np.arange(len(ids_a)) + np.repeat(last_b + 1 - size_b, size_a)
        place_b = np.arange(len(ids_b)) + np.repeat(last_a + 1, size_b)
        every[place_a], every[place_b] = ids_a, ids_b
        mark[place_a[last_a]], mark[place_b[last_b]] = ord("|"), ord(";")
        sizes = self.size[every]
        ends = np.append(0, np.cumsum(sizes))
        text = self.digits[ragged(every * self.wide, sizes)]
        text[ends[1:] - 1] = mark
        text, cut = text.tobytes(), ends[first_a + first_b].tolist()
        for k, r in enumerate(row.tolist()):
            digests[r] = hashlib.sha256(text[cut[k] : cut[k + 1] - 1]).hexdigest()
        return numbers, digests, np.append(0, np.cumsum(each)), pair % (len(self.a.bytes) * width), times


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def aligned(docs: DataFrame, byte_level: str, pieces: str) -> tuple[DataFrame, int]:
    """(_row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) for each row, and B's size.

    `pairs` are the text's different links as id_a * B's size + id_b in ascending order, `times` how often each occurs.
    """
    with open(pieces, "rb") as f:
        model = f.read()
    files = shared(docs.sparkSession, Files(Merges(byte_level), model))

    def work(batches):
        held = files()
        align = Aligner(ByteLevel(held.merges), Pieces(held.model))
        for batch in batches:
            column = batch.column("text")
            _, offsets = utf8(column)
            for i, j in steps(offsets, STEP):
                numbers, digests, at, pair, times = align.texts(column.slice(i, j - i).to_pylist())
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x)) for x in (pair, times)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, j - i) for c in ("_row", "doc_id")), *map(pa.array, numbers), pa.array(digests), *lists],
                    ["_row", "doc_id", *NUMBERS, "groups_sha256", "pairs", "times"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    numbers = ", ".join(f"{c} long" for c in NUMBERS)
    found = small_batches(rows).mapInArrow(work, f"_row long, doc_id {kind}, {numbers}, groups_sha256 string, pairs array<long>, times array<long>")
    return found, len(Pieces(model).bytes)


class Files:
    """The two vocabularies, for tasks."""

    def __init__(self, merges: Merges, model: bytes):
        self.merges, self.model = merges, model


#: Sorted numbers are stored as bit-packed differences.
PACKED = {"parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0", "compression": "zstd"}


def pair_counts(found: DataFrame, size_b: int) -> tuple[DataFrame, np.ndarray]:
    """(pair, n) over all documents, and for each id of B the highest count of its pairs (0: it has none)."""
    each = found.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy(F.col("pairs").alias("pair"))
    counts = stored(each.agg(F.sum("times").alias("n")), "link-counts")
    top = counts.groupBy((F.col("pair") % size_b).cast("int").alias("b")).agg(F.max("n").alias("n")).toArrow()
    best = np.zeros(size_b, np.int64)
    best[top.column("b").to_numpy()] = top.column("n").to_numpy()
    return counts, best


class Held:
    """Counts of the most frequent pairs, and the highest count of each id of B."""

    def __init__(self, pair: np.ndarray, n: np.ndarray, best: np.ndarray):
        order = np.argsort(pair)
        self.pair, self.n, self.best = pair[order], n[order], best


def align_tokens(docs: DataFrame, byte_level: str, pieces: str, most_held: int = MOST_HELD) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of docs.

    `byte_level` (tokenizers, .json) and `pieces` (sentencepiece, .model) are paths on the driver; what
    they hold is broadcast. A text is encoded as blank + text by A and as it is by B, which adds
    the blank itself; strings of special tokens are plain text. Rows whose text is null, empty, or
    not given back by the bytes of its tokens (as where B normalises it) have zeros and an empty
    digest. Repeated rows count each. doc_id may be null and of any type; other columns are ignored;
    no rows give no rows. A task holds one text at a time at least, however long.

    Pairs of ids are counted by Spark over all documents. The driver and each task hold the counts of
    the `most_held` most frequent ones at most; links of rarer pairs are joined with their counts, and
    none of those is hot.
    """
    spark = docs.sparkSession
    found, size_b = aligned(docs, byte_level, pieces)
    found = stored(found, "links", **PACKED)
    counts, best = pair_counts(found, size_b)
    least, all_held = most_frequent(counts, "n", most_held)
    few = counts.where(F.col("n") >= least).toArrow()
    held = shared(spark, Held(*(few.column(c).to_numpy() for c in ("pair", "n")), best))

    def look_up(batches):
        own = held()
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            at = pairs.offsets.to_numpy()
            pair, many = (x.values.to_numpy()[at[0] : at[-1]] for x in (pairs, times))
            of = np.repeat(np.arange(batch.num_rows), np.diff(at))
            place = np.minimum(np.searchsorted(own.pair, pair), max(0, len(own.pair) - 1))
            here = own.pair[place] == pair if len(own.pair) else np.zeros(len(pair), bool)
            count = np.where(here, own.n[place], 0) if len(own.pair) else np.zeros(len(pair), np.int64)
            top = here & (count == own.best[pair % size_b])
            total, n_best = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(total, of, count * many)
            np.add.at(n_best, of, np.where(top, many, 0))
            cut = pa.array(np.append(0, np.cumsum(np.bincount(of[~here], minlength=batch.num_rows))), pa.int32())
            rest = [pa.ListArray.from_arrays(cut, pa.array(x[~here])) for x in (pair, many)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(n_best), pa.array(total), *([] if all_held else rest)], [*names, "n_best", "count_sum", *([] if all_held else ["pairs", "times"])]
            )

    names = ["_row", "doc_id", *NUMBERS, "groups_sha256"]
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema if f.name in names)
    out = small_batches(found.select(*names, "pairs", "times")).mapInArrow(
        look_up, f"{kept}, n_best long, count_sum long" + ("" if all_held else ", pairs array<long>, times array<long>")
    )
    columns = ["doc_id", *NUMBERS, "n_best", "count_sum", "groups_sha256"]
    if all_held:
        return out.select(*columns)
    out = stored(out, "links-held", **PACKED)
    released(spark, found)
    top = F.broadcast(spark.createDataFrame(pa.table({"b": np.arange(size_b), "best": best})))
    rare = counts.where(F.col("n") < least).withColumn("b", F.col("pair") % size_b).join(top, "b")
    each = out.select("_row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair").join(rare, "pair")
    more = each.groupBy("_row").agg(F.sum(F.col("times") * F.col("n")).alias("_sum"), F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("_best"))
    out = out.drop("pairs", "times").join(more, "_row", "left")
    for c, extra in (("n_best", "_best"), ("count_sum", "_sum")):
        out = out.withColumn(c, F.col(c) + F.coalesce(extra, F.lit(0)))
    return out.select(*columns)
