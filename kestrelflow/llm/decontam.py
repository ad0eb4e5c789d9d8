"""Benchmark passages in documents, by the q-gram lemma.

Texts are compared in lower case with every run of other characters than letters and digits as one
blank. A copy of an item of m characters with at most k edits shares at least m - q + 1 - k * q of
its q-grams with the item, on diagonals at most k apart. So hits of the items' q-grams are counted in
overlapping bands of diagonals, bands with enough hits are kept, and each is verified by a banded
alignment of the whole item against that region of the text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelflow.llm.align import banded_edits, stem_cells
from kestrelflow.llm.common import ragged, shared, small_batches, steps, utf8

#: Characters of benchmark text that one broadcast index holds; more is searched in several passes.
BLOCK_CHARS = 8_000_000
BITMAP_BITS = 22
STEP = 1 << 19
#: Hits on a gram of more places than this are done without as far as the lemma allows.
COMMON = 64
#: Pairs of a hit and a place that are counted at once.
AT_ONCE = 1 << 20


class Characters:
    """Normal form of texts, as arrays of code points."""

    def __init__(self):
        low = [chr(i).lower() for i in range(0x10000)]
        self.lower = np.array([ord(c) if len(c) == 1 else i for i, c in enumerate(low)], np.uint32)
        self.word = np.array([chr(i).isalnum() for i in range(0x10000)])

    def normal(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Characters in normal form, each text's first one (and the end), and their places in the texts."""
        chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        first = lead[offsets]
        if len(chars) and chars.max() >= 0x10000:
            small = np.minimum(chars, 0xFFFF)
            word = self.word[small] | (chars >= 0x10000)
            chars = np.where(chars >= 0x10000, chars, self.lower[small])
        else:
            word, chars = self.word[chars], self.lower[chars]
        keep = word.copy()
        keep[1:] |= word[:-1]
        begin = first[:-1][first[:-1] < len(chars)]
        keep[begin] = word[begin]
        place = np.flatnonzero(keep)
        out = np.where(word, chars, np.uint32(32))[place]
        return out, np.searchsorted(place, first), place


def gram_hashes(chars: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every q characters in a row."""
    if len(chars) < q:
        return np.zeros(0, np.uint64)
    base = 0x9E3779B97F4A7C15
    part, size, done, whole = (chars.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), 1, 0, None
    n = len(chars) - q + 1
    left = q
    while left:
        if left & 1:
            piece = part[done : done + n]
            whole = piece.copy() if whole is None else whole * np.uint64(pow(base, size, 1 << 64)) + piece
            done += size
        left >>= 1
        if left:
            part = part[:-size] * np.uint64(pow(base, size, 1 << 64)) + part[size:]
            size *= 2
    return whole * np.uint64(0xBF58476D1CE4E5B9)


#: Items that begin with the same so many characters, at least so many of them, are a group: what they share is looked for once.
STEM, GROUPED = 64, 8
#: Windows that are compared, and pairs of a window and an item that are aligned, at a time.
WINDOWS_AT_ONCE, PAIRS_AT_ONCE = 2048, 1 << 17
NOTHING = [np.zeros(0, np.int64)] * 5


def normal_item(text: str | None, shape: Characters) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    chars, _, _ = shape.normal(data, np.array([0, len(data)]))
    return chars[:-1] if len(chars) and chars[-1] == 32 else chars


class Index:
    """Items and the places of their q-grams. Items with fewer than q characters in normal form are left out.

    Items that begin alike are a group: hits on the grams of their common stem are counted for the
    group, in bands as wide as its most tolerant item needs, and the stem is aligned once for all of
    them; equal stretches of text are looked at once.

    Places of grams that many items share are left out too, of each item at most so many that half of
    the hits the lemma promises are still to come; its threshold is less by the number left out.
    """

    def __init__(self, ids: list, texts: list, q: int, rate: float):
        shape = Characters()
        self.q, parts = q, []
        for item, text in zip(ids, texts, strict=True):
            chars = normal_item(text, shape)
            if len(chars) >= q:
                parts.append((item, chars))
        self.ids = [i for i, _ in parts]
        self.size = np.array([len(c) for _, c in parts], np.int64)
        self.edits = np.minimum((self.size * rate).astype(np.int64), (self.size - q) // q)
        self.least = self.size - q + 1 - self.edits * q
        self.first = np.append(0, np.cumsum(self.size))
        self.chars = np.concatenate([*(c for _, c in parts), np.zeros(0, np.uint32)])
        self._groups([c for _, c in parts])
        grams = [gram_hashes(c, q) for _, c in parts]
        skip = np.where(self.group >= 0, np.append(self.stem, 0)[self.group] - q + 1, 0)  # the stem's own grams
        every = np.concatenate([*(g[n:] for g, n in zip(grams, skip, strict=True)), np.zeros(0, np.uint64)])
        sizes = np.array([len(g) for g in grams], np.int64) - skip
        item = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
        at = np.concatenate([*(np.arange(n, len(g), dtype=np.int32) for g, n in zip(grams, skip, strict=True)), np.zeros(0, np.int32)])
        _, group, places = np.unique(every, return_inverse=True, return_counts=True)
        by_item = np.lexsort((-places[group], item))
        rank = np.empty(len(every), np.int64)
        rank[by_item] = np.arange(len(every)) - np.searchsorted(item, item)[by_item]
        out = (places[group] > COMMON) & (rank < (self.least[item] - 1) // 2)
        self.least -= np.bincount(item[out], minlength=len(parts))
        stems = [grams[m[0]][: n - q + 1] for m, n in zip(self.members, self.stem, strict=True)]
        every, item, at = every[~out], item[~out], at[~out]
        every = np.concatenate([every, *stems])
        item = np.concatenate([item, *(np.full(len(g), len(parts) + k, np.int32) for k, g in enumerate(stems))])
        at = np.concatenate([at, *(np.arange(len(g), dtype=np.int32) for g in stems)])
        self.members = [m[np.argsort(self.least[m], kind="stable")] for m in self.members]
        order = np.argsort(every, kind="stable")
        self.item, self.at = item[order], at[order]
        self.gram, start = np.unique(every[order], return_index=True)
        self.posting = np.append(start, len(every))
        self.bitmap = np.zeros(1 << BITMAP_BITS, bool)
        self.bitmap[self.gram >> np.uint64(64 - BITMAP_BITS)] = True

    def _groups(self, items: list[np.ndarray]) -> None:
        """Each item's group (-1: none), the groups' items and stems, and for items and groups the edits that bands have to leave room for."""
        alike: dict[bytes, list[int]] = {}
        for i, c in enumerate(items):
            if len(c) >= STEM + self.q:
                alike.setdefault(c[:STEM].tobytes(), []).append(i)
        self.members = [np.array(m) for m in alike.values() if len(m) >= GROUPED]
        self.group, stems = np.full(len(items), -1), []
        for g, m in enumerate(self.members):
            self.group[m] = g
            stem = items[m[0]][: min(len(items[i]) for i in m) - 1]
            for i in m:
                differ = np.flatnonzero(items[i][: len(stem)] != stem)
                stem = stem[: differ[0]] if len(differ) else stem
            stems.append(len(stem))
        self.stem = np.array(stems, np.int64)
        most = np.array([self.edits[m].max() for m in self.members], np.int64)
        self.reach = np.append(np.where(self.group >= 0, np.append(most, 0)[self.group], self.edits), most)

    def counted(self, place: np.ndarray, at: np.ndarray, row: np.ndarray):
        """Hits in each (row, item or group, band) as one key, and their counts; bands count from `low` and are `span`."""
        low, span = -int(self.size.max()) - 2, int(self.size.max() + place.max()) + 4
        times = self.posting[at + 1] - self.posting[at]
        ends, a, keys, counts = np.cumsum(times), 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + AT_ONCE, "right")))
            some = times[a:b]
            which = np.repeat(np.arange(a, b), some)
            entry = np.arange(len(which)) - np.repeat(np.cumsum(some) - some, some) + np.repeat(self.posting[at[a:b]], some)
            item = self.item[entry].astype(np.int64)
            diagonal = place[which] - self.at[entry]
            step = self.reach[item] + 1
            band = diagonal // step
            also = diagonal - band * step < self.reach[item]
            pair = row[which] * len(self.reach) + item
            key = np.append(pair * span + band - low, (pair * span + band - low - 1)[also])
            key, count = np.unique(key, return_counts=True)
            keys, back = np.unique(np.append(keys, key), return_inverse=True)
            counts = np.bincount(back, np.append(counts, count), len(keys)).astype(np.int64)
            a = b
        return keys, counts, low, span

    def matches(self, chars: np.ndarray, first: np.ndarray):
        """Arrays (row, item, edits, start, end) in characters of the normal form: each place of an item in a text, several times perhaps."""
        grams = gram_hashes(chars, self.q)
        hit = np.flatnonzero(self.bitmap[grams >> np.uint64(64 - BITMAP_BITS)])
        at = np.minimum(np.searchsorted(self.gram, grams[hit]), max(0, len(self.gram) - 1))
        good = self.gram[at] == grams[hit] if len(self.gram) else np.zeros(len(hit), bool)
        hit, at = hit[good], at[good]
        row = np.searchsorted(first, hit, "right") - 1
        inside = hit + self.q <= first[row + 1]
        hit, at, row = hit[inside], at[inside], row[inside]
        if not len(hit):
            return NOTHING
        key, count, low, span = self.counted(hit - first[row], at, row)
        pair, band = key // span, key % span + low
        row, item = pair // len(self.reach), pair % len(self.reach)
        of = np.append(self.group, np.arange(len(self.members)))[item]
        alone = np.flatnonzero(of < 0)
        alone = alone[count[alone] >= self.least[item[alone]]]
        found = [self._alone(chars, first, row[alone], item[alone], band[alone])]
        for g in np.unique(of[of >= 0]):
            some = np.flatnonzero(of == g)
            found.append(self._of_group(chars, first, int(g), row[some], item[some], band[some], count[some]))
        return [np.concatenate(x) for x in zip(*found, strict=True)]

    def _alone(self, chars, first, row, item, band):
        if not len(row):
            return NOTHING
        k = self.edits[item]
        low = band * (k + 1) - k  # the lowest diagonal looked at
        edits, start, end = banded_edits(chars, first, row, low, 4 * k + 2, self.chars, self.first[item], self.size[item], k)
        return [x[edits <= k] for x in (row, item, edits, start, end)]

    def _of_group(self, chars, first, g, row, item, band, count):
        """Matches of a group's items, from hits of its stem and of its items by themselves in (row, band)."""
        members, reach = self.members[g], int(self.reach[len(self.ids) + g])
        place, of_place = np.unique(np.stack([row, band]), axis=1, return_inverse=True)
        of_place = of_place.ravel()
        stem = np.zeros(place.shape[1], np.int64)
        by_stem = item >= len(self.ids)
        stem[of_place[by_stem]] = count[by_stem]
        own = np.flatnonzero(~by_stem)
        own = own[count[own] + stem[of_place[own]] >= self.least[item[own]]]
        most = np.searchsorted(self.least[members], stem, "right")  # so many of the members need no hits but the stem's
        some = np.flatnonzero((most > 0) | np.isin(np.arange(place.shape[1]), of_place[own]))
        width, length = 4 * reach + 2, int(self.size[members].max()) + 4 * reach + 2
        found = [NOTHING]
        for a in range(0, len(some), WINDOWS_AT_ONCE):
            part = some[a : a + WINDOWS_AT_ONCE]
            rows, low = place[0][part], place[1][part] * (reach + 1) - reach
            j = low[:, None] + np.arange(length)
            there = (j >= 0) & (j < (first[rows + 1] - first[rows])[:, None])
            seen = np.where(there, chars[np.where(there, first[rows][:, None] + j, 0)], np.uint32(0))  # in no normal form
            _, one, window = np.unique(np.ascontiguousarray(seen).view(np.dtype((np.void, seen.itemsize * length))).ravel(), return_index=True, return_inverse=True)
            need = np.zeros(len(one), np.int64)
            np.maximum.at(need, window, most[part])
            inner = own[np.isin(of_place[own], part)]
            pairs = np.concatenate([
                np.repeat(np.arange(len(one)), need) * len(self.ids) + members[ragged(np.zeros(len(need), np.int64), need)],
                window[np.searchsorted(part, of_place[inner])] * len(self.ids) + item[inner],
            ])
            pairs = np.unique(pairs)
            begun = self.first[members[0]]
            cells = stem_cells(chars, first, rows[one], low[one], width, self.chars[begun : begun + self.stem[g]])
            for b in range(0, len(pairs), PAIRS_AT_ONCE):
                w, i = pairs[b : b + PAIRS_AT_ONCE] // len(self.ids), pairs[b : b + PAIRS_AT_ONCE] % len(self.ids)
                k = self.edits[i]
                edits, start, end = banded_edits(chars, first, rows[one][w], low[one][w], np.full(len(w), width), self.chars, self.first[i], self.size[i], k, cells, w, int(self.stem[g]))
                good = np.flatnonzero(edits <= k)
                times = np.bincount(window, minlength=len(one))
                by_window = np.argsort(window, kind="stable")
                at = by_window[ragged((np.cumsum(times) - times)[w[good]], times[w[good]])]  # all places with that window
                which = np.repeat(good, times[w[good]])
                shift = low[at] - low[one][w[which]]
                found.append([rows[at], i[which], edits[which], start[which] + shift, end[which] + shift])
        return [np.concatenate(x) for x in zip(*found, strict=True)]


class ShortItems:
    """Items too short for any edit and for grams: found where all their words stand one after the other."""

    def __init__(self, ids: list, texts: list[np.ndarray]):
        self.ids, self.edits = ids, np.zeros(len(ids), np.int64)
        self.size = np.array([len(t) for t in texts], np.int64)
        self.chars = np.concatenate([*texts, np.zeros(0, np.uint32)])
        self.first = np.append(0, np.cumsum(self.size))
        self.by_length = {}
        for n in np.unique(self.size):
            own = np.flatnonzero(self.size == n)
            hashes = np.concatenate([gram_hashes(texts[i], int(n)) for i in own])
            order = np.argsort(hashes, kind="stable")
            self.by_length[int(n)] = hashes[order], own[order]

    def matches(self, chars: np.ndarray, first: np.ndarray):
        found = [NOTHING]
        blank = np.append(chars == 32, True)
        border = np.zeros(len(chars) + 1, bool)
        border[first] = True
        for n, (hashes, items) in self.by_length.items():
            grams = gram_hashes(chars, n)
            at = np.arange(len(grams))
            at = at[(border[at] | blank[at - 1]) & (border[at + n] | blank[at + n])]
            low, high = np.searchsorted(hashes, grams[at]), np.searchsorted(hashes, grams[at], "right")
            item, at = items[ragged(low, high - low)], np.repeat(at, high - low)
            row = np.searchsorted(first, at, "right") - 1
            same = at + n <= first[row + 1]
            if len(at):
                same &= (chars[at[:, None] + np.arange(n)] == self.chars[self.first[item][:, None] + np.arange(n)]).all(1)
            row, item, at = row[same], item[same], at[same]
            found.append([row, item, np.zeros(len(row), np.int64), at - first[row], at - first[row] + n])
        return [np.concatenate(x) for x in zip(*found, strict=True)]


class Benchmark:
    """Items under indexes that leave each its whole budget of rate * m edits: of q-grams, for short ones of shorter grams, or by words."""

    def __init__(self, ids: list, texts: list, q: int, rate: float):
        shape = Characters()
        sizes = np.array([len(normal_item(t, shape)) for t in texts], np.int64)
        edits = (sizes * rate).astype(np.int64)
        whole = (sizes >= q) & ((sizes - q) // q >= edits)
        words = ~whole & (sizes < q) & (edits == 0) & (sizes > 0)
        rest = ~whole & ~words & (sizes > 0)
        pick = lambda mask, x: [x[i] for i in np.flatnonzero(mask)]
        self.parts: list = [Index(pick(whole, ids), pick(whole, texts), q, rate)]
        if rest.any():
            self.parts.append(Index(pick(rest, ids), pick(rest, texts), max(1, int((sizes[rest] // (edits[rest] + 1)).min())), rate))
        if words.any():
            self.parts.append(ShortItems(pick(words, ids), [normal_item(t, shape) for t in pick(words, texts)]))
        self.ids = [i for p in self.parts for i in p.ids]
        self.size = np.concatenate([p.size for p in self.parts])

    def matches(self, data: np.ndarray, offsets: np.ndarray, shape: Characters):
        """Arrays (row, item, edits, start, end): each item found in a text, at its best place."""
        chars, first, place = shape.normal(data, offsets)
        found, before = [], 0
        for part in self.parts:
            row, item, *rest = part.matches(chars, first)
            found.append([row, item + before, *rest])
            before += len(part.ids)
        row, item, edits, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((start, edits, item, row))
        row, item, edits, start, end = (x[order] for x in (row, item, edits, start, end))
        best = np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])) if len(row) else np.zeros(0, bool)
        row, item, edits, start, end = (x[best] for x in (row, item, edits, start, end))
        begin = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets][row]
        return row, item, edits, place[first[row] + start] - begin, place[first[row] + np.maximum(end, start + 1) - 1] + 1 - begin


def indexes(benchmark: DataFrame, q: int, rate: float):
    """The benchmark as broadcast indexes of bounded size: one, or for a large benchmark several."""
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / BLOCK_CHARS))
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k) if blocks > 1 else items
        rows = sorted(block.collect(), key=lambda r: (str(r.item_id), r.text))
        yield shared(spark, Benchmark([r.item_id for r in rows], [r.text for r in rows], q, rate))


def passages(docs: DataFrame, benchmark: DataFrame, q: int = 12, rate: float = 0.06) -> DataFrame:
    """(doc_id, item_id, edits, item_chars, start, end) of every benchmark item in a document.

    An item of m characters in normal form counts as found with at most rate * m edits; its best place
    is given in characters of the text. Where the lemma leaves no q-gram to look for, shorter grams
    are; an item under q characters that allows for no edit is found where all its words stand one after
    the other. Null and empty items and texts hold and are nothing. All
    rows of docs are searched whole, repeated rows each; ids may be null, other columns are ignored.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    doc, item = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {doc}, item_id {item}, edits long, item_chars long, start long, end long"
    out = None
    for index in indexes(benchmark, q, rate):

        def run(batches, index=index):
            shape, own = Characters(), index()
            for batch in batches:
                data, offsets = utf8(batch.column("text"))
                for i, j in steps(offsets, STEP):
                    a = offsets[i]
                    row, which, edits, start, end = own.matches(data[a : offsets[j]], offsets[i : j + 1] - a, shape)
                    kind = pa.int64() if item == "bigint" else None
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(row + i)), pa.array([own.ids[x] for x in which], kind),
                         pa.array(edits), pa.array(own.size[which]), pa.array(start), pa.array(end)],
                        ["doc_id", "item_id", "edits", "item_chars", "start", "end"],
                    )

        part = small_batches(docs).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, q: int = 12, rate: float = 0.06) -> DataFrame:
    """The rows of docs in whose text no benchmark item is found (see passages); all columns stay."""
    for index in indexes(benchmark, q, rate):

        def run(batches, index=index):
            shape, own = Characters(), index()
            for batch in batches:
                data, offsets = utf8(batch.column("text"))
                clean = np.ones(batch.num_rows, bool)
                for i, j in steps(offsets, STEP):
                    a = offsets[i]
                    clean[own.matches(data[a : offsets[j]], offsets[i : j + 1] - a, shape)[0] + i] = False
                yield batch.filter(pa.array(clean))

        docs = small_batches(docs).mapInArrow(run, docs.schema)
    return docs
