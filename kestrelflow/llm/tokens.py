"""Token counts of a byte-level BPE vocabulary, by rank-synchronous merging of ragged arrays.

Texts are cut into pre-tokens with array operations over their characters' classes. Each distinct
pre-token of a batch is a row of a ragged array of symbols; in every round each row applies its
lowest-ranked pair wherever it stands (from the left, without overlap), until no row has a pair.
The symbols left are its tokens. A merge only ever makes pairs of higher rank than its own, so this
gives what merging one pair at a time gives.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelflow.llm.common import same_spans, shared, small_batches, span_hashes, steps, utf8

NONE = np.iinfo(np.int32).max
OTHER, LETTER, NUMBER, SPACE = range(4)
STEP = 4 << 20

#: Letters and numbers of newer Unicode versions than the tokenizer library's, for which it takes neither.
NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D),
    (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB),
    (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8),
    (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24),
    (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5),
    (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)


def character_classes() -> np.ndarray:
    """For every code point: letter, number, white space or other."""
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    text = "".join(map(chr, points))
    table = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, text):
            table[ord(text[m.start()]) : ord(text[m.end() - 1]) + 1] = kind
    table[0xD800:0xE000] = OTHER
    for a, b in NEWER:
        table[a : b + 1] = OTHER
    return table


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*printable}))}


class Merges:
    """The merge table of a vocabulary file of the tokenizers library, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or spec["normalizer"] or pre["add_prefix_space"]:
            raise ValueError(f"{path} is not a byte-level BPE vocabulary without a normaliser or prefix space")
        shown = byte_letters()
        vocab = model["vocab"]
        self.size = max(vocab.values()) + 1
        self.byte = np.array([vocab[shown[b]] for b in range(256)], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.order = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.order]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        letter = {c: b for b, c in shown.items()}
        self.bytes = [b""] * self.size
        for token, i in vocab.items():
            self.bytes[i] = bytes(letter[c] for c in token) if all(c in letter for c in token) else token.encode()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.classes = character_classes()

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NONE)

    def symbols_left(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keep: list | None = None) -> np.ndarray:
        """How many symbols remain of each byte string data[start : start + length] (none of them empty).

        `keep` gets pairs of arrays: the strings' numbers and the symbols that remain of them, in order within each string.
        """
        row = np.repeat(np.arange(len(lengths)), lengths)
        first = np.append(0, np.cumsum(lengths))
        symbols = self.byte[data[np.arange(first[-1]) - first[:-1][row] + starts[row]]]
        last = np.append(row[1:] != row[:-1], True)
        rank = np.full(len(row), NONE, np.int64)
        inner = np.flatnonzero(~last)
        rank[inner] = self.ranks(symbols[inner], symbols[inner + 1])
        left = np.ones(len(lengths), np.int64)
        while len(row):
            begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            sizes = np.diff(np.append(begin, len(row)))
            best = np.minimum.reduceat(rank, begin)
            over = best == NONE
            left[row[begin[over]]] = sizes[over]
            if keep is not None:
                done = np.repeat(over, sizes)
                keep.append((row[done], symbols[done]))
            lowest = np.repeat(best, sizes)
            hit = (rank == lowest) & (lowest != NONE)
            beside = hit[1:] & hit[:-1]
            if beside.any():  # in a run of hits, as in "aaa", every other one merges
                at = np.arange(len(hit))
                run = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), at, 0))
                hit &= (at - run) % 2 == 0
            where = np.flatnonzero(hit)
            symbols[where] = self.made[rank[where]]
            stay = np.repeat(~over, sizes)
            stay[where + 1] = False
            fresh = np.zeros(len(row), bool)
            fresh[where] = True
            row, symbols, rank, fresh = row[stay], symbols[stay], rank[stay], fresh[stay]
            if not len(row):
                break
            fresh[:-1] |= fresh[1:]
            last = np.append(row[1:] != row[:-1], True)
            rank[fresh & last] = NONE
            again = np.flatnonzero(fresh & ~last)
            rank[again] = self.ranks(symbols[again], symbols[again + 1])
        return left


def token_starts(chars: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """First characters of all pre-tokens of texts that lie one behind the other.

    These are runs of letters, of numbers or of other characters, each with one blank before it; the
    contractions 's 't 're 've 'm 'll 'd; and runs of white space, whose last character, if text
    follows, stands alone or goes with that text. `first`: each text's first character, and the end.
    """
    n = len(chars)
    if not n:
        return np.zeros(0, np.int64)
    kind = np.append(classes[chars], 255)
    begins = np.zeros(n + 1, bool)
    begins[first] = True
    text_begins = begins.copy()
    begins[1:n] |= kind[1:n] != kind[: n - 1]
    start = begins[:n].copy()
    padded = np.append(chars, np.zeros(3, chars.dtype))
    # The last white space before text starts a token; after a blank, the text itself doesn't.
    follows = np.flatnonzero(begins[1:n] & ~text_begins[1:n] & (kind[: n - 1] == SPACE)) + 1
    start[follows - 1] = True
    start[follows[chars[follows - 1] == 0x20]] = False
    # Contractions.
    quote = np.flatnonzero((chars == 0x27) & begins[:n])
    quote = quote[start[quote] & (kind[quote + 1] == LETTER) & ~text_begins[quote + 1]]
    if len(quote):
        a, b = padded[quote + 1], padded[quote + 2]
        b = np.where(text_begins[np.minimum(quote + 2, n)], 0, b)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        some = one | two
        start[quote[some] + 1] = False
        behind = quote[some] + np.where(one[some], 2, 3)
        start[behind[behind < n]] = True
    return np.flatnonzero(start)


def counter(merges: Merges, most_known: int = 1_000_000, hashes=span_hashes):
    """A function that gives the token count of each text of a column.

    It remembers pre-tokens with their bytes, under their hashes; one counts as known only if all its
    bytes are equal.
    """
    known, known_count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    held, held_at, held_size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def plain(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        nonlocal known, known_count, held, held_at, held_size
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        starts = lead[token_starts(chars, np.searchsorted(lead, offsets), merges.classes)] if len(lead) else lead
        if not len(starts):
            return np.zeros(len(offsets) - 1, np.int64)
        lengths = np.diff(np.append(starts, len(data)))
        each, where, back = np.unique(hashes(data, starts, lengths), return_index=True, return_inverse=True)
        begin, size = starts[where], lengths[where]
        at = np.minimum(np.searchsorted(known, each), max(0, len(known) - 1))
        taken = known[at] == each if len(known) else np.zeros(len(each), bool)
        found = np.flatnonzero(taken)
        found = found[same_spans(data, begin[found], size[found], held, held_at[at[found]], held_size[at[found]])]
        counts = np.zeros(len(each), np.int64)
        counts[found] = known_count[at[found]]
        new = np.ones(len(each), bool)
        new[found] = False
        counts[new] = merges.symbols_left(data, begin[new], size[new])
        per_token = counts[back]
        other = np.flatnonzero(~same_spans(data, starts, lengths, data, begin[back], size[back]))
        if len(other):  # equal hashes, other bytes
            per_token[other] = merges.symbols_left(data, starts[other], lengths[other])

        keep = np.flatnonzero(~taken)
        if len(known) > most_known or len(held) > 16 * most_known:
            known, known_count, held_at, held_size, held, keep = known[:0], known_count[:0], held_at[:0], held_size[:0], held[:0], np.arange(len(each))
        if len(keep):
            inner = np.arange(size[keep].sum()) - np.repeat(np.cumsum(size[keep]) - size[keep], size[keep])
            both, values = np.concatenate([known, each[keep]]), np.concatenate([known_count, counts[keep]])
            ends = len(held) + np.cumsum(size[keep])
            held = np.concatenate([held, data[inner + np.repeat(begin[keep], size[keep])]])
            held_at, held_size = np.concatenate([held_at, ends - size[keep]]), np.concatenate([held_size, size[keep]])
            order = np.argsort(both, kind="stable")
            known, known_count, held_at, held_size = both[order], values[order], held_at[order], held_size[order]
        total = np.append(0, np.cumsum(per_token))
        return np.diff(total[np.searchsorted(starts, offsets)])

    special = regex.compile("|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True))).encode()) if merges.special else None

    def count(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """As plain, with each special string a token of its own that cuts the text."""
        raw = data.tobytes() if special else b""
        if not special or not special.search(raw):
            return plain(data, offsets)
        cuts, rows, specials = [0], [], np.zeros(len(offsets) - 1, np.int64)
        pieces = []
        for r in range(len(offsets) - 1):
            at, end = int(offsets[r]), int(offsets[r + 1])
            for m in special.finditer(raw, at, end):
                pieces.append(raw[at : m.start()])
                rows.append(r)
                specials[r] += 1
                at = m.end()
            pieces.append(raw[at:end])
            rows.append(r)
        cuts = np.append(0, np.cumsum([len(p) for p in pieces])).astype(np.int64)
        return specials + np.bincount(rows, plain(np.frombuffer(b"".join(pieces), np.uint8), cuts), len(offsets) - 1).astype(np.int64)

    def column(texts: pa.Array) -> np.ndarray:
        data, offsets = utf8(texts)
        parts = [count(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in steps(offsets, STEP)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    return column


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs, repeated rows included.

    `vocabulary` is a path on the driver; its arrays, of a fixed size, are broadcast. Null texts
    count as empty: 0 bytes, 0 tokens. doc_id may be null; other columns are ignored.
    """
    merges = shared(docs.sparkSession, Merges(vocabulary))

    def run(batches):
        count = counter(merges())
        for batch in batches:
            text = pc.fill_null(batch.column("text"), "")
            n = pa.array(count(text), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.binary_length(text).cast(pa.int64()), n, pc.greater(n, limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return small_batches(rows).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
