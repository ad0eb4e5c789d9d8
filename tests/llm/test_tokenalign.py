import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from kestrelflow.llm.tokenalign import align_tokens
from kestrelflow.llm.tokens import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def encoded(texts):
    """Per text the (id, start, end) of both sides, or None."""
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte = {c: k for k, c in byte_letters().items()}
    for text in texts:
        if not text:
            yield None
            continue
        raw, sides = (" " + text).encode(), []
        ids = a.encode(" " + text, add_special_tokens=False).ids
        sides.append([(i, bytes(byte[c] for c in a.id_to_token(i))) for i in ids])
        ids = b.encode(text)
        sides.append([(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in ids])
        out = []
        for side in sides:
            at, spans = 0, []
            for i, piece in side:
                spans.append((i, at, at + len(piece)))
                at += len(piece)
            out.append(spans)
        yield out if all(b"".join(p for _, p in side) == raw for side in sides) else None


def brute(rows):
    count, each = Counter(), []
    for found in encoded([t for _, t in rows]):
        links = [(x[0], y[0]) for x in found[0] for y in found[1] if x[1] < y[2] and y[1] < x[2]] if found else []
        count.update(links)
        each.append((found, links))
    best: dict = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    for (doc, _), (found, links) in zip(rows, each, strict=True):
        if not found:
            yield (doc, 0, 0, 0, 0, 0, 0, "")
            continue
        ends = sorted({e for *_, e in found[0]} & {e for *_, e in found[1]})
        groups, low = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(i) for i, s, _ in side if low <= s < e) for side in found))
            low = e
        yield (doc, len(found[0]), len(found[1]), len(ends), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links),
               hashlib.sha256(";".join(groups).encode()).hexdigest())


PARTS = ["the ", "international", "Zürich ", "naïve", " 12345 ", "\n", "\t", "  ", "don't ", "中文字", "😀👍🏽", "é́", "▁", "<s>", "<0x41>", "<|endoftext|>", "‍", "aaaa", "...", "of a ", "ﬁ", "\x00", "x" * 40]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(1, 25))) for _ in range(150)]
    texts += ["plain words of a text " * rng.randint(1, 9) for _ in range(20)] + [None, "", " ", "a", "▁x", "ab" * 3000]
    return [*enumerate(texts), (None, "hi there"), (1, "hi there"), (1, "hi there")]


@pytest.mark.parametrize("held", [1 << 20, 40, 0])
def test_against_all_pairs_of_tokens(spark, rows, held):
    frame = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, pairs int").repartition(3)
    found = align_tokens(frame, A, B, held)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(brute(rows), key=repr)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = {r["doc_id"]: tuple(r) for r in align_tokens(docs, A, B).collect()}
    some = [(r["doc_id"], r["text"]) for r in docs.collect()]
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    assert len(found) == len(some) and sum(n[1] > 0 for n in found.values()) > 100
    for doc, text in some:
        if found[doc][1]:
            assert found[doc][1:3] == (len(a.encode(" " + text, add_special_tokens=False).ids), len(b.encode(text)))
            assert found[doc][4] == found[doc][1] + found[doc][2] - found[doc][3]
    assert align_tokens(docs.limit(0), A, B).count() == 0
