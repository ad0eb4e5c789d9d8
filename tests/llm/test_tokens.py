import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from kestrelflow.llm.common import WordHasher, ascii_space
from kestrelflow.llm.tokens import NEWER, Merges, counter, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def merges():
    return Merges(PATH)


def library(texts):
    return [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_whole_table_as_the_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    found = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, PATH).collect()}
    wanted = dict(zip(texts, library(list(texts.values())), strict=True))
    assert found == {d: (len(t.encode()), wanted[d], wanted[d] > 512) for d, t in texts.items()}


def test_every_character_and_random_mixtures(merges):
    count = counter(merges)
    random.seed(5)
    texts = ["a" + chr(c) + "1" + chr(c) + "! " + chr(c) * 2 for c in [*range(0x3000), *(a for a, _ in NEWER), *(b for _, b in NEWER)]]
    parts = ["'s", "'", "'re", "'l", "'ll", "don't", " ", "  ", "\n", "\t", " ", "　", "é", "ß", "1", "23", "!", "...", "a", "the", "The",
             "aaaa", "😀", "<|endoftext|>", "<|endoftext", "\x1c", "\x85", "中文", "'ve's", "_", "'D", "x" * 50]
    texts += ["".join(random.choices(parts, k=random.randint(0, 30))) for _ in range(20000)]
    assert count(pa.array(texts)).tolist() == library(texts)


def test_long_and_empty_texts(spark, merges):
    rng = random.Random(1)
    texts = ["ab" * 30000, "".join(rng.choices("abcdefgh", k=40000)), " " * 10000 + "x", "", None, "word " * 300000]
    rows = [(i, t, "k") for i, t in enumerate(texts)] + [(None, "hi", "k"), (1, "hi", "k"), (1, "hi", "k")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens) for r in token_counts(frame, PATH).collect())
    assert found == sorted((i if i is not None else -1, n) for (i, _, _), n in zip(rows, library([t or "" for _, t, _ in rows]), strict=True))
    assert token_counts(frame.limit(0), PATH).count() == 0


def alternating(a, b, size):
    """The word whose i-th letter is a or b by the parity of the ones of i, and its opposite."""
    bits = [bin(i).count("1") % 2 for i in range(size)]
    return "".join(a if x else b for x in bits), "".join(b if x else a for x in bits)


def test_words_that_a_polynomial_hash_takes_for_one_another(merges):
    count = counter(merges)
    texts = [w for pair in ("th", "er", "in", "ou", "xs") for size in (1024, 2048, 4096) for w in alternating(*pair, size)]
    assert count(pa.array(texts)).tolist() == library(texts)
    hasher = WordHasher(ascii_space())
    for text in texts[::2]:
        data = np.frombuffer(" ".join([text, *alternating(text[0], "q", len(text))]).encode(), np.uint8)
        assert len(set(hasher.words(data, np.array([0, len(data)]))[0].tolist())) == 3


def test_equal_hashes_of_other_bytes_are_told_apart(merges):
    weak = lambda data, starts, lengths: (lengths % 2).astype(np.uint64)
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["the", "international", "x", "qzvw", "a" * 40, "aaab" * 11], k=rng.randint(0, 12))) for _ in range(300)]
    count = counter(merges, hashes=weak)
    for _ in range(2):  # the second time against what is remembered
        assert count(pa.array(texts)).tolist() == library(texts)
    few = counter(merges, most_known=10)
    assert sum((few(pa.array(texts[i : i + 20])).tolist() for i in range(0, 300, 20)), []) == library(texts)


def test_spans_at_the_borders_of_texts():
    hasher = WordHasher(ascii_space())
    data = np.frombuffer(b"ab cdAB abc\x00abc", np.uint8)
    offsets = np.array([0, 0, 5, 7, 7, 15, 15])
    words, starts, first = hasher.words(data, offsets)
    assert starts.tolist() == [0, 3, 5, 8] and first.tolist() == [0, 0, 2, 3, 3, 4, 4]
    assert words[0] == words[2] and len(set(words.tolist())) == 3
    assert hasher.words(data[:0], np.array([0, 0]))[2].tolist() == [0, 0]
