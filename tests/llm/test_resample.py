import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from kestrelflow.llm import queries
from kestrelflow.llm.resample import features, resample
from tests.oracle import connect, same


def runs_of(text, most):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, percent, most, buckets, least, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in runs_of(t, most)[1])
    t = Counter(bucket(f) for x in target for f in runs_of(x, most)[1])
    gain = {
        b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + buckets) / ((s[b] + 1.0) * (t.total() + buckets)))) for b in range(buckets)
    }
    rows = []
    for d, x in docs:
        words, found = runs_of(x, most)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
        score = None if d is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([d, len(found), weight, score, len(words)])
    able = sorted((r for r in rows if r[4] >= least and r[0] is not None), key=lambda r: (-r[3], r[0], r[1], r[2]))
    rank = {id(r): i + 1 for i, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=repr)


def some_texts(n, seed):
    rng = random.Random(seed)
    parts = ["the", "The", "of", "a1", "é", "Ünder", "中文", "x" * 30, "b", "c"]
    return ["".join(rng.choice(parts) + rng.choice([" ", ", ", "\n", "_", "\x00", "́ "]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("most", [1, 3])
def test_against_brute_force(spark, most):
    docs = list(enumerate(some_texts(200, 1))) + [(900, None), (901, ""), (902, "?!"), (None, "the of a1 " * 20), (5, "twice " * 30), (5, "twice " * 30)]
    target = [*some_texts(20, 2), None, ""]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, score int").repartition(5)
    wanted = brute(docs, target, 30, most, 500, 8, 7)
    found = resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), 30, most, 500, 8, 7)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == wanted


def test_pieces_of_any_size_give_the_same_features():
    texts = [t.encode() for t in some_texts(30, 3)] + [b"", b"y" * 500, b"", b"a b c d"]
    whole = [Counter() for _ in texts]
    for i, t in enumerate(texts):
        whole[i].update(zlib.crc32(f.encode()) % 997 for f in runs_of(t.decode(), 3)[1])
    for piece in (1, 7, 64, 1 << 20):
        found = [Counter() for _ in texts]
        for of, bucket, _ in features(texts, 3, 997, piece):
            for i, b in zip(of.tolist(), bucket.tolist(), strict=True):
                found[i][b] += 1
        assert found == whole


def test_many_ties_and_empty_tables(spark):
    docs = spark.createDataFrame([(i % 40, "same words here " * 8) for i in range(400)], "doc_id long, text string")
    target = spark.createDataFrame([], "text string")
    found = resample(docs, target).collect()
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 41))
    assert len({r["doc_id"] for r in found if r["rank"]}) == 4  # rows of one id tie
    assert resample(docs.limit(0), target).count() == 0


def test_query_as_sql(spark, sf_dir):
    assert same(queries.op11_resample(spark, sf_dir), connect(sf_dir), queries.RESAMPLE_SQL) > 0
