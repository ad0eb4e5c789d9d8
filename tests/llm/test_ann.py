import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kestrelflow.llm import ann


def brute(rows, step, k):
    good = sorted({(i, tuple(map(float, e))) for i, e in rows if i is not None and e and None not in e and all(map(math.isfinite, e)) and any(e)})
    out = {}
    for q, v in good:
        if q % step == 0:
            best = {}
            for i, e in good:
                if i != q:
                    s = sum(a * b for a, b in zip(v, e, strict=True)) / (math.sqrt(sum(a * a for a in v)) * math.sqrt(sum(b * b for b in e)))
                    best[i] = max(best.get(i, -9), s)
            for i, s in best.items():
                out.setdefault(q, {})[i] = max(s, out.get(q, {}).get(i, -9))
    return {q: sorted(((i, s) for i, s in b.items()), key=lambda x: (-round(x[1], 12), x[0]))[:k] for q, b in out.items()}


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_on_the_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    x = np.array([e for _, e in rows], float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got, hits, total = found(ann.nearest(frame, F.col("vec_id") % 50 == 0, k=5)), 0, 0
    for n, (i, _) in enumerate(rows):
        if i % 50 == 0:
            order = [rows[j][0] for j in np.argsort(-(unit @ unit[n]), kind="stable") if j != n][:5]
            hits += len(set(order) & {v for v, _ in got[i]})
            total += 5
            assert len(got[i]) == 5
            for v, s in got[i]:
                assert abs(s - unit[n] @ unit[[r[0] for r in rows].index(v)]) < 1e-9
    assert hits / total >= 0.95, hits / total


@pytest.mark.parametrize("clusters", [1, 60])
def test_recall_over_many_cells(spark, clusters):
    """At the settings of the query, but for smaller cells and blocks; without clusters and with."""
    rng = np.random.default_rng(clusters)
    middle = rng.normal(size=(clusters, 24)) * (clusters > 1) * 1.5
    x = middle[rng.integers(0, clusters, 30_000)] + rng.normal(size=(30_000, 24))
    frame = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))}))
    got = found(ann.nearest(frame, F.col("vec_id") % 100 == 0, k=5, again=64, block=1024, cell=1000))
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hits = 0
    for n in range(0, len(x), 100):
        near = unit @ unit[n]
        near[n] = -2
        hits += len(set(np.argsort(-near)[:5].tolist()) & {v for v, _ in got[n]})
    assert len(got) == 300 and hits / 1500 >= 0.93, hits / 1500
    cells = ann.Cells(unit[:8192], 30, 5)
    assert len(cells.centre) == 30 and (cells.probes < 15 if clusters > 1 else cells.probes > 3)


@pytest.mark.parametrize("shape", ["near copies", "many dimensions"])
def test_codes_lose_no_neighbour(spark, shape):
    """Vectors that codes can't tell apart, at the settings of the query."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 16 if shape == "near copies" else 256))
    if shape == "near copies":
        x[1500:] = x[0] + 1e-3 * x[1500:]
    x = x.astype(np.float32)
    frame = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    got = found(ann.nearest(frame, F.col("vec_id") % 100 == 0, k=5))
    unit = x / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    for n in range(0, len(x), 100):
        near = unit @ unit[n]
        near[n] = -2
        assert set(np.argsort(-near)[:5].tolist()) == {v for v, _ in got[n]}


def test_cells_are_wide_enough_for_queries_unlike_other_rows():
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(40, 32))
    x = middle[rng.integers(0, 40, 4000)] + 0.01 * rng.normal(size=(4000, 32))
    x, asked = (y / np.linalg.norm(y, axis=1, keepdims=True) for y in (x, rng.normal(size=(200, 32))))
    assert ann.Cells(x, 40, 5, queries=asked).probes > ann.Cells(x, 40, 5).probes


def test_very_large_and_very_small_vectors(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e-200, 1.1e-200]), (3, [1.0, -1.0]), (4, [3e-200, 0.0])]
    got = found(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 1))
    assert [i for i, _ in got[1]] == [2, 4, 3] and abs(got[1][1][1] - math.sqrt(0.5)) < 1e-12


def test_blocks_ties_and_odd_rows(spark, monkeypatch):
    rng = random.Random(2)
    same = [rng.uniform(-1, 1) for _ in range(8)]
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(1, 120)]
    rows += [(i, same) for i in (200, 201, 202, 203, 204, 205, 206, 207, 208, 0)] + [(0, same), (150, None), (151, [0.0] * 8), (152, [1.0, None] + [0.0] * 6)]
    rows += [(153, [float("nan")] + [1.0] * 7), (154, [float("inf")] + [1.0] * 7), (None, same), (155, [1.0, 2.0]), (300, [2 * x for x in rows[4][1]])]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, rank int, block string")
    wanted = brute([r for r in rows if not r[1] or len(r[1]) == 8], 10, 5)
    monkeypatch.setattr(ann.Cells.__init__, "__defaults__", (1.0, 512, 8, 2))
    for block, cell in ((1000, 8192), (16, 8192), (7, 30)):
        got = found(ann.nearest(frame, F.col("vec_id") % 10 == 0, k=5, again=1000, block=block, cell=cell))
        assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in wanted.items()}
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert found(ann.nearest(few, F.col("vec_id") == 1)).keys() == {1} and len(found(ann.nearest(few, F.col("vec_id") == 1))[1]) == 2
    assert ann.nearest(few.limit(0), F.col("vec_id") == 1).count() == 0
