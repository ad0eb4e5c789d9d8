import random
import re
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kestrelflow.llm import licenses, toxicity


def fewest_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_licenses_against_full_alignment(spark):
    rng = random.Random(8)
    split = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    docs = []
    for i in range(60):
        words = [rng.choice(["alpha", "été", "the", "license", "under", "software"]) for _ in range(rng.randint(0, 30))]
        if i % 4:
            notice = rng.choice(list(licenses.TEMPLATES.values())).split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                notice[rng.randrange(len(notice))] = rng.choice(["foo", "bar baz"])
            words[rng.randint(0, len(words)) : 0] = notice if i % 3 else [w.upper() + "," for w in notice]
        docs.append((i, " ".join(words)))
    docs += [(100, None), (101, ""), (None, "All rights\nreserved"), (102, "x " * 50000 + "Released under the MIT license")]
    frame = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, license string")
    out = licenses.scan_licenses(frame).collect()
    got = {(r.doc_id, r.license): r.edits for r in sorted(out, key=lambda r: -r.edits)}
    index = licenses.TemplateIndex(licenses.TEMPLATES)
    for d, text in docs[:63]:
        for n, name in enumerate(index.names):
            m = split(licenses.TEMPLATES[name])
            best = fewest_edits(m, split(text))
            if best <= index.edits[n]:
                assert got.get((d, name)) == best, (d, name, best, got.get((d, name)))
            elif best > index.edits[n]:
                assert (d, name) not in got
    texts = dict(docs)
    for r in out:
        if r.edits == 0:
            assert split(texts[r.doc_id][r.start : r.end]) == split(licenses.TEMPLATES[r.license])
    assert (102, "MIT-line") in got and (None, "all-rights-reserved") in got
    assert licenses.scan_licenses(frame.limit(0)).count() == 0


def test_any_edit_within_the_budget_is_found():
    index, hasher, rng = licenses.TemplateIndex(licenses.TEMPLATES), licenses.WordHasher(licenses.not_letter()), random.Random(5)
    for n, name in enumerate(index.names):
        words = re.findall("[A-Za-z0-9]+", licenses.TEMPLATES[name])
        k = int(index.edits[n])
        for _ in range(40):
            changed = list(words)
            for p in sorted(rng.sample(range(len(words)), k), reverse=True):
                changed[p : p + 1] = rng.choice([["zz"], [], [changed[p], "zz"]])
            data = np.frombuffer(("pad text " + " ".join(changed) + " more").encode(), np.uint8)
            row, item, edits, _, _ = index.scan(data, np.array([0, len(data)]), hasher)
            assert n in item[edits <= k], (name, changed)


def test_many_notices_in_one_text():
    index, hasher = licenses.TemplateIndex(licenses.TEMPLATES), licenses.WordHasher(licenses.not_letter())
    data = np.frombuffer(b"Released under the MIT License. " * 100_000, np.uint8)
    begun = time.monotonic()
    row, item, edits, start, end = index.scan(data, np.array([0, len(data)]), hasher)
    assert len(row) == 100_000 and not edits.any() and start.tolist() == list(range(0, len(data), 32)) and set(end - start) == {30}
    assert time.monotonic() - begun < 20


def test_spans_of_a_group_stay_apart():
    rng = np.random.default_rng(6)
    for _ in range(50):
        n = int(rng.integers(0, 60))
        group, edits, start = rng.integers(0, 3, n), rng.integers(0, 4, n), rng.integers(0, 80, n)
        end, kept = start + rng.integers(1, 12, n), []
        for r in np.lexsort((end, start, edits)):
            if all(group[r] != group[x] or end[r] <= start[x] or start[r] >= end[x] for x in kept):
                kept.append(r)
        assert sorted(licenses.apart(group, edits, start, end).tolist()) == sorted(kept)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    toxic = [r for r in rows if r.toxic == 1]
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.85
    assert sum(r.predicted for r in rows if r.toxic == 0) / (len(rows) - len(toxic)) < 0.01


def test_held_out_rows_and_other_columns_change_nothing(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    fold = toxicity.held_out(F.col("doc_id"))
    other = labels.withColumn("toxic", F.when(fold, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = toxicity.fit(docs, labels)
    b = toxicity.fit(docs.repartition(5).withColumn("lang", F.lit("x")), other.unionByName(other))
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def learnt(rows, penalty):
    features, ids, sizes, toxic, version = toxicity.Features(), [], [], [], []
    for text, label in rows:
        for k, t in enumerate([text, *toxicity.swapped(text)]):
            ids.append(np.unique(next(iter(features.of_column(pa.array([t]))))[1]))
            sizes.append(len(ids[-1]))
            toxic.append(label)
            version.append(k)
    model = toxicity.train(np.concatenate(ids), np.array(sizes), np.array(toxic), np.array(version), penalty)
    return lambda texts: model.scores(pa.array(texts), features)


def test_the_penalty_spares_neutral_mentions():
    """One group is named in most toxic texts and in few others; mentions of it aren't toxic by themselves."""
    assert toxicity.swapped("Muslim men") == ["christian women", "atheist women"] and toxicity.swapped("none here") == []
    rng = random.Random(9)
    plain = [f"word{i}" for i in range(40)]
    some = lambda *more: " ".join(rng.sample(plain, 6) + [*more])
    insults = ["scum", "vermin", "filth", "trash", "idiots", "morons"]
    rows = [(some("muslim", rng.choice(insults)) if i % 4 else some("muslim"), 1) for i in range(120)]
    rows += [(some("christian") if i % 9 == 0 else some(), 0) for i in range(400)] + [(some("muslim"), 0) for _ in range(4)]
    free, held = learnt(rows, 0.0), learnt(rows, 30.0)
    neutral, toxic = [some("muslim") for _ in range(200)], [some(rng.choice(insults), t) for t in ("muslim", "christian") for _ in range(100)]
    assert (free(neutral) >= 0.5).sum() > 100
    assert (held(neutral) >= 0.5).sum() < 10
    assert (held(toxic) >= 0.5).mean() > 0.9
    gap = lambda m: float(np.abs(m(["a muslim came"]) - m(["a christian came"]))[0])
    assert gap(held) < 0.5 * gap(free)


def test_ids_that_come_twice(spark):
    rows = [(i, "you idiot" if i % 2 else "good day", i % 2) for i in range(100)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(i, f"other text {i} muslim") for i in range(0, 100, 3)] + [(1, "you idiot" * 9000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(7, 0), (8, 0)], "doc_id long, toxic int")
    got = toxicity.sample(docs, labels).collect()
    ids = [r.doc_id for r in got]
    assert len(ids) == len(set(ids)) and 7 not in ids and max(len(r.text) for r in got) < 100
    assert sorted(toxicity.sample(docs.repartition(7), labels.repartition(3)).collect()) == sorted(got)
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs.repartition(5), labels)
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_odd_rows(spark):
    rows = [(i, "you idiot" if i % 2 else "good day", i % 2) for i in range(200)]
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(300, None, "s"), (301, "", "s"), (None, "you idiot", "s"), (1, "you idiot", "s"), (302, "word " * 200000 + "idiot", "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, "z") for i, _, y in rows] + [(None, 1, "z"), (5, None, "z"), (999, 1, "z")], "doc_id long, toxic int, text string")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model).collect()
    assert len(out) == 205 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert sum(r.predicted for r in out) >= 102
    assert {r.doc_id: r.held_out for r in out}[None] is False
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, none).where("predicted = 1").count() == 0
    assert toxicity.score(docs.limit(0), model).count() == 0
