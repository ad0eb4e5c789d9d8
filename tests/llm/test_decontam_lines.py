import random
import re
import time

import numpy as np
import pytest

from kestrelflow.llm import decontam, lines
from kestrelflow.llm.lines import drop_boilerplate
from tests.llm.test_tokens import alternating


def normal(t):
    return " ".join(re.findall(r"[^\W_]+", (t or "").lower()))


def least_edits(item, text):
    """Least edits of the whole item against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_against_full_alignment(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(6, 30)))) for i in range(12)] + [(90, "tiny"), (91, None), (92, "")]

    def edited(text, n):
        chars = list(text)
        for _ in range(n):
            p = rng.randrange(len(chars))
            what = rng.choice("sid")
            chars[p : p + 1] = {"s": ["z"], "i": [chars[p], "z"], "d": []}[what]
        return "".join(chars)

    docs = []
    for d in range(150):
        body = [word() for _ in range(rng.randint(0, 40))]
        if d % 3:
            item = rng.choice(items[:12])[1]
            text = edited(item, rng.choice([0, 0, 1, 2, 3, 5, 8, 12]))
            body.insert(rng.choice([0, len(body), rng.randint(0, len(body))]), text.upper() if d % 2 else text.replace(" ", ",\n "))
        docs.append((d, " ".join(body)))
    docs += [(900, None), (901, ""), (None, items[0][1]), (905, items[1][1]), (905, items[1][1])]
    frame = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, edits int")
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, start string")
    q, rate = 8, 0.08
    wanted = []
    for d, text in docs:
        for i, item in items:
            m = normal(item)
            if len(m) >= q:
                n = least_edits(m, normal(text))
                if n <= int(len(m) * rate):
                    wanted.append((d, i, n))
            elif m and f" {m} " in f" {normal(text)} ":
                wanted.append((d, i, 0))
    found = decontam.passages(frame, bench, q, rate).collect()
    assert sorted(((r.doc_id, r.item_id, r.edits) for r in found), key=str) == sorted(wanted, key=str)
    texts = {d: t for d, t in docs}
    for r in found:
        if r.edits == 0:
            assert normal(texts[r.doc_id][r.start : r.end]) == normal(dict(items)[r.item_id])
    kept = decontam.drop_contaminated(frame, bench, q, rate)
    assert kept.columns == frame.columns
    bad = {d for d, _, _ in wanted}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs if d not in bad)
    assert decontam.passages(frame.limit(0), bench).count() == 0
    assert decontam.drop_contaminated(frame, bench.limit(0)).count() == len(docs)


@pytest.mark.parametrize("q,rate", [(12, 0.06), (8, 0.2)])
def test_items_of_any_length_by_full_alignment(spark, q, rate):
    """Items of 1 to 50 characters: whole budgets of edits, and words where there is no room for any."""
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choices("abcd", k=n))
    items = []
    for m in range(1, 51):
        text = " ".join(letters(5) for _ in range(m // 6 + 1))[:m].strip()
        items.append((m, text.ljust(m, "e")))
    docs = []
    for d in range(120):
        m = rng.randint(1, 50)
        text = list(items[m - 1][1])
        for _ in range(rng.randint(0, int(m * rate) + 1)):
            text[rng.randrange(len(text))] = rng.choice(["x", "", "yz"])
        docs.append((d, " ".join([letters(6), "".join(text), letters(4)])))
    docs += [(500, items[4][1]), (501, items[2][1] + "."), (502, "x" + items[7][1])]
    wanted = []
    for d, text in docs:
        for i, item in items:
            m, t = normal(item), normal(text)
            k = int(len(m) * rate)
            if len(m) < q and not k:
                if f" {m} " in f" {t} ":
                    wanted.append((d, i, 0))
            elif least_edits(m, t) <= k:
                wanted.append((d, i, least_edits(m, t)))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontam.passages(frame, bench, q, rate).collect()
    assert sorted((r.doc_id, r.item_id, r.edits) for r in found) == sorted(wanted) and len(wanted) > 60


def test_items_with_one_stem_by_full_alignment(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 7)))
    stem = " ".join(word() for _ in range(18))
    items = [(i, f"{stem} " + " ".join(word() for _ in range(rng.randint(3, 9)))) for i in range(30)] + [(50, stem + " x"), (51, word() * 12)]
    edited = lambda t, n: "".join(rng.choice(["z", c + c, ""]) if rng.random() < n / len(t) else c for c in t)
    docs = [(d, " ".join([word(), edited(items[d % 31][1], rng.choice([0, 2, 5, 9])), word()])) for d in range(60)]
    docs += [(100, f"{stem} " * 5), (101, f"{stem} {word()} {items[3][1]} {stem}"), (102, items[4][1] + " " + items[4][1])]
    wanted = sorted((d, i, n) for d, t in docs for i, m in items if (n := least_edits(normal(m), normal(t))) <= int(len(normal(m)) * 0.06))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontam.passages(frame, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.edits) for r in found) == wanted and len(wanted) > 30
    texts = dict(docs)
    assert all(normal(texts[r.doc_id][r.start : r.end]) == normal(dict(items)[r.item_id]) for r in found if r.edits == 0)


def test_a_stem_of_many_items_costs_little():
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))
    stem = " ".join(word() for _ in range(35))
    held = decontam.Benchmark(list(range(2000)), [f"{stem} " + " ".join(word() for _ in range(9)) for _ in range(2000)], 12, 0.06)
    data = np.frombuffer((f"{stem} " * 100).encode(), np.uint8)
    began = time.process_time()
    assert len(held.matches(data, np.array([0, len(data)]), decontam.Characters())[0]) == 0
    assert time.process_time() - began < 20


def test_common_grams_and_bounded_steps(spark, monkeypatch):
    """Items that share most of their text: what is left out of the index loses no match."""
    rng = random.Random(12)
    shared, word = "the same preface of every question in this set is rather long ", lambda: "".join(rng.choices("abcdefgh", k=5))
    items = [(i, shared + " ".join(word() for _ in range(8))) for i in range(120)] + [(500, "ab " * 200), (501, "z" * 300)]
    docs = [(i, f"x{i} " + items[i][1].replace(items[i][1][40], "q", 1) + " end") for i in range(0, 120, 5)]
    docs += [(900, shared * 40), (901, "ab " * 5000), (902, "z" * 5000), (903, "z" * 299)]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")

    def found():
        return sorted((r.doc_id, r.item_id, r.edits) for r in decontam.passages(frame, bench).collect())

    one = found()
    assert {d for d, i, _ in one if d == i} == set(range(0, 120, 5)) and {(901, 500, 0), (902, 501, 0), (903, 501, 1)} <= set(one)
    monkeypatch.setattr(decontam, "COMMON", 10**9)
    index = decontam.Index([0], [items[0][1]], 12, 0.06)
    monkeypatch.setattr(decontam, "AT_ONCE", 50)
    assert found() == one
    monkeypatch.setattr(decontam, "COMMON", 0)
    fewer = decontam.Index([0], [items[0][1]], 12, 0.06)
    assert 0 < len(fewer.at) < len(index.at) and fewer.least[0] == index.least[0] - (len(index.at) - len(fewer.at)) > 0


def test_several_blocks_find_the_same(spark, sf_dir, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(decontam.passages(docs, bench).collect())
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 2000)
    assert one and sorted(decontam.passages(docs, bench).collect()) == one


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_lines_edge_cases(spark, monkeypatch, most):
    monkeypatch.setattr(lines, "MOST_LISTED", most)
    rows = [(1, "a", "menu\nx\n\nmenu"), (2, "a", "menu\ny"), (3, "a", "menu"), (4, "a", None), (5, "a", ""), (6, "b", "menu\nx"),
            (7, None, "foot\n1"), (8, None, "foot\n2"), (9, None, "foot\n3"), (9, None, "foot\n3"), (10, "a", "MENU\nlong " * 20000)]
    frame = spark.createDataFrame([(*r, 7, "h", "d") for r in rows], "doc_id long, source string, text string, n_lines int, host string, _of string")
    out = drop_boilerplate(frame, percent=40)
    assert out.columns == ["doc_id", "source", "text", "host", "_of", "n_lines", "n_dropped"]
    got = sorted((r.doc_id, r.text if r.doc_id < 10 else None, r.n_lines, r.n_dropped) for r in out.collect())
    wanted = [(1, "x\n", 3, 2), (2, "y", 2, 1), (3, "", 1, 1), (4, None, 0, 0), (5, "", 0, 0), (6, "menu\nx", 2, 0), (7, "1", 2, 1)]
    assert got == [*wanted, (8, "2", 2, 1), (9, "3", 2, 1), (9, "3", 2, 1), (10, None, 20001, 0)]
    assert drop_boilerplate(frame.limit(0)).count() == 0


def test_lines_that_a_polynomial_hash_takes_for_one_another(spark):
    one, two = alternating("t", "h", 1024)
    frame = spark.createDataFrame([(i, "a", f"{one}\nx{i}") for i in range(6)] + [(9, "a", two)], "doc_id long, source string, text string")
    got = {r.doc_id: r.text for r in drop_boilerplate(frame).collect()}
    assert got == {i: f"x{i}" for i in range(6)} | {9: two}
