from collections import Counter

import corpus_pipeline
from kestrelflow.llm import toxicity
from tests.llm.test_decontam_lines import normal
from tests.llm.test_neardup import brute


def test_rows_as_by_brute_force(spark, sf_dir):
    docs, labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    bad = {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect() if r.predicted}
    texts = {d: r.text for d, r in rows.items() if d not in bad}
    assert bad and len(texts) > len(rows) / 2

    pages, on = Counter(rows[d].source for d in texts), Counter()
    for d, t in texts.items():
        on.update({(rows[d].source, x) for x in (t or "").split("\n") if x})
    drop = {k for k, n in on.items() if n >= 3 and 100 * n > 5 * pages[k[0]]}
    assert drop
    texts = {d: t and "\n".join(x for x in t.split("\n") if (rows[d].source, x) not in drop) for d, t in texts.items()}

    kept = {d for d, _, c in brute(list(texts.items()), 5, 80) if d == c}
    assert len(kept) < len(texts)
    items = [normal(r.text) for r in bench.collect()]
    clean = {d: texts[d] for d in kept if not any(i in normal(texts[d]) for i in items)}
    assert len(clean) < len(kept)

    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == [*columns, "slot", "place", "position"]
    got = out.collect()
    assert {r.doc_id: r.text for r in got} == clean and len(got) == len(clean)
    assert all(r.n_chars == len(r.text) and r.source == rows[r.doc_id].source for r in got)
    assert len({r.position for r in got}) == len(got)


def test_stages_keep_columns_and_take_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == 0


def test_rows_without_id_or_text_stay(spark, sf_dir):
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = [(None, None, None, None, None), (None, "a b c d e f", None, "src0", 11), (5, None, "en", None, 0), (6, "", "en", "src1", 0)]
    docs = spark.createDataFrame(odd, real.schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) == sorted(((o[0], o[1]) for o in odd), key=str)


def test_groups_of_copies_keep_one_whole_text(spark, sf_dir):
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    line = lambda tag: " ".join(f"{tag}{i}" for i in range(30))
    copied = "\n".join(line(f"c{k}x") for k in range(6))
    near = [line(f"n{k}x") for k in range(6)]
    rows = [(i, copied) for i in range(20)]
    rows += [(100 + i, "\n".join([*near[: i % 6], near[i % 6] + f" e{i}", *near[i % 6 + 1 :]])) for i in range(20)]
    rows += [(200 + i, "menu of the site\n" + line(f"u{i}x")) for i in range(20)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], real.schema)
    for name, stage in corpus_pipeline.STAGES[1:3]:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == (60 if name == "line_dedup" else 22)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert texts == {0: copied, 100: rows[20][1]} | {200 + i: line(f"u{i}x") for i in range(20)}


def test_texts_of_one_id_are_documents_of_their_own(spark, sf_dir):
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = lambda tag, n=40: " ".join(f"{tag}{i}" for i in range(n))
    rows = [(1, text("a")), (1, text("b")), (1, text("b")), (1, text("b") + " end"), (2, text("a")), (3, text("c")), (4, None), (4, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], real.schema)
    out = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text and r.text[:2]) for r in out.collect()), key=str)
    assert got == [(1, "a0"), (1, "b0"), (3, "c0"), (4, ""), (4, None)]
