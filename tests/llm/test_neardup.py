import re

from kestrelflow.llm.components import connected_components
from kestrelflow.llm.neardup import near_duplicates


def brute(rows, size, percent):
    """(doc_id, n_shingles, component) by comparing all pairs."""
    sets = []
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        runs = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())
        sets.append((doc, runs))
    up = {doc: doc for doc, _ in sets if doc is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if None not in (a, b) and s and t:
                both = len(s & t)
                if 100 * both >= percent * (len(s) + len(t) - both):
                    x, y = sorted((top(a), top(b)))
                    up[y] = x
    return sorted(((d, len(s), None if d is None else top(d)) for d, s in sets), key=str)


def got(frame):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in frame.collect()), key=str)


def test_matches_brute_force_on_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for size, percent in ((3, 85), (5, 80)):
        assert got(near_duplicates(docs, size, percent)) == brute(rows, size, percent)


def test_one_large_group_with_stragglers(spark):
    """A chain of edits: ends of the group are far from one another, and single links tie parts together."""
    import random

    random.seed(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(220):
        words = list(base)
        for p in random.sample(range(120), random.choice([0, 1, 2, 3, 4, 6, 9])):
            words[p] = f"x{i}_{p}"
        rows.append((1000 - i, " ".join(words)))
    # Pairs that are near to one another but to no other member.
    for i in range(0, 20, 2):
        words = list(base)
        for p in random.sample(range(120), 12):
            words[p] = f"y{i}_{p}"
        rows += [(2000 + i, " ".join(words)), (2001 + i, " ".join(words[:-1] + ["z"]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near_duplicates(frame, 3, 85)) == brute(rows, 3, 85)


def test_edges(spark):
    rows = [
        (5, "one two three four"), (3, "ONE  two\tthree\nfour"), (7, None), (8, ""), (9, " \n "), (11, "hi"), (12, "Hi "), (4, "hi you"),
        (None, "one two three four"), (5, "one two three four"), (6, "É a"), (2, "é a"), (20, "long " * 30000 + "end"), (21, "long " * 40000 + "end"),
    ]
    frame = spark.createDataFrame([(*r, 1, 2, "k") for r in rows], "doc_id long, text string, n int, rep int, key string")
    assert got(near_duplicates(frame, 3, 85)) == brute(rows, 3, 85)
    assert near_duplicates(frame.limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(1, 40)]
    star = [(100, 100 + i) for i in range(1, 50)]
    frame = spark.createDataFrame([*path, *star, (7, 7)], "a long, b long")
    found = dict(connected_components(frame).collect())
    assert found == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 150)}
    assert connected_components(frame.limit(0)).count() == 0


def test_components_by_union_find(spark):
    import random

    random.seed(5)
    for most in (60, 150, 400):
        links = [(random.randrange(most), random.randrange(most)) for _ in range(100)] + [(0, i) for i in range(0, most, 7)]
        up = list(range(most))

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in links:
            x, y = sorted((top(a), top(b)))
            up[y] = x
        ends = {x for a, b in links if a != b for x in (a, b)}
        found = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
        assert sorted(found) == sorted((x, top(x)) for x in ends)


def test_ids_with_several_texts_tie_their_sets(spark):
    text = lambda tag: " ".join(f"{tag}{i}" for i in range(30))
    rows = [(5, text("a")), (3, text("a")), (5, text("b")), (7, text("b")), (7, text("c")), (9, text("c")), (9, text("c")), (5, None), (1, text("d")), (8, text("d") + " e")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near_duplicates(frame, 3, 85)) == brute(rows, 3, 85)
    assert {r.component_id for r in near_duplicates(frame, 3, 85).where("n_shingles > 0").collect()} == {1, 3}


def test_small_tables_between_steps_are_scanned_by_few_tasks(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*words[: 39 - i % 3], f"x{i % 7}", f"g{i // 10}"])) for i in range(120)]
    docs, held = spark.createDataFrame(rows, "doc_id long, text string"), {}
    for key, value in (("spark.sql.shuffle.partitions", "24"), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        held[key] = spark.conf.get(key)
        spark.conf.set(key, value)
    sc = spark.sparkContext
    sc.setJobGroup("few-tasks", "near_duplicates")
    try:
        assert got(near_duplicates(docs)) == brute(rows, 5, 80)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for key, value in held.items():
            spark.conf.set(key, value)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("few-tasks") for s in tracker.getJobInfo(j).stageIds}
    done = [x.numCompletedTasks for x in map(tracker.getStageInfo, stages) if x]
    assert len(done) > 50
    assert sum(done) < 1500, sum(done)
