from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from kestrelflow.llm import mixing
from kestrelflow.llm.mixing import mix_sources, schedule, tempered_weights


def ideal(blocks, weights, slots):
    """How many blocks of each source an ideal mix has handed out after so many slots."""
    left, given, t = {s: Fraction(n) for s, n in blocks.items() if n}, dict.fromkeys(blocks, Fraction(0)), Fraction(0)
    while left and t < slots:
        total = sum(weights[s] for s in left)
        step = min(slots - t, *(n * total / weights[s] for s, n in left.items()))
        for s in list(left):
            given[s] += step * weights[s] / total
            left[s] -= step * weights[s] / total
            if not left[s]:
                del left[s]
        t += step
    return given


def owners(blocks, weights):
    slots, out, at = schedule(list(blocks.values()), list(weights.values())), {}, 0
    for s, n in blocks.items():
        own = slots[at : at + n].tolist()
        assert own == sorted(own)  # a source's blocks stay in order
        out |= dict.fromkeys(own, s)
        at += n
    assert sorted(out) == list(range(sum(blocks.values())))
    return out


@pytest.mark.parametrize(
    "blocks,weights",
    [
        ({"a": 9}, {"a": 1}), ({"a": 40, "b": 7, "c": 1, "d": 25}, {"a": 5, "b": 3, "c": 1, "d": 1}), ({"a": 300, "b": 2, "c": 40, None: 66}, {"a": 50, "b": 1, "c": 7, None: 11}),
        (dict.fromkeys("abcdefghijk", 3), dict.fromkeys("abcdefghijk", 3)), ({"a": 5, "b": 0, "c": 5}, {"a": 10**15, "b": 3, "c": 10**15 + 7}),
    ],
)
def test_less_than_a_block_from_the_ideal_mix_at_every_slot(blocks, weights):
    owner, got = owners(blocks, weights), Counter()
    for t in range(sum(blocks.values())):
        got[owner[t]] += 1
        assert all(abs(got[s] - x) < 1 for s, x in ideal(blocks, weights, t + 1).items())


@pytest.mark.parametrize("kind", ["317", "4473", "20000", "large and tiny", "330 and 3"])
def test_many_sources_are_less_than_a_block_from_their_targets(kind):
    counts = {
        "317": dict.fromkeys(range(317), 160), "4473": dict.fromkeys(range(4473), 50), "20000": dict.fromkeys(range(20000), 40),
        "large and tiny": {i: 16 * 1000 for i in range(100)} | {100: 1}, "330 and 3": {i: 320 if i < 330 else 32000 for i in range(333)},
    }[kind]
    weights = {int(s): w for s, w in tempered_weights(counts).items()}
    blocks = np.array([-(-n // 16) for n in counts.values()])
    w = np.array(list(weights.values()), float)
    slots, source = schedule(blocks, list(weights.values())), np.repeat(np.arange(len(blocks)), blocks)
    assert (np.sort(slots) == np.arange(blocks.sum())).all()
    # The ideal flow is a straight line between the ends of sources; where a source is furthest from it is just before and after its own blocks.
    over = np.unique(blocks / w)
    times = np.append(0, [np.minimum(blocks, w * v).sum() for v in over])
    virtual = lambda t: np.interp(t, times, np.append(0, over))
    at = np.arange(len(slots)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    flow = lambda t: np.minimum(blocks[source], w[source] * virtual(t))
    assert (np.abs(at - flow(slots)) < 1 + 1e-6).all() and (np.abs(at + 1 - flow(slots + 1)) < 1 + 1e-6).all()


def test_rows(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 4}", "t") for i in range(1000)] + [(None, None, None)] * 5 + [(7, "hot", "t"), (7, "hot", "t")]
    frame = spark.createDataFrame([(*r, 3, 4) for r in rows], "doc_id long, source string, text string, slot int, _rank int")
    weights = {"hot": 2, "s0": 1, "s1": 1, "s2": 1, "s3": 1}
    out = mix_sources(frame.drop("_rank"), weights, block=8)
    assert out.columns == ["doc_id", "source", "text", "slot", "place", "position"]
    got = sorted(out.collect(), key=lambda r: r.position)
    assert Counter((r.doc_id, r.source) for r in got) == Counter((r[0], r[1]) for r in rows)
    assert len({r.position for r in got}) == len(rows)
    total = 7  # with weight 1 for the null source
    ends = min(max(r.slot for r in got if r.source == s) for s in [*weights, None])
    for t in range(1, ends + 1):
        slots = Counter(s for s, _ in {(r.source, r.slot) for r in got if r.slot < t})
        assert all(abs(slots[s] - weights.get(s, 1) * t / total) < 1 for s in [*weights, None])
    assert sorted((r.slot, r.place) for r in got) == [(r.slot, r.place) for r in got]
    again = sorted(mix_sources(frame.drop("_rank").repartition(7), weights, block=8).collect(), key=lambda r: r.position)
    assert [r.doc_id for r in again] == [r.doc_id for r in got]
    assert mix_sources(frame.drop("_rank").limit(0)).count() == 0


def test_positions_depend_on_the_rows_alone(spark):
    rows = [(None if i % 3 == 0 else i % 50, f"s{i % 5}" if i % 7 else None, f"t{i}", {"k": i}) for i in range(2000)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string, more map<string,int>")
    one, two = ({r.text: r.position for r in mix_sources(f, block=4).collect()} for f in (frame.repartition(3), frame.repartition(7)))
    assert len(one) == 2000 and one == two


@pytest.mark.parametrize("weights", [{"a": 0}, {"a": -2, "b": 1}, {"a": 1.5}])
def test_weights_below_one(spark, weights):
    with pytest.raises(ValueError, match="whole numbers"):
        mix_sources(spark.createDataFrame([(1, "a")], "doc_id long, source string"), weights)


def simulated(blocks, weights):
    """Earliest deadline first, slot by slot, with windows from the ideal mix in fractions: the source of each slot."""
    order, total = sorted(blocks, key=mixing._key), sum(blocks.values())
    flow = [ideal(blocks, weights, t) for t in range(total + 1)]
    first = {(s, i): max(t for t in range(total + 1) if flow[t][s] <= i) for s in order for i in range(blocks[s])}
    due = {(s, i): min(t for t in range(total + 1) if flow[t][s] >= i + 1) for s in order for i in range(blocks[s])}
    out, done = [], dict.fromkeys(order, 0)
    for t in range(total):
        s = min((due[s, done[s]], order.index(s), s) for s in order if done[s] < blocks[s] and first[s, done[s]] <= t)[2]
        out.append(s)
        done[s] += 1
    return out


def test_default_weights_against_a_simulation(spark):
    counts = {"a": 3000, "b": 700, "c": 90, "d": 40, None: 333}
    frame = spark.createDataFrame([(i, s) for s, n in counts.items() for i in range(n)], "doc_id long, source string")
    weights = tempered_weights(counts)
    assert all(abs(w / sum(weights.values()) - counts[s] ** 0.5 / sum(n**0.5 for n in counts.values())) < 0.005 for s, w in weights.items())
    wanted = simulated({s: -(-n // 16) for s, n in counts.items()}, weights)
    got = {r.slot: r.source for r in mix_sources(frame).collect()}
    assert [got[t] for t in range(len(got))] == wanted


def test_blocks_grow_where_there_would_be_too_many(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 50)
    got = mix_sources(spark.range(1000).selectExpr("id as doc_id", "concat('s', id % 3) as source"), block=1).collect()
    assert sorted(r.position for r in got) == sorted(r.slot * 20 + r.place for r in got) and max(r.place for r in got) == 19
    assert len({r.position for r in got}) == 1000 and max(r.slot for r in got) < 53


def test_columns_named_as_our_own(spark):
    frame = spark.createDataFrame([(i, f"s{i % 2}", i, str(i), 9) for i in range(50)], "doc_id long, source string, _key long, _row string, _order int")
    out = mix_sources(frame)
    assert out.columns == [*frame.columns, "slot", "place", "position"]
    assert sorted(tuple(r)[:5] for r in out.collect()) == sorted(tuple(r) for r in frame.collect())


def test_weights_of_many_sources_are_not_floored():
    counts = {f"s{i}": 1000 for i in range(2000)} | {"big": 1_000_000}
    got = tempered_weights(counts)
    assert abs(got["big"] / sum(got.values()) - 1000 / (1000 + 2000 * 1000**0.5)) < 0.0005
    assert tempered_weights({}) == {}


@pytest.mark.parametrize("most", [1 << 20, 4000])
def test_more_sources_than_a_schedule_takes(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "MOST_SOURCES", most)
    small = spark.range(5000).selectExpr("id as doc_id", "concat('h', id) as source")
    big = spark.range(5000, 45000).selectExpr("id as doc_id", "'big' as source")
    mid = spark.range(45000, 53000).selectExpr("id as doc_id", "cast(null as string) as source")
    frame = small.unionByName(big).unionByName(mid)
    out = mix_sources(frame, block=1).collect()
    assert sorted((r.doc_id, r.source) for r in out) == sorted(((r.doc_id, r.source) for r in frame.collect()))
    assert sorted(r.slot for r in out) == list(range(53000))
    roots = {"big": 200.0, None: 8000**0.5}
    total, seen = 5000 + sum(roots.values()), Counter()
    for t, r in enumerate(sorted(out, key=lambda r: r.slot)[:5000]):  # until the small sources end
        seen[r.source] += 1
        assert all(abs(seen[s] - w * (t + 1) / total) < (2 if most == 4000 else 1.25) for s, w in roots.items())  # roots are rounded to weights
    again = mix_sources(frame.repartition(5), block=1).collect()
    assert {r.doc_id: r.position for r in again} == {r.doc_id: r.position for r in out}


def test_given_weights_by_virtual_time(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    monkeypatch.setattr(mixing, "CHUNK", 3)
    frame = spark.createDataFrame([(i, f"s{i % 3}", "t") for i in range(999)], "doc_id long, source string, text string")
    got = sorted(mix_sources(frame, {"s0": 8, "s1": 4}, block=4).collect(), key=lambda r: r.position)
    assert len({r.position for r in got}) == 999 and sorted({r.slot for r in got}) == list(range(3 * 84))
    head = Counter(r.source for r in got if r.slot < 13 * 8)
    assert all(abs(head[s] - w * 8 * 4) <= 8 for s, w in (("s0", 8), ("s1", 4), ("s2", 1)))


def test_steps_fill_the_same_slots():
    rng = np.random.default_rng(5)
    for many in (1, 3, 40):
        blocks, weights = rng.integers(1, 90, many).tolist(), rng.integers(1, 30, many).tolist()
        for step in (1, 7, 1000):
            parts = list(mixing.schedule_parts(blocks, weights, step))
            got = [pair for s, b in parts for pair in zip(s.tolist(), b.tolist(), strict=True)]
            first = np.cumsum(blocks) - blocks
            slots = schedule(blocks, weights)
            assert [int(slots[first[s] + b]) for s, b in got] == list(range(sum(blocks)))


def test_one_rule_at_every_size(spark, monkeypatch):
    """Without bounds neither many blocks nor many sources change where a row goes."""
    frame = spark.range(3000).selectExpr("id as doc_id", "concat('s', pmod(id * id, 7)) as source")
    wanted = {r.doc_id: (r.position, r.place) for r in mix_sources(frame, block=4).collect()}
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 50)
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    for step in (mixing.STEP, 100):
        monkeypatch.setattr(mixing, "STEP", step)
        assert {r.doc_id: (r.position, r.place) for r in mix_sources(frame, block=4, bounded=False).collect()} == wanted
    assert mix_sources(frame.limit(0), bounded=False).count() == 0
