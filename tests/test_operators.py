import math

import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from kestrelflow.functions import numbers as N
from kestrelflow.functions import text as T
from kestrelflow.operators import catalog, labels, metrics, models, moments, normalize, windows
from kestrelflow.sources.telemetry import CHANNELS, fleet_split, telemetry
from kestrelflow.streaming import windows as streaming


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "x,wanted", [(0.5, "0.5"), (12345.678, "1.235e+04"), (0.00001234, "1.234e-05"), (100.0, "100"), (-3.14159, "-3.142"), (0.0, "0"), (999.96, "1000"), (9999.6, "1e+04"), (0.0001, "0.0001"), (float("nan"), "nan"), (float("-inf"), "-inf")]
)
def test_significant_digits_as_python(spark, x, wanted):
    assert f"{x:.4g}" == wanted and value(spark, N.significant(F.lit(x))) == wanted


@pytest.mark.parametrize("text,wanted", [("12.5", 12.5), (" +7\n", 7.0), (".5", 0.5), ("5.", 5.0), ("-3", None), ("9 cycles", None), ("", None), ("1e3", None), ("nan", None), ("５", None)])
def test_answers(spark, text, wanted):
    got = value(spark, N.answer_number(F.lit(text)))
    assert math.isnan(got) if wanted is None else got == wanted


def test_numbers(spark):
    assert value(spark, N.clipped(F.lit(-2.0))) == 0 and math.isnan(value(spark, N.clipped(F.lit(float("nan")))))
    assert value(spark, N.is_sha256(F.lit("a" * 64))) and not value(spark, N.is_sha256(F.lit("a" * 64 + "\n")))
    assert value(spark, N.parsed_number(F.lit("x"))) is None and value(spark, N.is_finite(F.lit(float("inf")))) is False


@pytest.mark.parametrize("rul,status,urgency", [(0.0, "CRITICAL", "PRIORITY_REVIEW"), (30.0, "CRITICAL", "PRIORITY_REVIEW"), (30.1, "WARNING", "PLANNING_REVIEW"), (75.0, "WARNING", "PLANNING_REVIEW"), (75.1, "NORMAL", "MONITOR")])
def test_band_edges(spark, rul, status, urgency):
    assert value(spark, labels.band(F.lit(rul))) == status and value(spark, labels.band(F.lit(rul), "urgency")) == urgency
    assert value(spark, labels.band(F.lit(None).cast("double"), "screen")) == "Model unavailable"


def test_drifts_and_rules(spark):
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<double>")
    assert value(spark, labels.rounded_drift(a(1400.0, 1405.0, 1410.5))) == 10.5 and value(spark, labels.rounded_drift(a(47.5, 47.0, 46.8))) == -0.7
    assert value(spark, labels.rounded_drift(a())) == 0 and value(spark, labels.rounded_drift(F.lit(None).cast("array<double>"))) == 0
    names = {"sensor_4": "Temperature", "sensor_11": "Pressure"}

    def review(rul, **series):
        pairs = [x for k, v in series.items() for x in (F.lit(k), v)]
        return value(spark, labels.review(F.create_map(*pairs), F.lit(rul), names, "sensor_4", "sensor_11"))

    both = review(30.0, sensor_4=a(100, 103), sensor_11=a(30, 29))
    assert both.rule_match == "Both thresholds met" and "+3.0000" in both.evidence[0] and both.urgency == "PRIORITY_REVIEW"
    assert review(80.0, sensor_4=a(1, 1), sensor_11=a(1, 1)).rule_match == "Combined thresholds not met"
    lacking = review(80.0, sensor_4=a(1, float("nan")))
    assert lacking.rule_match == "Insufficient data" and lacking.evidence == ["Temperature: insufficient valid readings", "Pressure: insufficient valid readings"]
    for bad in (float("nan"), float("inf"), -1.0):
        assert review(bad, sensor_4=a(1, 2)) is None


def test_staging_never_sees_a_withheld_life(spark):
    w = telemetry(spark, "/root/testdata/sf0.001")
    w = windows.strided_windows(w, CHANNELS)
    known = F.when(F.col("split") != "test", F.col("rul"))
    drift = lambda c: labels.endpoint_drift(F.col("series")[c])
    say = lambda frame: frame.where("split = 'test'").select("unit", "cycle", labels.staged_rul(known, drift("sensor_4"), drift("sensor_11"))).collect()
    assert say(w) == say(w.withColumn("rul", F.col("rul") + 1000))


def test_normalisation(spark):
    rows = [(1, "train", [1.0, 2.0, 3.0], [7.0] * 3), (1, "train", [3.0, 4.0, 5.0], [7.0] * 3), (71, "validation", [100.0, 200.0, 300.0], [7.0] * 3), (81, "test", [1000.0, 2000.0, 3000.0], [7.0] * 3)]
    w = spark.createDataFrame([(u, i, s, (a, b)) for i, (u, s, a, b) in enumerate(rows)], "unit int, cycle int, split string, series struct<sensor_2: array<double>, sensor_3: array<double>>")
    stats = {r.channel: r for r in normalize.fit_on_windows(w, ["sensor_2", "sensor_3"]).collect()}
    six = [1, 2, 3, 3, 4, 5]
    assert stats["sensor_2"].mean == pytest.approx(np.mean(six)) and stats["sensor_2"].scale == pytest.approx(np.std(six)) and stats["sensor_2"].samples == 6
    assert stats["sensor_3"].scale == 1
    fitted = normalize.fit_on_windows(w, ["sensor_2", "sensor_3"])
    assert all(r.normal.sensor_3 == [0, 0, 0] for r in normalize.transform(w, fitted, ["sensor_2", "sensor_3"]).collect())
    other = w.withColumn("series", F.when(F.col("split") == "train", F.col("series")).otherwise(F.struct(F.array(F.lit(9.0)).alias("sensor_2"), F.array(F.lit(1.0)).alias("sensor_3"))))
    assert sorted(normalize.fit_on_windows(other, ["sensor_2", "sensor_3"]).collect()) == sorted(fitted.collect())
    for stats, said in (
        (fitted.where("channel <> 'sensor_3'"), "no statistics of sensor_3"), (fitted.unionByName(fitted), "several statistics"),
        (fitted.withColumn("scale", F.lit(0.0)), "no usable scale"), (fitted.withColumn("mean", F.lit(float("nan"))), "no usable mean"), (fitted.withColumn("samples", F.lit(0)), "no samples"),
    ):
        with pytest.raises(Exception, match=said):
            normalize.transform(w, stats, ["sensor_2", "sensor_3"]).collect()
    with pytest.raises(Exception, match="out of a float's range"):
        normalize.transform(w.withColumn("series", F.struct(F.array(F.lit(1e300)).alias("sensor_2"))), fitted, ["sensor_2"]).collect()
    bad = spark.createDataFrame([("a", 1.0, 0.0, 5), ("b", float("nan"), 1.0, 5), ("c", 1.0, 1.0, 0), ("d", 1.0, 1.0, 1), ("d", 1.0, 1.0, 1)], "channel string, mean double, scale double, samples long")
    assert sorted(r.rule for r in normalize.stats_violations(bad).collect()) == ["copy", "mean", "samples", "scale"]
    assert normalize.stats_violations(fitted, w.select("unit", "split")).where("rule = 'unit'").count() == 2


def test_weighted_fit_and_repartitioning_change_nothing(spark, sf_dir):
    rows = telemetry(spark, sf_dir).checkpoint()
    a = {r.channel: r for r in normalize.fit_on_rows(rows, CHANNELS).collect()}
    b = {r.channel: r for r in normalize.fit_on_windows(windows.strided_windows(rows.repartition(7), CHANNELS), CHANNELS).collect()}
    for c in CHANNELS:
        assert (a[c].mean, a[c].scale, a[c].samples) == pytest.approx((b[c].mean, b[c].scale, b[c].samples))
    assert normalize.fit_on_rows(rows.limit(0), CHANNELS).count() == 0


def test_moments_keep_their_digits_and_run_nothing_early(spark, sf_dir):
    rng = np.random.default_rng(3)
    x = 1e9 + rng.normal(size=5000) * 1e-3
    weight = rng.integers(0, 7, 5000)
    frame = spark.createDataFrame([(float(v), float(i % 7), int(w)) for i, (v, w) in enumerate(zip(x, weight, strict=True))], "x double, y double, w int").repartition(9)
    got = {r["column"]: r for r in moments.column_moments(frame, ["x", "y"], "w").collect()}
    mean = np.average(x - 1e9, weights=weight)
    assert got["x"]["n"] == weight.sum() and got["x"]["mean"] == pytest.approx(1e9 + mean, rel=1e-15)
    assert got["x"]["deviation"] == pytest.approx(np.sqrt(np.average((x - 1e9 - mean) ** 2, weights=weight)), rel=1e-6)
    part = moments.moment_parts(frame, ["x", "y"], None, True).first()
    wanted = np.cov(np.array([x - 1e9, np.arange(5000) % 7.0]), bias=True) * 5000
    size = np.sqrt(np.outer(np.diag(wanted), np.diag(wanted)))
    assert np.allclose(np.array(part["m"]).reshape(2, 2) / size, wanted / size, atol=1e-5)
    assert moments.column_moments(frame.where("w > 9"), ["x"]).count() == 0
    rows = telemetry(spark, sf_dir)
    tracker, group = spark.sparkContext.statusTracker(), "early"
    spark.sparkContext.setJobGroup(group, group)
    stats = normalize.fit_on_rows(rows, CHANNELS)
    out = normalize.transform(windows.strided_windows(rows, CHANNELS), stats, CHANNELS)
    assert len(tracker.getJobIdsForGroup(group)) == 0 and out.columns[-1] == "normal"
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Scan parquet") == 1


def test_segments_of_long_units_give_the_same_windows(spark):
    size, stride = 7, 3
    lives = {1: 6, 2: 7, 3: 8, 4: 31, 5: 1000}
    rows = spark.createDataFrame([(u, c, c * 1.5, float(c % 11), "train") for u, n in lives.items() for c in range(1, n + 1)], "unit int, cycle int, a double, b double, split string").repartition(6)
    plain = lambda frame: sorted((r.unit, r.cycle, r.window_start, r.rul, r.split, *r.series.a, *r.series.b) for r in frame.collect())
    wanted = []
    for u, n in lives.items():
        for c in range(size, n + 1):
            if (c - size) % stride == 0 or c == n:
                span = range(c - size + 1, c + 1)
                wanted.append((u, c, c - size + 1, n - c, "train", *(x * 1.5 for x in span), *(float(x % 11) for x in span)))
    assert plain(windows.strided_windows(rows, ["a", "b"], size, stride)) == sorted(wanted)
    for segment in (1, 3, 4, 10, 100, 5000):
        assert plain(windows.strided_windows(rows, ["a", "b"], size, stride, segment)) == sorted(wanted)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would join partitions as small as these
    tasks = windows.strided_windows(rows.where("unit = 5"), ["a"], size, stride, 50).select(F.spark_partition_id().alias("p")).distinct().count()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks >= 4  # one unit on several tasks
    with pytest.raises(Exception, match="don't follow one another"):
        windows.strided_windows(rows.where("cycle <> 20"), ["a"], size, stride, 10).collect()
    with pytest.raises(Exception, match="unit 1 has 6 only"):
        windows.strided_windows(rows, ["a"], size, stride, strict=True).collect()
    assert windows.strided_windows(rows.where("unit > 1"), ["a"], size, stride, strict=True).count() > 0
    with pytest.raises(ValueError):
        windows.require_size(rows, size)
    windows.require_size(rows.where("unit > 1"), size)
    gaps = rows.where("cycle <> 20 and unit = 4")
    assert [tuple(r.series.a)[-1] for r in windows.strided_windows(gaps, ["a"], size, stride).orderBy("cycle").collect()][-1] == 46.5


def test_scores(spark):
    rows = [("a", 10.0, 12.0), ("a", 20.0, float("nan")), ("b", 10.0, None), ("c", 50.0, 37.0), ("c", 50.0, 60.0)]
    got = {r.model: r for r in metrics.score_models(spark.createDataFrame(rows, "model string, truth double, prediction double")).collect()}
    assert (got["a"].rmse, got["a"].failed, got["a"].coverage) == (2, 1, 0.5)
    assert (got["b"].rmse, got["b"].mae, got["b"].score, got["b"].coverage) == (None, None, None, 0)
    assert got["c"].score == pytest.approx(math.e - 1 + math.e - 1)
    assert value(spark, metrics.relative_reduction(F.lit(8.0), F.lit(10.0))) == 20 and value(spark, metrics.relative_reduction(F.lit(8.0), F.lit(0.0))) is None
    split = lambda *r: spark.createDataFrame(r, "unit int, split string")
    metrics.check_splits(split((1, "train"), (2, "test")))
    for bad in (split((1, "train"), (1, "test")), split((1, "train"))):
        with pytest.raises(ValueError):
            metrics.check_splits(bad)
    with pytest.raises(ValueError):
        metrics.check_trained(split((3, "train")), split((3, "test")))
    metrics.check_trained(split((3, "train")), split((4, "test")))


def test_ridge_as_in_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 3)) * [1, 5, 0.2]
    y = x @ [2, -1, 4] + 7 + rng.normal(size=80)
    frame = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y double")
    model = models.fit_ridge(frame, ["a", "b", "c"], "y", 10.0)
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + 10 * np.eye(3), xc.T @ yc)
    assert np.allclose(model.coefficients.toArray(), w) and model.intercept == pytest.approx(y.mean() - x.mean(0) @ w)
    own = models.ridge(frame.repartition(5), ["a", "b", "c"], "y", 10.0)
    assert np.allclose(own.coefficients, w) and own.intercept == pytest.approx(model.intercept) and own.n == 80
    left = models.ridge_left_over(frame, own, ["a", "b", "c"], "y").collect()
    assert [r.feature for r in left] == ["a", "b", "c"] and all(abs(r.residual) < 1e-12 and r.n_windows == 80 for r in left)
    worse = own._replace(coefficients=[c + 0.1 for c in own.coefficients])
    assert all(abs(r.residual) > 1e-3 for r in models.ridge_left_over(frame, worse, ["a", "b", "c"], "y").collect()[:2])
    with pytest.raises(ValueError):
        models.ridge(frame.limit(0), ["a"], "y")
    got = frame.select(models.predict_ridge(frame, model, ["a", "b", "c"]).alias("p")).toPandas()["p"]
    assert np.allclose(got, x @ w + y.mean() - x.mean(0) @ w)


def test_predictors(spark):
    frame = spark.createDataFrame([(i, float(i - 3)) for i in range(10)], "unit int, x double")

    def make():
        def predict(part):
            assert len(part) <= 4
            return np.where(part["x"] == 0, np.nan, part["x"])

        return predict

    got = {r.unit: r.prediction for r in models.predict_batches(frame, make, ["unit"], 4).collect()}
    assert got[1] == 0 and got[3] is None and got[9] == 6
    with pytest.raises(ValueError):
        models.predict_batches(frame, make, ["unit"], 0)
    head = models.regression_head(np.eye(2), np.zeros(2), np.ones(2), 1.0)
    assert head(np.array([[[1.0, 0.0], [1.0, 0.0]]]))[0] == pytest.approx(0.8413447 + 1)
    points = np.linspace(-8, 8, 2001)
    assert np.abs(models.error_function(points) - [math.erf(p) for p in points]).max() < 1e-14
    b = models.shuffled_batches(frame, 1, 2)
    assert b.count() == 10 and b.groupBy("slice", "batch_no").count().where("count > 2").count() == 0


def test_text(spark):
    ids = lambda *x: F.array(*map(F.lit, x))
    m = value(spark, T.masked_tokens(ids(10, 11), ids(12), 7))
    assert (m.input_ids, m.attention_mask, m.labels, m.fits) == ([1, 10, 11, 12, 2, 2, 2], [1] * 5 + [0] * 2, [-100] * 3 + [12, 2] + [-100] * 2, True)
    long = value(spark, T.masked_tokens(ids(10, 11), ids(12), 4))
    assert (long.input_ids, long.fits) == (None, False)
    mask, labelled = T.with_prefix(ids(1, 1, 1, 0), ids(-100, 10, 2, -100), 1)
    assert value(spark, mask) == [1, 1, 1, 1, 0] and value(spark, labelled) == [-100, -100, 10, 2, -100]
    a, b, again, c = value(spark, T.word_ids(F.lit("a b  a\nc")))
    assert a == again and len({a, b, c}) == 3 and min(a, b, c) >= 10
    made = spark.sparkContext.accumulator(0)

    class Lengths:
        begin_id, end_id, padding_id = 7, 8, 9

        def encode(self, text):
            return [len(w) for w in text.split()]

    def make():
        if TaskContext.get() is not None:
            made.add(1)
        return Lengths()

    own = spark.createDataFrame([("a bb", "ccc"), (None, "x")] + [("a", "b")] * 50, "p string, r string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    got = [r.tokens for r in T.tokenized(own, make, "p", "r", 6).collect()]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (got[0].input_ids, got[0].attention_mask, got[0].labels) == ([7, 1, 2, 3, 8, 9], [1] * 5 + [0], [-100] * 3 + [3, 8, -100]) and got[1].input_ids is None
    assert made.value == 2  # once for each of the two columns in the one task, not once a batch
    assert T.HashedWords().encode("a b  a\nc")[0] == T.HashedWords().encode("a")[0] >= 10
    with pytest.raises(ValueError):
        T.masked_tokens(F.array(), F.array(), 0)
    for prompt, said, wanted in (("Which PART?", "", "upkeep"), ("departure to LHR", "", "upkeep"), ("fly to LHR", "", "route"), ("hello", " x ", "generated"), ("hello", " ", "fallback")):
        assert value(spark, T.question_route(F.lit(prompt), F.lit(said))) == wanted


def test_a_task_holds_few_rows_ids_at_a_time(spark):
    class Held:
        """Says how many MB its worker holds."""

        begin_id, end_id, padding_id = 1, 2, 0

        def encode(self, text):
            with open("/proc/self/statm") as f:
                return [int(f.read().split()[1]) // 256, *([7000] * len(text))]

    own = spark.range(4000).select(F.expr("repeat('a', 8000)").alias("p"), F.lit("x").alias("r")).coalesce(1)
    before, most = own.limit(1), own
    held = [T.tokenized(rows, Held, "p", "r", 9000).agg(F.max(F.element_at("tokens.input_ids", 2))).first()[0] for rows in (before, most)]
    assert held[1] - held[0] < 150, held


def test_embedders_once_a_task(spark):
    class Doubled:
        width = 2

        def embed(self, values):
            assert values.shape[1:] == (3, 2)
            return values * 2

    rows = [(1, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), (2, None), (3, [1.0]), (4, [1.0, None, 3.0, 4.0, 5.0, 6.0]), (5, [0.0] * 6)]
    frame = spark.createDataFrame(rows, "k int, v array<double>").coalesce(1)
    got = {r.k: r.embedding for r in models.mean_embeddings(frame, Doubled, ["k"], "v", steps=3, batch=2).collect()}
    assert got == {1: [6.0, 8.0], 2: None, 3: None, 4: None, 5: [0.0, 0.0]}
    assert models.mean_embeddings(frame.limit(0), Doubled, ["k"], "v", steps=3).count() == 0


def test_catalog(spark, sf_dir):
    w = windows.strided_windows(telemetry(spark, sf_dir), CHANNELS).withColumn("record_id", labels.record_id(F.col("unit"), F.col("cycle")))
    assert catalog.time_series(w, CHANNELS).select("sensor").distinct().count() == 5
    assert catalog.annotations(w, ["unit", "split"]).count() == 2 * w.count()
    edge = spark.createDataFrame([(1,), (70,), (71,), (80,), (81,), (100,), (101,)], "unit int")
    assert [r.s for r in edge.orderBy("unit").select(fleet_split(F.col("unit")).alias("s")).collect()] == ["train", "train", "validation", "validation", "test", "test", None]


def test_filters_reach_the_scan_and_one_shuffle_serves_a_window(spark, sf_dir):
    plan = windows.strided_windows(telemetry(spark, sf_dir), CHANNELS)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1 and "event_type" not in plan
    plan = telemetry(spark, sf_dir).where("unit = 3").select("unit", "cycle")._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan and "props" not in plan
