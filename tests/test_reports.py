"""Exact ranks, rounding, the report of one scan, counts beside a job, verdicts of a stream and catalogues."""

import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from tallyframe.functions.rounding import python_fixed, python_round
from tallyframe.operators import metrics, report, validate
from tallyframe.sources import catalogue, runlog
from tallyframe.streaming import results as streams


@pytest.mark.parametrize("kind", ["spread", "ties", "halves", "far", "nan"])
def test_exact_ranks_by_narrowing(spark, monkeypatch, kind):
    r = random.Random(kind)
    values = {
        "spread": [r.lognormvariate(0, 9) for _ in range(9000)],
        "ties": [5.0] * 4000 + [r.random() for _ in range(3000)] + [9 + r.random() for _ in range(3000)],
        "halves": [1.0 + k % 2 * 1e9 for k in range(4000)] + [r.random() for _ in range(500)] + [1e10 + r.random() for _ in range(500)],
        "far": [r.choice([-1, 1]) * 10.0 ** r.randrange(-300, 300) for _ in range(8000)],
        "nan": [r.random() for _ in range(5000)] + [math.inf] * 20 + [math.nan] * 30,
    }[kind]
    monkeypatch.setattr(report, "AT_ONCE", 40)
    df = spark.createDataFrame([(v,) for v in r.sample(values, len(values))] + [(None,)], "v double").repartition(5)
    ordered = sorted(values, key=lambda v: (v != v, v))
    n = len(ordered)
    want = {k: ordered[k - 1] for k in (1, 2, n // 10, (n + 1) // 2, (n + 2) // 2, n - 100)}
    assert report.exact_ranks(df, "v", set(want)) == want
    assert report.exact_median(df, "v").first().median == (ordered[(n - 1) // 2] + ordered[n // 2]) / 2


def test_python_rounding(spark):
    r = random.Random(1)
    xs = [2.675, 0.25, 0.125, 0.375, 2.5, 0.5, 1.5, -0.125, -2.675, 0.0, -0.0, 1.005, 0.005, 0.015, 1e-9, -1e-9, 5e-324, 2.0**-10, 0.004999999999999999, 1e15 + 0.3, 2.0**51 + 0.5, 2.0**52 - 0.5, 2.0**53, 1e22, math.inf, -math.inf, math.nan, None]
    xs += [r.uniform(-200, 200) for _ in range(1000)] + [r.randrange(10**6) / 8 for _ in range(300)] + [struct.unpack("d", struct.pack("Q", r.getrandbits(64)))[0] for _ in range(1000)]
    df = spark.createDataFrame(list(enumerate(xs)), "i int, x double")
    columns = [f(F.col("x"), d).alias(f"{name}{d}") for d in range(3) for name, f in (("r", python_round), ("f", python_fixed))]
    for row in df.select("i", *columns).collect():
        x = xs[row.i]
        for d in range(3):
            assert repr(row[f"r{d}"]) == repr(x if x is None or not math.isfinite(x) else float(round(x, d)))
            assert row[f"f{d}"] == (None if x is None or not abs(x) < 2.0**52 else f"{x:.{d}f}")
    with pytest.raises(ValueError, match="digits"):
        python_round(F.lit(1.0), 3)


def test_one_pass_report(spark):
    results = spark.createDataFrame([(1, "easy"), (2, "easy"), (3, "hard"), (4, None), (5, "hard"), (5, "hard")], "id int, difficulty string")
    verdicts = spark.createDataFrame([(1, "hit"), (2, "miss"), (4, "hit"), (5, "partial"), (9, "hit")], "id int, verdict string")
    rows = {(r.level, r.key): (r.n, r.judged, r.hit, r.rate_of_all, r.rate_of_judged) for r in report.one_pass(results, verdicts).collect()}
    third = pytest.approx(100 / 3)
    assert rows == {
        ("run", None): (6, 5, 2, third, 40.0), ("stratum", "easy"): (2, 2, 1, 50.0, 50.0), ("stratum", "hard"): (3, 2, 0, 0.0, 0.0), ("stratum", None): (1, 1, 1, 100.0, 100.0),
        ("verdict", "hit"): (2, 2, 2, 100.0, 100.0), ("verdict", "miss"): (1, 1, 0, 0.0, 0.0), ("verdict", "partial"): (2, 2, 0, 0.0, 0.0), ("verdict", None): (1, 0, 0, 0.0, None),
    }
    assert report.one_pass(results.limit(0), verdicts).count() == 0
    plan = report.one_pass(results, verdicts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2 and plan.count("Expand") == 1  # results and verdicts once each


def test_counts_come_with_the_job(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([("1", True), ("2", False), ("3", None)], "id string, ok boolean").mapInArrow(seen, "id string, ok boolean")
    counts = metrics.written(rows, lambda df: df.write.json(str(tmp_path / "r")), **metrics.outcome_counts())
    assert counts == {"succeeded": 1, "failed": 2} and calls.value == 3 and spark.read.json(str(tmp_path / "r")).count() == 3
    assert metrics.exit_code(counts) == 0 and metrics.exit_code({"succeeded": 0, "failed": 2}) == 2 and metrics.exit_code({"succeeded": 0, "failed": 0}) == 0
    found = spark.createDataFrame([("error", "a"), ("warning", "b"), ("warning", "c")], "severity string, id string")
    counts = metrics.written(found, lambda df: df.write.json(str(tmp_path / "f")), **metrics.finding_counts())
    assert counts == {"errors": 1, "warnings": 2} == {k: validate.summary(found).first()[k] for k in counts}
    assert metrics.exit_code(counts) == 1
    items = spark.createDataFrame([(True,), (False,), (True,)], "is_new boolean")
    assert metrics.written(items, lambda df: df.write.json(str(tmp_path / "i")), **metrics.refresh_counts()) == {"added": 2, "preserved": 1}


def test_first_verdicts_over_restarts(spark, tmp_path):
    sessions = [[("p1", "hit"), ("p2", "miss")], [("p1", "miss"), ("p3", "hit")], [("p3", "miss"), ("p2", "hit"), ("p4", "partial")]]
    (tmp_path / "in").mkdir()
    for n, rows in enumerate(sessions):
        (tmp_path / "in" / f"s{n}.json").write_text("".join(json.dumps({"run_id": "r", "id": i, "verdict": v}) + "\n" for i, v in rows))
        stream = streams.first_verdicts(streams.verdict_stream(spark, str(tmp_path / "in")))
        streams.append_durably(stream, str(tmp_path / "kept"), str(tmp_path / "offsets")).awaitTermination()
    kept = spark.read.schema("id string, verdict string").json(str(tmp_path / "kept"))
    assert sorted((r.id, r.verdict) for r in kept.collect()) == [("p1", "hit"), ("p2", "miss"), ("p3", "hit"), ("p4", "partial")]
    results = spark.createDataFrame([("p1",), ("p5",), ("p5",)], "id string")
    assert [r.id for r in streams.unjudged_stream(results, kept).collect()] == ["p5", "p5"]


def test_catalogue_source(spark, tmp_path):
    log = tmp_path / "calls"

    def get(url):
        with log.open("a") as out:
            out.write(f"{url}\n")
        if url.endswith("none"):
            return "{}"
        return json.dumps({"models": [{"name": "models/b", "displayName": "B", "supportedGenerationMethods": ["generateContent"]}, {"name": f"models/{url[-1]}", "supportedGenerationMethods": None}, {"name": "a", "displayName": "A", "supportedGenerationMethods": ["x", "generateContent"]}]})

    catalogue.register(spark, get, "some_catalogues")
    urls = ["http://x/1", "http://x/2", "http://x/none"]
    rows = spark.read.format("some_catalogues").option("url", "\n".join(urls)).load()
    assert sorted((r.catalogue[-1], r.name, r.displayName) for r in rows.collect()) == [("1", "a", "A"), ("1", "models/1", None), ("1", "models/b", "B"), ("2", "a", "A"), ("2", "models/2", None), ("2", "models/b", "B")]
    assert sorted(log.read_text().split()) == urls  # each once
    assert [r.name for r in runlog.generating_models(rows.where("catalogue = 'http://x/2'")).collect()] == ["a", "b"]
    assert log.read_text().split()[3:] == ["http://x/2"]  # the others aren't asked for
    with pytest.raises(Exception, match="no address"):
        spark.read.format("some_catalogues").load().collect()
