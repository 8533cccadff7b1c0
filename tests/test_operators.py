"""The evaluation operators on small literal inputs, bad ones above all."""

import json
import statistics
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tallyframe import round_trips, schemas
from tallyframe.functions import scalars
from tallyframe.functions.extract import extract_json, first_object
from tallyframe.operators import judge, manifest, report, validate
from tallyframe.plans import cards, decision, infer
from tallyframe.round_trips import stub_png as png
from tallyframe.schemas import MANIFEST, RESULT, last_wins
from tallyframe.sources import manifest as manifests
from tallyframe.sources import photos, runlog
from tallyframe.streaming import results as streams

FILES = [("a.jpg", 100, 80)]


def jpeg(width, height, orientation=None):
    exif = b""
    if orientation:
        tiff = b"II*\0" + struct.pack("<IH", 8, 1) + struct.pack("<HHIHH", 0x0112, 3, 1, orientation, 0)
        exif = b"\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff
    return b"\xff\xd8" + exif + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, height, width, 1) + b"\0\0\0"


def items(spark, *rows):
    full = [{"id": "p01", "file": "a.jpg", "_size": None, "bbox": None, "difficulty": "easy", "truth": {"brand": "b", "model": None, "url": None}, "manual_search": {"seconds": 1.0, "success": True}} | r for r in rows]
    return spark.createDataFrame([(i, *r.values()) for i, r in enumerate(full)], f"pos INT, {MANIFEST}")


def rules(spark, *rows, smoke=False):
    files = spark.createDataFrame(FILES, "file string, width int, height int")
    return sorted((f.severity, f.rule) for f in validate.validate(items(spark, *rows), files, smoke).collect() if f.rule != "V9")


@pytest.mark.parametrize(
    ("row", "normal", "smoke"),
    [
        ({}, [], []),
        ({"file": "gone.jpg", "difficulty": "x"}, [("error", "V2")], [("error", "V2")]),
        ({"bbox": [1, 2, 3]}, [("error", "V3")], [("error", "V3")]),
        ({"bbox": []}, [], []),
        ({"bbox": [0, 0, 0, 5]}, [("error", "V4")], [("error", "V4")]),
        ({"bbox": [90, 0, 20, 5]}, [("error", "V5")], [("error", "V5")]),
        ({"bbox": [-1, 0, 2, 5]}, [("error", "V5")], [("error", "V5")]),
        ({"bbox": [0, 0, 100, 80]}, [], []),
        ({"difficulty": None}, [("error", "V6")], [("error", "V6")]),
        ({"truth": None}, [("error", "V7")], [("warning", "V7")]),
        ({"truth": {"brand": "", "model": "", "url": "u"}}, [("error", "V7")], [("warning", "V7")]),
        ({"manual_search": None}, [("warning", "V8")], []),
        ({"manual_search": {"seconds": 3.0, "success": False}}, [], []),
        ({"file": None}, [], []),
    ],
)
def test_rules(spark, row, normal, smoke):
    assert rules(spark, row) == normal
    assert rules(spark, row, smoke=True) == smoke


def test_repeated_ids_and_strata(spark):
    assert rules(spark, {}, {}, {"id": None}, {"id": None}, {"file": "gone.jpg"}) == [("error", "V1")] * 3 + [("error", "V2")]
    files = spark.createDataFrame(FILES, "file string, width int, height int")
    found = validate.validate(items(spark, {"file": "gone.jpg"}), files)
    assert {f.rule for f in found.collect()} == {"V2", "V9"}
    assert validate.summary(found).first().exit_code == 1
    assert validate.summary(found.where("severity = 'warning'")).first().exit_code == 0


def forced(spark, rows, grounding):
    df = spark.createDataFrame(rows, "ok boolean, parsed string")
    return [r[0] for r in df.select(judge.forced_reason(F.col("ok"), F.col("parsed"), F.lit(grounding))).collect()]


def test_forced_misses(spark):
    assert forced(spark, [(False, None)], True) == ["call failed"]
    assert forced(spark, [(True, '{"brand":"Nike","links":[]}')], True) == ["no supporting link"]
    assert forced(spark, [(True, '{"brand":"Nike","links":["http://a"]}')], True) == [None]
    assert forced(spark, [(True, '{"category":"bag","links":[]}')], False) == [None]
    assert forced(spark, [(True, None), (True, "{}"), (None, '{"a":1}')], False) == ["no answer could be read"] * 2 + ["call failed"]
    assert forced(spark, [(True, '{"links":"http://a"}'), (True, '{"links":null}'), (True, '{"links":""}')], True) == [None, "no supporting link", "no supporting link"]


def twenty(spark):
    rows = [(f"p{i:02d}", "easy", True, 1.0, (1,), True) for i in range(20)]
    return spark.createDataFrame(rows, "id string, difficulty string, ok boolean, latency_s double, tokens struct<total:int>, grounding_used boolean")


def test_partial_judging(spark):
    verdicts = spark.createDataFrame([("p00", "hit")], "id string, verdict string")
    row = report.coverage(twenty(spark), verdicts, smoke=True).first()
    assert (row.hit_rate, row.unjudged, row.is_lower_bound, row.smoke) == (5.0, 19, True, True)
    assert "5.0%" in cards.render_report(row.asDict()) and "unjudged 19" in cards.render_report(row.asDict())
    stratum = report.strata(twenty(spark), verdicts).first()
    assert (stratum.hit_rate, stratum.hit_rate_stratum_full) == (100.0, 5.0)


def test_unmeasured_is_not_failed(spark):
    verdicts = twenty(spark).select("id", F.lit("hit").alias("verdict"))
    none = twenty(spark).select("id", F.lit(None).cast("struct<seconds:double,success:boolean>").alias("manual_search"))
    row = report.worse_than_manual(report.baseline(twenty(spark), verdicts, none), True).first()
    assert (row.measured, row.missing, row.win, row.lose, row.tie, row.comparable, row.worse_than_manual) == (0, 20, 0, 0, 0, False, False)
    assert row.manual_seconds_mean is None


def test_verdict_sets(spark):
    results = spark.createDataFrame([("a", False, None), ("a", False, None), ("b", True, '{"x":1}'), ("c", True, "{}")], "id string, ok boolean, parsed string")
    prior = spark.createDataFrame([("a", "hit")], "id string, verdict string")
    new = judge.force(results, prior, F.lit(False))
    assert [(r.id, r.verdict) for r in new.collect()] == [("c", "miss")]
    assert sorted((r.id, r.verdict) for r in judge.merge(prior, new.union(spark.createDataFrame([("a", "miss", "r")], new.schema))).collect()) == [("a", "hit"), ("c", "miss")]
    assert judge.judged(results, prior).count() == 2
    assert [r.id for r in judge.to_judge(results, judge.merge(prior, new)).collect()] == ["b"]
    assert {(r.id, r.verdict, r.verdict_forced) for r in judge.with_verdicts(results, prior, F.lit(False)).collect()} == {("a", "hit", True), ("b", None, False), ("c", None, True)}
    odd = spark.createDataFrame([("a", "perhaps"), ("b", "hit")], "id string, verdict string")
    assert judge.unknown_verdicts(odd).count() == 1
    with pytest.raises(Exception, match="unknown verdict"):
        judge.assert_known(odd).collect()


def test_ids(spark):
    files = spark.createDataFrame([("z.jpg",), ("x.jpg",), ("y.jpg",)], "file string")
    used = spark.createDataFrame([("p02",), ("p04",)], "id string")
    got = {r.file: r.id for r in manifest.allocate_ids(files, used).collect()}
    assert got == {"x.jpg": "p01", "y.jpg": "p03", "z.jpg": "p05"}
    many = spark.range(120).select(F.format_string("f%03d", "id").alias("file"))
    got = {r.file: r.id for r in manifest.allocate_ids(many, used.limit(0)).collect()}
    assert got["f099"] == "p100" and len(set(got.values())) == 120


def test_refresh(spark):
    scanned = spark.createDataFrame([("a.jpg", 4, 3), ("n.jpg", 2, 1)], "file string, width int, height int")
    before = items(spark, {"id": "p01", "difficulty": "old"}, {"id": "p07", "difficulty": "hard"}, {"id": "p02", "file": "gone.jpg"})
    got = {r.file: r for r in manifest.refresh(scanned, before).collect()}
    assert set(got) == {"a.jpg", "n.jpg"}
    assert (got["a.jpg"].id, got["a.jpg"].difficulty, got["a.jpg"].is_new) == ("p07", "hard", False)
    assert (got["n.jpg"].id, got["n.jpg"]._size, got["n.jpg"].is_new) == ("p03", [2, 1], True)


def test_last_wins_before_a_join(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("b", 2, 3)], "id string, pos int, v int")
    assert sorted((r.id, r.v) for r in last_wins(df, "id").collect()) == [("a", 2), ("b", 3)]


REPLIES = [
    ('```json\n{"a": 1}\n```', {"a": 1}),
    ('{"a": "}{"}', {"a": "}{"}),
    ('{"a": "\\"}"} x', {"a": '"}'}),
    ("{not json} then {\"a\": 2}", {"a": 2}),
    ('{ open and {"a": 1}', None),
    ('say " and {"a": 1}', None),
    ('[{"a": 1}, {"a": 2}]', {"a": 1}),
    ("{}", {}),
    ("", None),
    (None, None),
    ("} {\"a\": {\"b\": 1}}", {"a": {"b": 1}}),
    ('{"a": 1, "a": 2}', {"a": 2}),
    ("no \\ braces", None),
]


def test_first_object(spark):
    assert [first_object(t) for t, _ in REPLIES] == [w for _, w in REPLIES]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(REPLIES)], "i int, t string")
    got = {r.i: r.j for r in df.select("i", extract_json("t").alias("j")).collect()}
    assert [got[i] and json.loads(got[i]) for i in range(len(REPLIES))] == [w if w != {} else {} for _, w in REPLIES]
    assert first_object('{"a": NaN}')["a"] != first_object('{"a": NaN}')["a"]


def test_scalars(spark):
    df = spark.createDataFrame([(2048, 1000), (800, 400), (5000, 2)], "w int, h int")
    assert [tuple(r[0]) for r in df.select(scalars.scaled(F.col("w"), F.col("h"))).collect()] == [(1024, 500), (800, 400), (1024, 0)]
    one = spark.range(1)
    assert one.select(scalars.sha16(F.lit("abc"))).first()[0] == "ba7816bf8f01cfea"
    assert len(one.select(scalars.base64_line(F.lit(b"x" * 300))).first()[0]) == 400
    assert one.select(scalars.strip_fences(F.lit("\n```json\n{}\n```\n"))).first()[0] == "{}"
    boxes = spark.createDataFrame([([0, 0, 4, 50],), (None,), ([0, 0, 8, 8],), ([1, 1],)], "b array<int>")
    assert [r[0] for r in boxes.select(scalars.crop_error(F.col("b"), F.lit(100), F.lit(100))).collect()] == ["box is too small", None, None, "bad box V3"]
    # Of 12 rows, 1 and 5 are bars of 2.5 and 12.5: halves go to the even side.
    rows = spark.createDataFrame([(str(i),) for i in range(12)], "id string")
    verdicts = rows.withColumn("verdict", F.when(F.col("id") == "0", "hit").when(F.col("id").cast("int") < 6, "partial").otherwise("miss"))
    assert {r.verdict: r.bar for r in report.verdict_counts(rows, verdicts).collect()} == {"hit": 2, "partial": 12, "miss": 15}


def test_photo_scan(spark, tmp_path):
    for name, content in {"b.PNG": png(30, 20), "_u.jpg": jpeg(8, 6), "r.jpeg": jpeg(800, 400, 6), "c.heic": b"x", "bad.png": b"x", "n.txt": b"x", ".hidden.png": png(1, 1)}.items():
        (tmp_path / name).write_bytes(content)
    got = {r.file: (r["class"], r.width, r.height) for r in photos.scan_photos(spark, str(tmp_path)).collect()}
    assert got == {"b.PNG": ("readable", 30, 20), "_u.jpg": ("readable", 8, 6), "r.jpeg": ("readable", 400, 800), "c.heic": ("unreadable", None, None), "bad.png": ("unreadable", None, None), "n.txt": ("ignored", None, None)}
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        photos.scan_photos(spark, str(tmp_path / "none")).collect()


def tiff(order, width, height, turn):
    entry = lambda tag, kind, v: struct.pack(f"{order}HHI", tag, kind, 1) + struct.pack(f"{order}{'HI'[kind == 4]}", v).ljust(4, b"\0")
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(f"{order}IH", 8, 3) + entry(0x100, 4, width) + entry(0x101, 3, height) + entry(0x112, 3, turn) + b"\0" * 4


def test_headers():
    whole = round_trips.stub_png(5, 6)
    assert photos.header_size(whole) == (5, 6) and [photos.header_size(whole[:n]) for n in range(len(whole))] == [None] * len(whole)
    turned = whole[:33] + struct.pack(">I", len(tiff(">", 1, 1, 6))) + b"eXIf" + tiff(">", 1, 1, 6) + struct.pack(">I", zlib.crc32(b"eXIf" + tiff(">", 1, 1, 6))) + whole[33:]
    assert photos.header_size(turned) == (6, 5)
    for order in "<>":
        assert photos.header_size(tiff(order, 70000, 20, 1)) == (70000, 20) and photos.header_size(tiff(order, 30, 20, 8)) == (20, 30)
        assert photos.header_size(tiff(order, 30, 20, 1)[:20]) is None
    chunk = lambda kind, body: kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    body = b"WEBP" + chunk(b"VP8X", b"\0" * 4 + (29).to_bytes(3, "little") + (19).to_bytes(3, "little")) + chunk(b"EXIF", b"Exif\0\0" + tiff("<", 1, 1, 5))
    webp = b"RIFF" + struct.pack("<I", len(body)) + body
    assert photos.header_size(webp) == (20, 30) and photos.header_size(webp[:-1]) is None
    assert photos.header_size(b"BM" + b"\0" * 12 + struct.pack("<Iii", 40, 7, -9)) == (7, 9) and photos.header_size(b"BM") is None
    assert photos.header_size(None) is None and photos.header_size(b"RIFF") is None and photos.header_size(jpeg(8, 6)[:3]) is None


def test_numbers_without_one_sort(spark):
    for n in (0, 1, 3, 500):
        df = spark.range(n).select((F.col("id") * 7919 % 1009).cast("string").alias("k"))
        got = {r.k: r.place for r in schemas.numbered(df, "k", "place", parts=7).collect()}
        assert got == {k: i for i, k in enumerate(sorted(str(x * 7919 % 1009) for x in range(n)), 1)}


def test_exact_median(spark):
    for values in ([], [None], [3.0], [1.0, 2.0, 3.0, 4.0], [0.5, 0.5, 0.9, 7.25, None], [-1.5, -1.25], [5.0] * 9 + [1.0]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        known = [v for v in values if v is not None]
        assert report.exact_median(df, "v").first().median == (statistics.median(known) if known else None)


def test_loose_manifest_and_only(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"id": "p01", "bbox": "no", "file": "a"}, 7, {"id": "p02", "bbox": [1, 2]}]')
    rows = manifests.read_loosely(spark, str(tmp_path / "m.json")).orderBy("pos").collect()
    assert [(r.id, r.bbox, r.raw[:5]) for r in rows] == [("p01", None, '{"id"'), (None, None, "7"), ("p02", [1, 2], '{"id"')]
    (tmp_path / "o.json").write_text('{"id": 1}')
    with pytest.raises(manifests.ManifestError):
        manifests.read_loosely(spark, str(tmp_path / "o.json"))
    some = items(spark, {"id": "p01"}, {"id": "p02"})
    assert manifests.only(some, None).count() == 2 and [r.id for r in manifests.only(some, "p02").collect()] == ["p02"]
    with pytest.raises(manifests.ManifestError, match="p09"):
        manifests.only(some, "p09")


def test_report_text():
    coverage = {"hit_rate": 40.0, "n": 10, "unjudged": 5, "is_lower_bound": True, "smoke": False}
    verdicts = [{"place": 1, "verdict": "partial", "n": 1, "share": 10.0, "bar": 3}, {"place": 0, "verdict": "hit", "n": 4, "share": 40.0, "bar": 12}]
    strata = [{"difficulty": "hard", "hit": 0, "judged": 0, "hit_rate": None}, {"difficulty": "easy", "hit": 4, "judged": 5, "hit_rate": 80.0}]
    manual = {"comparable": True, "manual_successes": 3, "measured": 4, "manual_seconds_mean": 12.0, "model_hits": 2, "win": 1, "lose": 2, "tie": 1, "missing": 1, "worse_than_manual": True}
    text = cards.render_report(coverage, verdicts, strata, {"n_ok": 5, "latency_median": 1.25, "latency_max": 9.0, "tokens_mean": 100.4, "grounded": 2}, manual)
    assert text.index("hit ") < text.index("partial") and "easy 4/5 (80%)" in text and "hard" not in text
    assert "grounded 2/5" in text and "manual search 3/4, 12 s each; model 2/4" in text and "worse than manual" in text and "1 rows without" in text
    nothing = cards.render_report(coverage, manual={"comparable": False, "missing": 20})
    assert "0 measured" in nothing and "excluded" in nothing


def test_manifest_files(spark, tmp_path):
    path = str(tmp_path / "manifest.json")
    manifests.write_manifest(items(spark, {"id": "p01"}, {"id": "p02", "file": "ö.jpg"}), path)
    rows = manifests.read_manifest(spark, path).orderBy("pos")
    assert [(r.id, r.file, r.truth.brand) for r in rows.collect()] == [("p01", "a.jpg", "b"), ("p02", "ö.jpg", "b")]
    assert json.loads((tmp_path / "manifest.json").read_text())[0]["bbox"] is None
    manifests.write_manifest(rows.where("id = 'p02'"), path)
    assert [r.id for r in manifests.read_manifest(spark, path).collect()] == ["p02"]
    (tmp_path / "broken.json").write_text("[{")
    with pytest.raises(manifests.ManifestError):
        manifests.read_manifest(spark, str(tmp_path / "broken.json"))
    (tmp_path / "empty.json").write_text("[]")
    with pytest.raises(manifests.ManifestError):
        manifests.read_manifest(spark, str(tmp_path / "empty.json"), must_have_rows=True)


def test_run_log_and_verdicts(spark, tmp_path):
    record = runlog.to_record({"model": "m", "grounding": True, "timestamp": "20240101-000000"}, [{"id": "p01", "ok": True, "parsed": {"a": 1}}, {"id": "p02", "ok": False, "http": 500}])
    (tmp_path / "run-x.json").write_text(record)
    header, results = runlog.read_run(spark, str(tmp_path / "run-x.json"))
    assert (header.first().model, header.first().n, header.first().grounding) == ("m", 2, True)
    assert [(r.id, r.parsed, r.http) for r in results.orderBy("pos").collect()] == [("p01", '{"a":1}', None), ("p02", None, 500)]
    assert runlog.run_name("/a/run-x.json") == "x"
    assert runlog.read_verdicts(spark, str(tmp_path / "none.json"), "x").count() == 0
    (tmp_path / "v.json").write_text('{"p01": "hit"}')
    assert [tuple(r) for r in runlog.read_verdicts(spark, str(tmp_path / "v.json"), "x").collect()] == [("x", "p01", "hit")]
    runlog.append_results(results.drop("pos"), str(tmp_path / "parts"))
    runlog.append_results(results.drop("pos").limit(1), str(tmp_path / "parts"))
    assert runlog.read_results(spark, str(tmp_path / "parts")).count() == 3
    assert report.run_outcome(results).first().exit_code == 0
    assert report.run_outcome(results.where("not ok")).first().exit_code == 2


def test_catalogue_and_settings(spark, tmp_path):
    said = {"models": [{"name": "models/b", "displayName": "B", "supportedGenerationMethods": ["generateContent"]}, {"name": "models/a", "displayName": "A", "supportedGenerationMethods": ["generateContent"]}, {"name": "models/c", "displayName": "C"}]}
    rows = runlog.generating_models(runlog.read_catalogue(spark, "http://x", lambda _: json.dumps(said))).collect()
    assert [r.name for r in rows] == ["a", "b"]
    (tmp_path / "env").write_text("# c\n\nA='1=2'\nnothing\n")
    assert runlog.find_key("A", [str(tmp_path / "none"), str(tmp_path / "env")], {}) == "1=2"
    assert runlog.find_key("A", [str(tmp_path / "env")], {"A": "e"}) == "e"
    assert runlog.find_key("B", [], {}) is None


GOOD = {"candidates": [{"content": {"parts": [{"text": '{"brand":'}, {}, {"text": '"x"}'}]}, "groundingMetadata": {"webSearchQueries": ["q"]}}], "usageMetadata": {"totalTokenCount": 7}}


def fake(url, body, timeout):
    asked = json.loads(body)["contents"][0]["parts"][1]["inline_data"]["data"]
    if asked == "YQ==":
        return 200, json.dumps(GOOD)
    if asked == "Yg==":
        return 500, "no: key=SECRET " + "x" * 2000
    if asked == "Yw==":
        return 200, "not json"
    raise OSError("cannot reach " + url)


def test_inference(spark):
    rows = [(f"p{i}", "f", "easy", "s", None, [1, 2], 9, bytes([c]), "answer") for i, c in enumerate(b"abcd")]
    df = spark.createDataFrame(rows, "id string, file string, difficulty string, photo_sha string, bbox array<int>, crop_px array<int>, crop_bytes bigint, jpeg binary, truth string")
    assert "truth" not in infer.measured_view(df).columns
    got = {r.id: r for r in infer.infer(df, "what", "http://host/m", "SECRET", True, fake).collect()}
    assert got["p0"].ok and json.loads(got["p0"].parsed) == {"brand": "x"} and got["p0"].tokens.total == 7 and got["p0"].grounding_queries == ["q"]
    assert (got["p1"].ok, got["p1"].http, len(got["p1"].error)) == (False, 500, 1500)
    assert (got["p2"].ok, got["p2"].http) == (False, 200)
    assert (got["p3"].ok, got["p3"].http) == (False, None)
    assert not any("SECRET" in (r.error or "") for r in got.values())
    assert got["p0"].crop_px == [1, 2]
    flat = spark.range(1).select(infer.flatten_envelope(F.lit(json.dumps(GOOD))).alias("r")).first().r
    assert (flat.raw_text, flat.grounding_used, flat.tokens.total) == ('{"brand":"x"}', True, 7)


def test_stream_is_durable(spark, tmp_path):
    source, kept, checkpoint = (str(tmp_path / x) for x in ("in", "kept", "checkpoint"))
    one = spark.createDataFrame([("a", False), ("b", True)], "id string, ok boolean")
    runlog.append_results(one.limit(1).coalesce(1), source)
    streams.append_durably(streams.result_stream(spark, source), kept, checkpoint).awaitTermination()
    runlog.append_results(one.where("id = 'b'").coalesce(1), source)
    streams.append_durably(streams.result_stream(spark, source), kept, checkpoint).awaitTermination()
    back = spark.read.schema(RESULT).json(kept)
    assert sorted(r.id for r in back.collect()) == ["a", "b"]
    assert [(r.id, r.reason) for r in streams.forced_stream(back.orderBy("id"), False).collect()] == [("a", "call failed"), ("b", "no answer could be read")]


def test_decision(spark):
    cases = [(False, 70.0, 50.0, None, "continue"), (False, 60.0, 55.0, None, "undetermined"), (False, 90.0, 29.0, None, "stop"), (True, 50.0, 30.0, None, "continue"), (True, 50.0, 20.0, None, "redesign"), (True, 50.0, 9.0, None, "stop"), (True, 60.0, 40.0, 41.0, "stop"), (True, 40.0, 40.0, 0.0, "undetermined")]
    df = spark.createDataFrame(cases, "g boolean, easy double, overall double, manual double, want string")
    assert [r for r in df.select(decision.decide(F.col("g"), F.col("easy"), F.col("overall"), F.col("manual")).alias("got"), "want").collect() if r.got != r.want] == []


def test_pixels_say_what_is_missing():
    from tallyframe.functions import images

    try:
        import PIL  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="Pillow"):
            images.crop_jpeg(png(3, 3), None)
