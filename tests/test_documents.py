"""Large JSON documents by byte ranges, their writer, and the first object of a text, against Python's own reader."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.functions.extract import extract_json, first_object
from tallyframe.sources import json_array, manifest, runlog


@pytest.fixture
def split(spark):
    """Sets how many bytes a range has."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def to(n):
        for name in names:
            spark.conf.set(name, str(n))

    yield to
    for name, value in before.items():
        spark.conf.set(name, value)


def awkward(r, deep=0):
    """A JSON value with everything in its strings that could mislead a scan."""
    kind = r.randrange(9 if deep < 3 else 6)
    if kind < 3:
        return "".join(r.choice(['"', "\\", "{", "}", "[", "]", ",", "é", "😀", "\n", "a", ":", '"results": [', '\\"']) for _ in range(r.randrange(12)))
    if kind < 6:
        return r.choice([None, True, 7, -1.5, ""])
    if kind < 8:
        return {r.choice(["a", "results", "{", '"', "b}"]) + str(i): awkward(r, deep + 1) for i in range(r.randrange(4))}
    return [awkward(r, deep + 1) for _ in range(r.randrange(4))]


def plain(raw):
    """Elements are JSON texts, but strings their values and null a null."""
    return raw


def as_read(value):
    return value if isinstance(value, str) else None if value is None else json.loads(json.dumps(value))


def read(spark, path, key=None):
    outer, rows = json_array.elements(spark, str(path), key)
    found = sorted((r.pos, r.raw) for r in rows.collect())
    assert [p for p, _ in found] == list(range(len(found)))
    return outer.first().value, [r for _, r in found]


def same(raw, value):
    return raw == value if value is None or isinstance(value, str) else json.loads(raw) == value


@pytest.mark.parametrize("seed", range(3))
def test_arrays_in_any_ranges(spark, split, tmp_path, seed):
    r = random.Random(seed)
    items = [awkward(r) if r.random() < 0.3 else {"id": f"p{i}", "v": awkward(r)} for i in range(60)]
    text = json.dumps(items, ensure_ascii=False, indent=r.choice([None, 2]))
    (tmp_path / "a.json").write_text(text)
    for size in (1 << 20, 700, 97):
        split(size)
        ranges = spark.read.option("lineSep", "}").text(str(tmp_path / "a.json")).select("_metadata.file_block_start").distinct().count()
        assert ranges >= len(text.encode()) // size  # there are that many
        outer, found = read(spark, tmp_path / "a.json")
        assert outer.strip("[] \n\t") == "" and len(found) == len(items)
        assert all(map(same, found, items))


def test_run_logs_in_any_ranges(spark, split, tmp_path):
    r = random.Random(9)
    results = [{"id": f"p{i:03}", "file": '"results": [{"', "ok": i % 3 > 0, "parsed": {"links": ["{", "}]"], "results": [{"x": 1}]} if i % 2 else None, "raw_text": 'so: "}{"\\ ' * r.randrange(5), "tokens": {"in": 1, "out": 2, "total": i}} for i in range(80)]
    provenance = {"prompt_sha": "a", "manifest_sha": "b", "subset": None, "prereg_tag": '"results": [', "smoke": True}
    header = {"model": "m {[", "grounding": True, "timestamp": "20240101-000000", "provenance": provenance}
    # The array may stand anywhere at the top, and inner ones of the same name don't count.
    for document in (header | {"n": 80, "results": results}, {"inner": {"results": [{"id": "no"}], "a": [{}, {}]}, "results": results, "after": [{"results": [1]}, {}]} | header | {"n": 80}):
        (tmp_path / "run-a.json").write_text(json.dumps(document, ensure_ascii=False))
        for size in (1 << 20, 64 << 4, 150):
            split(size)
            head, rows = runlog.read_run(spark, str(tmp_path / "run-a.json"))
            first = head.first()
            assert (first.model, first.n, first.provenance.prereg_tag, first.provenance.smoke) == ("m {[", 80, '"results": [', True)
            found = rows.orderBy("pos").collect()
            assert [(x.pos, x.id, x.file, x.ok, x.raw_text, x.tokens.total) for x in found] == [(i, x["id"], x["file"], x["ok"], x["raw_text"], x["tokens"]["total"]) for i, x in enumerate(results)]
            assert [x.parsed and json.loads(x.parsed) for x in found] == [x["parsed"] for x in results]


def test_small_documents(spark, tmp_path):
    for n, value in enumerate(([], [[]], [{}], [1], ["a", None, {"a": 1}, [2], {}], [{"a": []}, 5])):
        for m, text in enumerate((json.dumps(value), f" \n{json.dumps(value, indent=1)}\n ")):
            (tmp_path / f"{n}-{m}.json").write_text(text)
            outer, found = read(spark, tmp_path / f"{n}-{m}.json")
            assert len(found) == len(value) and all(map(same, found, value))
    for n, (text, rows, outer) in enumerate((('{"results": []}', 0, {"results": []}), ('{"a": {"results": [{}]}}', 0, {"a": {"results": [{}]}}), ('{"results": [{"a": 1}, 2], "b": {"c": []}}\n', 2, {"results": [], "b": {"c": []}}))):
        (tmp_path / f"o{n}.json").write_text(text)
        around, found = read(spark, tmp_path / f"o{n}.json", "results")
        assert json.loads(around) == outer and len(found) == rows


@pytest.mark.parametrize("text", ["", " ", "[", "[{", '[{"a": 1}', '[{"a": 1},]', '[{"a": 1} {"b": 2}]', "[,1]", "[1,,2]", "[1] [2]", "[1]]", '{"id": 1}', "7", '[{"a": "}]', '[{"a": 1]}', "[{'a': 1}]", '[{"a": 1}] x', 'x [{"a": 1}]', '[{"a": b}]'])
def test_wrong_documents_raise(spark, split, tmp_path, text):
    (tmp_path / "w.json").write_text(text)
    split(4)
    with pytest.raises(json_array.DocumentError):
        json_array.elements(spark, str(tmp_path / "w.json"))
    with pytest.raises(manifest.ManifestError):
        manifest.read_manifest(spark, str(tmp_path / "w.json"))


@pytest.mark.parametrize("text", ['{"results": [{"a": 1}]', '{"results": [{"a": 1}', '{"results": [{"a": 1},]}', '{"results": [{"a": 1}]}}'])
def test_cut_off_runs_raise(spark, tmp_path, text):
    (tmp_path / "w.json").write_text(text)
    with pytest.raises(json_array.DocumentError):
        runlog.read_run(spark, str(tmp_path / "w.json"))


def test_pieces_are_no_larger_than_items(spark, tmp_path):
    items = [{"id": i, "text": "x" * 200} for i in range(3000)]
    (tmp_path / "a.json").write_text(json.dumps(items))
    document = json_array.open_document(spark, str(tmp_path / "a.json"))
    longest = document.chunks().agg(F.max(F.length("listed"))).first()[0]
    assert longest <= max(len(json.dumps(i)) for i in items) + 4  # brackets, a comma and a blank
    assert document.raw.agg(F.max(F.length("value"))).first()[0] <= longest
    assert document.rows().where("kind = 1").count() <= 2 * len(document.starts)


def test_ranges_that_change_raise(spark, split, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": i} for i in range(200)]))
    split(300)
    _, rows = json_array.elements(spark, str(tmp_path / "a.json"))
    split(170)
    with pytest.raises(Exception, match="has changed since"):
        rows.collect()


def test_array_writer(spark, split, tmp_path):
    r = random.Random(2)
    values = [{"n": i, "v": awkward(r)} for i in range(500)]
    rows = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=False)) for i, v in enumerate(values)], "pos long, value string")
    path = tmp_path / "w.json"
    json_array.write_array(rows.repartition(7), str(path))
    assert json.loads(path.read_text()) == values
    json_array.write_array(rows.where("pos % 100 = 3"), str(path), '{"a": [', "]}")
    assert json.loads(path.read_text()) == {"a": values[3::100]}
    json_array.write_array(rows.limit(0), str(path))
    assert json.loads(path.read_text()) == []
    # A file is read and replaced by what was read from it.
    json_array.write_array(rows, str(path))
    split(500)
    _, back = json_array.elements(spark, str(path))
    json_array.write_array(back.where("pos >= 2").select("pos", F.col("raw").alias("value")), str(path))
    assert json.loads(path.read_text()) == values[2:]
    assert [p.name for p in tmp_path.iterdir() if p.suffix != ".crc"] == ["w.json"]


def test_writer_that_is_lost(spark, tmp_path, monkeypatch):
    """Between the parts and the commit, in the middle of the commit and before the rename the old file is whole."""
    path = tmp_path / "w.json"
    path.write_text("[1]")
    rows = spark.createDataFrame([(i, str(i)) for i in range(50)], "pos long, value string").repartition(3)

    def lost(*a, **k):
        raise RuntimeError("lost")

    def half(spark, parts, to, before, after, f=json_array.join_parts):
        f(spark, parts, to, before, after)
        lost()

    def cut(spark, parts, to, before, after, f=json_array.join_parts):
        assert any(p.name.startswith("part-") for p in next(tmp_path.glob("w.json.*/parts")).iterdir())
        next(next(tmp_path.glob("w.json.*/parts")).glob("_SUCCESS")).unlink()
        return f(spark, parts, to, before, after)

    for how, wrong in ((lost, RuntimeError), (half, RuntimeError), (cut, json_array.DocumentError)):
        with monkeypatch.context() as m:
            m.setattr(json_array, "join_parts", how)
            with pytest.raises(wrong):
                json_array.write_array(rows, str(path))
        assert path.read_text() == "[1]"
    json_array.write_array(rows, str(path))
    assert json.loads(path.read_text()) == list(range(50))


def test_run_writer(spark, tmp_path):
    schema = "pos long, id string, ok boolean, http int, parsed string, raw_text string"
    results = spark.createDataFrame([(0, "a", True, None, '{"links": ["}"]}', "é"), (1, "b", False, 503, None, None), (2, "c", True, None, None, ""), (3, None, None, None, None, None)], schema)
    header = spark.createDataFrame([("m", True, "t", 9)], "model string, grounding boolean, timestamp string, n int")
    path = tmp_path / "run-x.json"
    runlog.write_run(header, results, str(path))
    assert json.loads(path.read_text()) == {"model": "m", "grounding": True, "timestamp": "t", "n": 4, "results": [{"id": "a", "ok": True, "raw_text": "é", "parsed": {"links": ["}"]}}, {"id": "b", "ok": False, "http": 503}, {"id": "c", "ok": True, "raw_text": "", "parsed": None}, {}]}
    head, back = runlog.read_run(spark, str(path))
    assert (head.first().n, head.first().model) == (4, "m")
    assert back.select("pos", "id", "ok", "http", "parsed", "raw_text").orderBy("pos").collect() == [r if r.parsed is None else r.__class__(**(r.asDict() | {"parsed": '{"links":["}"]}'})) for r in results.collect()]


def test_first_object_of_awkward_texts(spark):
    r = random.Random(3)
    signs = ["{", "}", '"', "\\", '{"a": 1}', '{"b": "}"}', "```", "```json\n", "\n", " ", "x", "é", "😀", '{"a": {"b": [1, {}]}}', '{"q": "\\""}', "{'a': 1}", "{bad}", '{"n": NaN}', '{"d": 1, "d": 2}', " "]
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(9))) for _ in range(1500)] + [None, "", "{}" * 50, '{"a":' * 30 + "1" + "}" * 30, "{x}" * 3000 + '{"a": 2}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    got = {x.i: x.j for x in df.select("i", extract_json("t").alias("j")).collect()}
    for i, t in enumerate(texts):
        want = first_object(t)
        assert (got[i] is None) == (want is None), t
        assert want is None or repr(json.loads(got[i])) == repr(want), t
    plan = df.select(extract_json(F.col("t")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
