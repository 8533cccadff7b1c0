"""The jobs end to end, by their command line, and inference that is broken off."""

import base64
import hashlib
import json
import random

import numpy as np
import pytest

from tallyframe.__main__ import main
from tallyframe.functions import pixels
from tallyframe.round_trips import stub_png
from tallyframe.sources import runlog
from tallyframe.streaming import inference


def picture(width):
    return pixels.encode_png(np.random.default_rng(width).integers(0, 256, (30, width, 3), np.uint8))


@pytest.fixture
def photos(tmp_path):
    folder = tmp_path / "photos"
    folder.mkdir()
    for n, name in enumerate(("b.png", "a.png", "c.PNG", "_d.png")):
        (folder / name).write_bytes(picture(40 + n))
    (folder / "cut.png").write_bytes(stub_png(4, 4)[:-6])
    (folder / "x.heic").write_bytes(b"heic")
    (folder / "notes.txt").write_text("no photo")
    return folder


def model_of(calls):
    """A model that knows photos by their width, fails for one, and writes down what it was asked."""

    def transport(url, body, timeout):
        asked = json.loads(body)
        width = int.from_bytes(base64.b64decode(asked["contents"][0]["parts"][1]["inline_data"]["data"])[16:20], "big")
        with open(calls, "a") as out:
            out.write(f"{width} {'tools' in asked} {url.split('?')[0]}\n")
        if width == 41:
            return 503, "busy"
        reply = {"category": "bag", "brand": "b", "model": None, "links": ["http://a"] if width != 42 else []}
        return 200, json.dumps({"candidates": [{"content": {"parts": [{"text": f"so:\n```json\n{json.dumps(reply)}\n```"}]}, "groundingMetadata": {"webSearchQueries": ["q"]}}], "usageMetadata": {"totalTokenCount": width}})

    return transport


def test_from_photos_to_report(spark, photos, tmp_path):
    said, calls, results = [], tmp_path / "calls", tmp_path / "results"
    run = lambda *argv, **others: main([str(a) for a in argv], spark, out=said.append, **others)
    path = photos / "manifest.json"
    assert run("prepare", "--photos", photos) == 0
    items = json.loads(path.read_text())
    assert [(i["id"], i["file"], i["_size"], i["difficulty"]) for i in items] == [("p01", "_d.png", [43, 30], "easy"), ("p02", "a.png", [41, 30], "easy"), ("p03", "b.png", [40, 30], "easy"), ("p04", "c.PNG", [42, 30], "easy")]
    assert any("cut.png" in s and "x.heic" in s for s in said)
    assert run("check", "--photos", photos) == 1 and any(s.startswith("error V7 p01") for s in said)
    assert run("check", "--photos", photos, "--smoke") == 0
    for i in items:
        i["truth"] = {"brand": "b", "model": None, "url": ""}
        i["manual_search"] = {"seconds": 10.0, "success": i["id"] == "p01"}
    items = [i for i in items if i["file"] != "_d.png"]  # a name that only the scan knows
    path.write_text(json.dumps(items, ensure_ascii=False, indent=2))
    assert run("check", "--photos", photos) == 0 and any("V9" in s for s in said)
    # What people wrote stays, a photo that comes gets the id that is free, and a broken manifest is left alone.
    (photos / "0.png").write_bytes(picture(44))
    assert run("prepare", "--photos", photos) == 0
    assert {i["file"]: i["id"] for i in json.loads(path.read_text())} == {"0.png": "p01", "_d.png": "p05", "a.png": "p02", "b.png": "p03", "c.PNG": "p04"}
    assert json.loads(path.read_text())[2]["truth"]["brand"] == "b"
    path.write_text(path.read_text()[:-3])
    assert run("prepare", "--photos", photos) == 1 and run("check", "--photos", photos) == 1
    path.write_text(json.dumps(items))

    ask = ("identify", "--photos", photos, "--results", results, "--model", "m-1", "--endpoint", "http://host", "--key-name", "SOME_KEY", "--settings", tmp_path / "env", "--stamp", "20240101-000000")
    assert run(*ask) == 1 and "no key" in said[-1]
    (tmp_path / "env").write_text("SOME_KEY='k=1'\n")
    fake = {"transport": model_of(calls), "crop": pixels.crop_picture}
    assert run(*ask, "--only", "p99", **fake) == 1 and not calls.exists()
    assert run(*ask, "--tag", "v1", **fake) == 0
    assert sorted(calls.read_text().splitlines()) == [f"{w} True http://host/models/m-1:generateContent" for w in (40, 41, 42)]
    log = json.loads((results / "run-20240101-000000.json").read_text())
    assert (log["model"], log["grounding"], log["n"], log["timestamp"]) == ("m-1", True, 3, "20240101-000000")
    assert log["provenance"]["manifest_sha"] == hashlib.sha256(path.read_bytes()).hexdigest()[:16] and log["provenance"]["prereg_tag"] == "v1" and log["provenance"]["subset"] == "all"
    assert [r["id"] for r in log["results"]] == ["p02", "p03", "p04"] and "truth" not in json.dumps(log["results"])
    assert log["results"][0]["crop_px"] == [41, 30] and log["results"][0]["http"] == 503 and log["results"][1]["parsed"]["links"] == ["http://a"] and log["results"][1]["tokens"] == {"total": 40}
    assert log["results"][1]["photo_sha"] == hashlib.sha256((photos / "b.png").read_bytes()).hexdigest()[:16]
    assert [p.name for p in results.iterdir() if p.suffix != ".crc"] == ["run-20240101-000000.json"]

    done = results / "run-20240101-000000.json"
    assert run("score", done, "--photos", photos, "--report") == 1 and said[-1] == "nothing is judged yet"
    said.clear()
    assert run("show", done, "--photos", photos) == 0 and len(said) == 3 and "unsupported: True" in said[2] and "true_brand: b" in said[1] and "503" in said[0]
    (tmp_path / "mine.json").write_text('{"p03": "hit", "p02": "hit", "p77": "hit"}')
    assert run("score", done, "--photos", photos, "--judged", tmp_path / "mine.json") == 0
    assert json.loads((results / "score-20240101-000000.json").read_text()) == {"p02": "miss", "p03": "hit", "p04": "miss"}
    assert "hit rate 33.3% of 3, unjudged 0" in said[-1] and "manual search 0/3" in said[-1] and "pairs: 1 won, 0 lost, 2 tied" in said[-1]
    (tmp_path / "mine.json").write_text('{"p03": "miss"}')
    assert run("score", done, "--photos", photos, "--judged", tmp_path / "mine.json") == 0 and "hit rate 33.3%" in said[-1]
    (results / "score-20240101-000000.json").write_text('{"p03": "maybe"}')
    assert run("score", done, "--photos", photos, "--report") == 1 and "p03: maybe" in said[-1]
    # A box that can't be cropped or a missing photo ends a run before anything is asked.
    before = calls.read_text()
    path.write_text(json.dumps([items[0], items[1] | {"bbox": [1, 2, 3]}, items[2] | {"file": "gone.png"}]))
    ask = [a if a != "20240101-000000" else "20240101-000001" for a in ask]
    assert run(*ask, "--no-grounding", **fake) == 1 and "bad box" in said[-1] and "no such photo" in said[-1] and calls.read_text() == before
    path.write_text(json.dumps(items[:1]))
    assert run(*ask, "--no-grounding", "--smoke", **fake) == 2  # every call failed
    assert calls.read_text().splitlines()[-1].split()[:2] == ["41", "False"]


def test_models_are_listed(spark, monkeypatch):
    said = []
    listing = json.dumps({"models": [{"name": "models/b", "displayName": "B", "supportedGenerationMethods": ["generateContent"]}, {"name": "models/a"}]})
    monkeypatch.setenv("SOME_OTHER_KEY", "k")
    assert main(["models", "--key-name", "SOME_OTHER_KEY"], spark, get=lambda url: listing, out=said.append) == 0
    assert said == ["b  B"]


def test_inference_goes_on_where_it_broke_off(spark, tmp_path):
    calls, broken = tmp_path / "calls", tmp_path / "broken"
    r = random.Random(1)
    rows = [(f"p{i:02}", f"f{i}", "easy", "s", None, [1, 2], 9, bytes([i]) * 3, "secret") for i in range(40)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "id string, file string, difficulty string, photo_sha string, bbox array<int>, crop_px array<int>, crop_bytes bigint, jpeg binary, truth string")
    inference.stage_items(df.coalesce(1), str(tmp_path / "staged"), rows_at_once=5)
    assert "truth" not in spark.read.parquet(str(tmp_path / "staged")).columns
    assert len(list((tmp_path / "staged").glob("part-*"))) == 8

    def transport(url, body, timeout):
        n = base64.b64decode(json.loads(body)["contents"][0]["parts"][1]["inline_data"]["data"])[0]
        with calls.open("a") as out:
            out.write(f"{n}\n")
        if n == 17 and not broken.exists():
            broken.touch()
            raise RuntimeError("the machine goes down")
        return 200, json.dumps({"candidates": [{"content": {"parts": [{"text": '{"n": %d}' % n}]}}]})

    run = str(tmp_path / "run")
    start = lambda: inference.infer_durably(spark, str(tmp_path / "staged"), run, "what", "http://h", "", False, transport)
    with pytest.raises(Exception, match="goes down"):
        start().awaitTermination()
    kept = runlog.read_results(spark, f"{run}/results").count()
    assert kept % 5 == 0 and kept < 40
    start().awaitTermination()
    found = runlog.read_results(spark, f"{run}/results")
    assert sorted((x.id, json.loads(x.parsed)["n"]) for x in found.collect()) == [(f"p{i:02}", i) for i in range(40)]
    asked = [int(n) for n in calls.read_text().split()]
    assert set(asked) == set(range(40)) and len(asked) <= 40 + 5  # at most the broken batch is asked again
    start().awaitTermination()
    assert len(calls.read_text().split()) == len(asked)  # there is nothing left
    items = spark.createDataFrame([(f"p{i:02}", 39 - i) for i in range(40)], "id string, pos long")
    assert [x.id for x in inference.in_order(found, items).orderBy("pos").collect()] == [f"p{i:02}" for i in reversed(range(40))]
