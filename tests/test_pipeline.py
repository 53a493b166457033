"""Files in and out, and the laws of the pipeline: reruns do nothing, stages and partitions don't matter."""

import json

import pytest
from pyspark.sql import functions as F

from tilewright import cli
from tilewright.functions import geometry
from tilewright.operators import encoders
from tilewright.plans.pipeline import Job
from tilewright.sources import files, tiles
from tilewright.streaming.ingest import ingest


def job(spark, folder, parts=2, encoder=None):
    tiles.register(spark)
    pixels = spark.read.format("tiles").option("slides", 3).option("side", 512).option("size", 128).load()
    slides = spark.createDataFrame([(f"slide{i}", 512, 512, 0.5) for i in range(3)], "sid string, w long, h long, mpp double").repartition(parts)
    box = F.array(geometry.rectangle(F.lit(100.0), F.lit(100.0), F.lit(300.0), F.lit(300.0)))
    tissue = slides.where("sid <> 'slide2'").select("sid", F.lit(0).alias("tissue_id"), box.alias("rings"))
    return Job(spark, f"file://{folder}", slides, tissue, lambda p: p.join(pixels, ["sid", "x", "y"]), 128, encoder=encoder or encoders.mean_rgb())


def rows(df):
    return sorted((r["sid"], r["n"], None if r["features"] is None else tuple(round(v, 9) for v in r["features"])) for r in df.collect())


def test_laws(spark, tmp_path):
    one = job(spark, tmp_path / "a")
    first = rows(one.slide_features())
    assert [(s, n) for s, n, _ in first] == [("slide0", 5), ("slide1", 5), ("slide2", 0)] and first[2][2] is None
    calls = []
    again = job(spark, tmp_path / "a", encoder=encoders.Encoder("mean_rgb", 3, lambda x: calls.append(1)))
    assert rows(again.slide_features()) == first and not calls
    staged = job(spark, tmp_path / "b", 5)
    staged.coords()
    staged.patch_features()
    assert rows(staged.slide_features()) == first
    assert {(r["task"], r["reason"]): r["n"] for r in one.outcomes().where("sid = 'slide2'").collect()} == {("coords", "no patch on tissue"): 0, ("patch_features:mean_rgb", "no patch on tissue"): 0}


def test_failed_stage_is_done_again_once(spark, tmp_path):
    def fail(x):
        raise OSError("no device")

    with pytest.raises(Exception, match="no device"):
        job(spark, tmp_path, encoder=encoders.Encoder("mean_rgb", 3, fail)).slide_features()
    assert [n for _, n, _ in rows(job(spark, tmp_path).slide_features())] == [5, 5, 0]


def test_command_line(spark, tmp_path, capsys):
    j = job(spark, tmp_path / "unused")
    for name, df in (("slides", j.slides), ("tissue", j.tissue), ("tiles", spark.read.format("tiles").option("slides", 3).option("side", 512).option("size", 128).load())):
        df.write.parquet(f"{tmp_path}/{name}")
    given = [x for n in ("slides", "tissue", "tiles") for x in (f"--{n}", f"{tmp_path}/{n}")]
    assert cli.main(["batch", *given, "--job_dir", f"{tmp_path}/job", "--patch_size", "128"], spark) == 0
    assert "completed: 2" in capsys.readouterr().out and "completed" in (tmp_path / "job/summary.md").read_text()
    assert spark.read.parquet(f"{tmp_path}/job/slide_features").count() == 3
    assert cli.main(["single", *given, "--job_dir", f"{tmp_path}/one", "--sid", "slide1", "--task", "coords", "--patch_size", "128"], spark) == 0
    assert cli.main(["doctor", "--json"]) == 0 and {c["status"] for c in json.loads(capsys.readouterr().out.splitlines()[-1])} <= {"OK", "WARN"}


def test_listing_lists_and_lookup(spark, tmp_path):
    for name in ("b.SVS", "a.svs", "notes.txt", "deep/c.ome.tif"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    names = lambda nested: sorted(r["rel_path"] for r in files.slide_files(spark, str(tmp_path), nested=nested).collect())
    assert names(False) == ["a.svs", "b.SVS"] and names(True) == ["a.svs", "b.SVS", "deep/c.ome.tif"]
    (tmp_path / "l.csv").write_text("wsi,mpp\nb.SVS,0.5\na.svs,0.25\n,1\na.svs,x\n")
    found = files.slide_files(spark, str(tmp_path))
    listed = files.slide_list(spark, str(tmp_path / "l.csv"), found)
    got = {r["rel_path"]: (r["name"], r["mpp"]) for r in files.slides_with_mpp(found, listed.where("mpp IS NOT NULL")).collect()}
    assert got == {"a.svs": ("a", 0.25), "b.SVS": ("b", 0.5)}
    (tmp_path / "bad.csv").write_text("wsi\ngone.svs\n")
    with pytest.raises(ValueError, match="gone.svs"):
        files.slide_list(spark, str(tmp_path / "bad.csv"), found)
    (tmp_path / "none.csv").write_text("x\n1\n")
    with pytest.raises(ValueError, match="wsi"):
        files.slide_list(spark, str(tmp_path / "none.csv"))


def test_geojson_round_trip(spark, tmp_path):
    ring = [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)]
    df = spark.createDataFrame([("s", 3, [ring, [(1.0, 1.0), (1.5, 1.0), (1.0, 1.5)]])], "sid string, tissue_id long, rings array<array<struct<x:double,y:double>>>")
    (tmp_path / "s.geojson").write_text(files.geojson(df).first()["value"])
    assert [tuple(r) for r in files.polygons(spark, str(tmp_path / "s.geojson")).collect()] == [tuple(r)[1:] for r in df.collect()]
    (tmp_path / "e.geojson").write_text('{"type": "FeatureCollection", "features": []}')
    assert files.polygons(spark, str(tmp_path / "e.geojson")).count() == 0


def test_states_and_manifests(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"slide": {}, "tasks": {"seg": {}}}')
    from tilewright.operators import nested

    assert [r["task"] for r in nested.state_children(files.state_documents(spark, str(tmp_path))).collect()] == ["seg"]
    run = files.start_run(str(tmp_path), "test", {"a": range(2), "f": max, "_x": 1})
    files.finish_run(str(tmp_path), run, "report", "boom")
    saved = json.loads((tmp_path / f"runs/{run}.json").read_text())
    assert saved["status"] == "error" and saved["args"] == {"a": [0, 1], "f": "max"} and "report" in (tmp_path / "summary.md").read_text()


def test_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    files.write_partitioned(spark.createDataFrame([("a", 1), ("b", 1)], "sid string, v int"), path, ["sid"])
    files.write_partitioned(spark.createDataFrame([("b", 2)], "sid string, v int"), path, ["sid"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("sid", "v").collect()) == [("a", 1), ("b", 2)]


def test_stream_takes_each_file_once(spark, tmp_path):
    landing, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    run = lambda: ingest(spark, landing, spark.range(1).schema, out, check, "id", lambda r: r).awaitTermination()
    spark.range(0, 5).write.parquet(landing)
    run()
    spark.range(3, 8).write.mode("append").parquet(landing)
    run()
    run()
    assert sorted(r[0] for r in spark.read.parquet(out).collect()) == list(range(8))
