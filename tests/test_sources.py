import json
import os
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tesselade.sources import readers as R
from tesselade.sources import reports as M
from tesselade.sources import writers as W


def test_jsonl(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"images": ["dataset/0_real/x.png"], "query": " q ", "response": "r"}\n\n   \n{"images": [], "query": null}\n')
    assert R.read_jsonl(spark, str(path), R.SOURCE_SCHEMA).where("images is not null").count() == 2
    rows = R.read_jsonl(spark, str(path), R.SOURCE_SCHEMA, "line_no").orderBy("line_no").collect()
    assert [(r.line_no, r.images, r.query) for r in rows] == [(0, ["dataset/0_real/x.png"], " q "), (1, [], None)]


def test_positions_over_many_splits(spark, tmp_path):
    for f in range(3):
        (tmp_path / f"part-{f}.jsonl").write_text("".join(f'{{"query": "{f}-{i}"}}\n' + "\n" * (i % 3) for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = R.read_jsonl(spark, str(tmp_path), "query string", "n").orderBy("n").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.query for r in rows] == [f"{f}-{i}" for f in range(3) for i in range(2000)]
    assert [r.n for r in rows] == list(range(6000))


def test_round_trip_keeps_nulls_and_odd_names(spark, tmp_path):
    df = spark.createDataFrame([(1, None, ([("c", "e", 1), None], "Real")), (2, "x", None)], "row_id bigint, image string, final_json_target struct<per_criterion:array<struct<criterion:string,evidence:string,`aigc score`:int>>,overall_likelihood:string>")
    W.write_jsonl(df, str(tmp_path / "out"))
    line = next(json.loads(x) for p in (tmp_path / "out").glob("*.txt") for x in p.read_text().splitlines() if '"row_id":1' in x)
    assert line["image"] is None and line["final_json_target"]["per_criterion"][0]["aigc score"] == 1
    back = R.read_jsonl(spark, str(tmp_path / "out"), R.DERIVED_SCHEMA).select(df.columns)
    assert sorted(back.collect()) == sorted(df.collect())


def test_ids_and_prompts(spark, tmp_path):
    (tmp_path / "a.json").write_text('["1", "2", "2"]')
    (tmp_path / "a.txt").write_text("3\n\n 4 \n")
    assert {r.id for r in R.read_ids(spark, str(tmp_path / "a.json")).collect()} == {"1", "2"}
    assert {r.id for r in R.read_ids(spark, str(tmp_path / "a.txt")).collect()} == {"3", "4"}
    with pytest.raises(Exception):
        R.read_ids(spark, str(tmp_path / "none.txt")).count()
    (tmp_path / "final.txt").write_text(" Judge. \n")
    assert R.read_prompts(str(tmp_path), {"final": "x", "trace": "y"}) == {"final": "Judge.", "trace": "y"}
    with pytest.raises(FileNotFoundError):
        R.dataset_path(str(tmp_path))


def test_archives_and_folders(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("0_real/a.png", b"one")
        z.writestr("1_fake/b.png", b"two")
    found = {(r.member, bytes(r.bytes)) for r in R.zip_members(spark, str(tmp_path / "a.zip"), content=True).collect()}
    assert found == {("0_real/a.png", b"one"), ("1_fake/b.png", b"two")}
    os.makedirs(tmp_path / "set/cat")
    (tmp_path / "set/cat/1.png").write_bytes(b"not an image")
    folder = R.image_folder(spark, str(tmp_path / "set"))
    assert [r["class"] for r in folder.collect()] == ["cat"]
    pytest.importorskip("PIL")
    assert [tuple(r) for r in R.decoded(folder).select("width", "height", "ok").collect()] == [(224, 224, False)]


def test_scorer_retries_single_rows(spark):
    def load():
        def score(pdf: pd.DataFrame) -> pd.Series:
            if (pdf["id"] == 3).any():
                raise ValueError
            return pdf["id"] / 10

        return score

    found = {r.id: r.detector_score for r in R.scored(spark.range(6), load).collect()}
    assert found == {0: 0.0, 1: 0.1, 2: 0.2, 3: None, 4: 0.4, 5: 0.5}


def test_split_manifest_is_reused_until_the_data_change(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("row_id"), F.lit("Real").alias("label"))
    first = {tuple(r) for r in W.split_manifest(df, "row_id", "label", str(tmp_path)).collect()}
    stamp = os.path.getmtime(tmp_path / "split.json")
    assert {tuple(r) for r in W.split_manifest(df, "row_id", "label", str(tmp_path)).collect()} == first
    assert os.path.getmtime(tmp_path / "split.json") == stamp
    assert W.split_manifest(df.limit(90), "row_id", "label", str(tmp_path)).count() == 90


def test_manifest_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(2, "Real", ["a"]), (1, "Real", None), (3, None, ["a", "b"])], "row_id int, label string, flags array<string>")
    found = W.manifest(df, "label", "flags", "row_id")
    assert found["rows"] == 3 and found["quality_flags"] == 3 and found["label_counts"] == {"None": 1, "Real": 2} and found["example"]["row_id"] == 1
    W.write_json(found, str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text())["rows"] == 3
    text = M.evaluation_report("T", {"accuracy": 0.5, "loss": None}, [{"criterion": "c", "precision": 1.0}], [{"error_type": "ok", "n": 3}])
    assert "- accuracy: 0.500" in text and "- loss: N/A" in text and "| c | 1.000 | N/A | N/A |" in text and "| ok | 3 |" in text
    assert "Best: a" in M.ranking_report([{"rank": 2, "path": "b"}, {"rank": 1, "path": "a"}]) and "Best: N/A" in M.ranking_report([])
    W.quarantine(spark.createDataFrame([("a/b c.png", "{")], "n string, t string"), "n", "t", str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).first().name == "a_b_c.png"


def test_images_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([("0_real/a.png", bytearray(b"one"))], "member string, bytes binary")
    W.materialise_images(df, str(tmp_path))
    path = tmp_path / "images/0_real/a.png"
    assert path.read_bytes() == b"one"
    changed = df.withColumn("bytes", F.lit(b"two"))
    W.materialise_images(changed, str(tmp_path))
    assert path.read_bytes() == b"one"
    W.materialise_images(changed, str(tmp_path), overwrite=True)
    assert path.read_bytes() == b"two" and not list(tmp_path.rglob("*.part"))
    with pytest.raises(Exception, match="outside"):
        W.materialise_images(df.withColumn("member", F.lit("../../x")), str(tmp_path))


def test_throughput():
    assert M.throughput(4, 2.0, 10) == {"wall_time_sec": 2.0, "sec_per_sample": 0.5, "samples_per_sec": 2.0, "eta_sec": 3.0}
    assert M.throughput(0, 0.0)["sec_per_sample"] is None
