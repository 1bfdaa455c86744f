from pyspark.sql import functions as F

from tesselade.functions import prompts
from tesselade.operators import review as V
from tesselade.streaming import ingest


def test_stream(spark, tmp_path):
    rows = [(1, "Real", "2025-01-01 00:10:00"), (1, "Real", "2025-01-01 00:10:00"), (2, "real", "2025-01-01 00:50:00"), (3, "AI-Generated", "2025-01-01 01:10:00")]
    df = spark.createDataFrame(rows, "row_id int, label string, at string").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = ingest.read_stream(spark, str(tmp_path / "in"), df.schema)
    query = ingest.write_batches(ingest.first_deliveries(stream, "row_id", "at"), str(tmp_path / "out"), str(tmp_path / "cp"), "row_id")
    query.awaitTermination(120)
    assert sorted(r.row_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]
    counts = ingest.label_counts(ingest.read_stream(spark, str(tmp_path / "in"), df.schema), "at", "label")
    query = counts.writeStream.outputMode("complete").format("memory").queryName("label_counts").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.start.hour, r.label, r.n) for r in spark.table("label_counts").collect()} == {(0, "Real", 2), (0, "Uncertain", 1), (1, "AI-Generated", 1)}


DRAFT = "idx int, criterion string, proposed_score int, evidence string, support_type string, holmes_span string, artifact_score_conflict boolean, non_applicable boolean, label string, k int"
EDGES, MATERIAL, TEXT = "Edges & Boundaries", "Material & Object Details", "Text & Symbols"


def final(spark, *entries, label="AI-Generated"):
    rows = [(i, c, p, e, s, h, False, False, label, 1) for i, (c, p, e, s, h) in enumerate(entries)]
    found = V.finalize(V.judge(spark.createDataFrame(rows, DRAFT), ["k"]), ["k"]).orderBy("idx").collect()
    return [r.final_score for r in found], found


def test_final_scores(spark):
    said = "Outlines look broken and misaligned near the subject."
    one = (EDGES, 1, said, "image_only", "")
    assert final(spark, one, (MATERIAL, 1, "The fabric looks broken and odd here.", "image_only", ""))[0] == [1, 0]  # capped
    assert final(spark, (EDGES, 1, "same", "explicit_holmes", "same"), (MATERIAL, 1, "same", "explicit_holmes", "same"))[0] == [1, 0]  # redundant
    assert final(spark, (EDGES, 1, said, "explicit_holmes", said), (MATERIAL, 1, said, "explicit_holmes", said))[0] == [1, 0]
    assert final(spark, (EDGES, 1, "x", "unsupported", ""))[0] == [0]
    scores, rows = final(spark, (TEXT, 1, said, "image_only", ""))  # high risk: the specialist finds no span
    assert scores == [0] and rows[0].specialist_used and rows[0].specialist_confidence == "medium"
    scores, rows = final(spark, (TEXT, 1, said, "image_only", said))  # here it does
    assert scores == [1] and rows[0].specialist_confidence == "high"
    scores, rows = final(spark, (EDGES, 1, said, "explicit_holmes", said), label="Real")
    assert scores == [0] and "real_supported_zero_count" in rows[0].final_counters
    scores, rows = final(spark, (EDGES, 0, "No visible text here", "explicit_holmes", "Something is off here"))
    assert scores == [1] and rows[0].judge_verdict == "accept" and "fake_positive_fallback_count" in rows[0].final_counters


def test_given_drafts_last_wins_and_fill(spark):
    drafts = [("edges", 0, "old", "image_only", "", False, False), None, ("Edges & Boundaries", 1, "new", "explicit_holmes", "s", None, None), ("who knows", 1, "x", "x", "x", None, None)]
    kind = "array<struct<criterion:string,proposed_score:int,evidence:string,support_type:string,holmes_span:string,artifact_score_conflict:boolean,non_applicable:boolean>>"
    df = spark.createDataFrame([(1, "AI-Generated", drafts), (2, "Real", None), (3, "Real", [])], f"k int, label string, d {kind}")
    rows = V.judge_input(V.given_drafts(df, "d")).collect()
    assert len(rows) == 24
    edges = next(r for r in rows if r.k == 1 and r.criterion == EDGES)
    assert (edges.proposed_score, edges.evidence, edges.support_type, edges.non_applicable) == (1, "new", "explicit_holmes", False)
    other = next(r for r in rows if r.k == 2 and r.criterion == EDGES)
    assert (other.support_type, other.non_applicable, other.holmes_span) == ("unsupported", True, "")


def test_normal_drafts(spark):
    schema = "idx int, criterion string, proposed_score int, evidence string, support_type string, holmes_span string, given boolean, label string, anchor_kind string, anchor_span string"
    rows = [
        (0, EDGES, 1, "An odd rim runs along the whole bowl.", "nonsense", None, True, "AI-Generated", "unsupported", ""),
        (1, MATERIAL, 1, "The shape of the bowl is odd here.", "image_only", "", True, "AI-Generated", "unsupported", ""),
        (2, TEXT, None, None, None, None, False, "AI-Generated", "implied_holmes", "The letters of the sign are garbled and odd."),
        (3, EDGES, 1, "An odd rim runs along the whole bowl.", "image_only", "", True, "Real", "unsupported", ""),
    ]
    found = {r.idx: r for r in V.normal_drafts(spark.createDataFrame(rows, schema)).collect()}
    assert found[0].support_type == "image_only" and found[0].counters == ["json_repair_count"]
    assert found[1].support_type == "unsupported" and found[1].counters == ["stage1_material_boundary_downgrade_count"]
    assert found[2].proposed_score == 0 and found[2].evidence.startswith("The letters") and found[2].counters == ["criterion_fill_in_count"]
    assert found[3].support_type == "unsupported" and found[3].counters == ["real_image_only_block_count"]


def test_reviews_and_prompts(spark):
    rows = [(0, EDGES, 1), (1, MATERIAL, 0), (2, TEXT, 1)]
    reviews = [(EDGES, "ACCEPT", "Fine.", None, "bogus"), None]
    df = spark.createDataFrame([(*r, reviews) for r in rows], "idx int, criterion string, proposed_score int, rs array<struct<criterion:string,verdict:string,reason:string,score_consistency:string,recommended_score:string>>")
    found = {r.idx: r for r in V.normal_reviews(df, "rs").collect()}
    assert (found[0].verdict, found[0].recommended_score, found[0].reason) == ("accept", "keep", "Fine.")
    assert found[1].verdict == "accept" and found[2].verdict == "downgrade_to_0" and found[2].review_counters == ["judge_missing_review_count"]
    text = df.select(prompts.final_prompt("Judge: ", F.struct("idx", F.lit(None).cast("string").alias("n")))).first()[0]
    assert text.startswith("Judge:\n\n{") and '"n":null' in text
