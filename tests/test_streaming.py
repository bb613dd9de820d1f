"""A stream stopped in the middle and started again equals the batch answer."""

import pytest
from pyspark.sql import functions as F

from assayloom.operators.windows import feed_state, progress_checkpoints
from assayloom.streaming import results as R
from assayloom.streaming.feed_states import FeedStates
from assayloom.catalog.streams import staged
from assayloom.sources.files import stream_lines
from assayloom.streaming.ingest import ingest_files
from assayloom import schemas

SCHEMA = "target string, experiment_id string, al_round int, compound_id long, score double, docked_at timestamp"


def rows(spark, lo, hi):
    return spark.range(lo, hi).select(
        F.lit("T").alias("target"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("experiment_id"),
        F.lit(0).alias("al_round"), F.col("id").alias("compound_id"),
        F.when(F.col("id") % 10 != 0, -((F.col("id") * 37) % 101) / 10.0).alias("score"), F.current_timestamp().alias("docked_at"),
    )


def put(spark, folder, lo, hi):
    rows(spark, lo, hi).coalesce(1).write.mode("append").parquet(folder)


def test_restart_in_the_middle(spark, tmp_path):
    feed, t = str(tmp_path / "feed"), str(tmp_path)
    args = (["experiment_id"], ["compound_id"], f"{t}/best", f"{t}/state", f"{t}/ck-best")

    def drain():
        stream = lambda: R.read_results(spark, feed, SCHEMA, 1)
        R.append_results(stream(), f"{t}/scores", f"{t}/ck-scores").awaitTermination()
        R.running_best(stream(), *args, every=100).awaitTermination()
        R.live_progress(stream(), ["experiment_id"], f"{t}/history", f"{t}/latest", f"{t}/ck-live").awaitTermination()

    put(spark, feed, 0, 450)
    drain()
    put(spark, feed, 450, 1000)
    put(spark, feed, 1000, 1203)
    drain()
    whole = rows(spark, 0, 1203)
    assert spark.read.schema(schemas.SCORES).parquet(f"{t}/scores").count() == 1203
    got = spark.read.parquet(f"{t}/best").drop("batch").collect()
    want = progress_checkpoints(whole, ["experiment_id"], ["compound_id"], 100, at_end=False).collect()
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == 12
    states = FeedStates(spark, f"{t}/state", ["experiment_id"], "experiment_id string")
    assert sorted(states.read(states.versions(2)).collect()) == sorted(feed_state(whole, ["experiment_id"]).collect())
    live = spark.read.json(f"{t}/latest").collect()
    assert sum(r["docked"] for r in live) == 1203


def test_file_ingest_takes_each_file_once(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "lib")
    (folder / "A").mkdir(parents=True)
    (folder / "A" / "one.smi").write_text("h\n" + "".join(f"{c}b Z{i}\n" for i, c in enumerate("0123456789")))
    run = lambda: ingest_files(stream_lines(spark, str(folder)), staged, root, f"{root}/ck").awaitTermination()
    run()
    run()
    (folder / "A" / "two.smi").write_text("h\n7x Z7\n8x Z20\n")
    run()
    library = spark.read.schema(schemas.COMPOUNDS).parquet(f"{root}/compounds").collect()
    errors = spark.read.schema(schemas.INGESTION_ERRORS).parquet(f"{root}/ingestion_errors").collect()
    assert sorted(r["zinc_id"] for r in library) == ["Z20", "Z3", "Z4", "Z5", "Z6", "Z7", "Z8", "Z9"]
    assert sorted(r["id"] for r in library) == list(range(1, 9))
    assert sorted(r["error_msg"] for r in errors) == ["Crash: bad token 2b", "Protonation Failed", "RDKit Mol Conversion Failed"]
    status = spark.read.parquet(f"{root}/tranche_status").select("tranche", "status").distinct().collect()
    assert sorted(tuple(r) for r in status) == [("A/one", "completed"), ("A/two", "completed")]


def test_result_files_stream_into_the_score_table(spark, tmp_path):
    from assayloom.sources.files import stream_result_xml

    folder, t = tmp_path / "xml", str(tmp_path)
    folder.mkdir()
    put_xml = lambda n, text: (folder / f"ligand_{n}.xml").write_text(text)

    def drain():
        scored = stream_result_xml(spark, str(folder)).select(
            "compound_id", "score", F.lit("T").alias("target"), F.lit("e").alias("experiment_id"), F.lit(1).alias("al_round")
        )
        R.append_results(scored, f"{t}/scores", f"{t}/ck").awaitTermination()

    put_xml(7, "<r><best_energy>-5</best_energy></r>")
    put_xml(8, "<r><best_energy>-5</best")
    drain()
    put_xml(9, "<r><free_NRG_binding>-6.5</free_NRG_binding></r>")
    drain()
    got = spark.read.schema(schemas.SCORES).parquet(f"{t}/scores").collect()
    assert {r["compound_id"]: r["score"] for r in got} == {7: -5.0, 8: None, 9: -6.5} and len(got) == 3


def test_feeds_and_restarts_keep_each_others_rows(spark, tmp_path):
    t = str(tmp_path)
    put(spark, f"{t}/one", 0, 10)
    put(spark, f"{t}/two", 10, 25)
    for feed, checkpoint in (("one", "ck-a"), ("two", "ck-b"), ("two", "ck-b")):
        R.append_results(R.read_results(spark, f"{t}/{feed}", SCHEMA), f"{t}/scores", f"{t}/{checkpoint}").awaitTermination()
    put(spark, f"{t}/one", 25, 30)
    R.append_results(R.read_results(spark, f"{t}/one", SCHEMA), f"{t}/scores", f"{t}/ck-a").awaitTermination()
    got = spark.read.schema(schemas.SCORES).parquet(f"{t}/scores")
    assert sorted(r[0] for r in got.select("compound_id").collect()) == list(range(30))


def test_many_batches_leave_few_states_and_a_missing_state_raises(spark, tmp_path):
    t = str(tmp_path)
    args = (["experiment_id"], ["compound_id"], f"{t}/best", f"{t}/state", f"{t}/ck")
    for i in range(6):
        put(spark, f"{t}/feed", 10 * i, 10 * i + 10)
    R.running_best(R.read_results(spark, f"{t}/feed", SCHEMA, 1), *args, every=20).awaitTermination()
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["manifest=4", "manifest=5", "v=4", "v=5"]
    (tmp_path / "state" / "manifest=5" / "_SUCCESS").unlink()
    put(spark, f"{t}/feed", 60, 70)
    with pytest.raises(Exception, match="state before micro-batch 6 is missing"):
        R.running_best(R.read_results(spark, f"{t}/feed", SCHEMA, 1), *args, every=20).awaitTermination()


def test_feeds_without_news_are_not_rewritten(spark, tmp_path):
    t = str(tmp_path)
    schema = "feed string, id long, score double"

    def arrive(feeds, lo):
        rows = [(f, i, -float((i * 31) % 17)) for f in feeds for i in range(lo, lo + 12)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{t}/feed")

    def drain():
        stream = R.read_results(spark, f"{t}/feed", schema, 1)
        R.running_best(stream, ["feed"], ["id"], f"{t}/best", f"{t}/state", f"{t}/ck", every=5).awaitTermination()

    every = [f"f{i}" for i in range(40)]
    arrive(every, 0)
    drain()
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "state").rglob("bucket=*/*.parquet")}
    first = files()
    for n in range(1, 4):
        arrive(["f3"], 12 * n)
        drain()
    states = FeedStates(spark, f"{t}/state", ["feed"], "feed string")
    versions = states.versions(3)
    bucket = spark.createDataFrame([("f3",)], "feed string").select(states.bucket()).first()[0]
    assert {b for b, v in versions.items() if v == 3} == {bucket} and set(versions.values()) == {0, 3}
    kept = {p: m for p, m in files().items() if f"bucket={bucket}" not in str(p)}
    assert kept == {p: m for p, m in first.items() if f"bucket={bucket}" not in str(p)} and len(kept) > 10
    # what a replay may still ask for, and nothing older, is there of the bucket with news
    assert {p.parent.parent.name for p in files() if f"bucket={bucket}/" in str(p)} == {"v=2", "v=3"}
    held = {r.feed: (r.docked, r.top) for r in states.read(versions).collect()}
    want = lambda n: sorted(-float((i * 31) % 17) for i in range(n))
    assert held == {f: (12, want(12)) for f in every if f != "f3"} | {"f3": (48, want(48))}
    got = spark.read.parquet(f"{t}/best").where("feed = 'f3'").collect()
    assert sorted(r.docked for r in got) == list(range(5, 48, 5))
