"""Writers run twice, and after half a run."""

import json
import os

import pytest
from pyspark.sql import functions as F

from assayloom import schemas
from assayloom.operators import ingest as I
from assayloom.runtime import table_complete
from assayloom.sinks import swap, tables as K


def test_batch_is_written_once(spark, tmp_path):
    path = str(tmp_path / "b")
    assert K.append_batch(spark.range(10), path, "T", "e", 0, "random_init")
    assert not K.append_batch(spark.range(20, 30), path, "T", "e", 0, "random_init")
    assert K.append_batch(spark.range(20, 25), path, "T", "e", 1, "thompson_sample")
    assert K.append_batch(spark.range(5), path, "T", "other", 0, "random_init")
    rows = spark.read.schema(schemas.BATCHES).parquet(path)
    assert rows.count() == 20 and rows.where("experiment_id = 'e' and round = 0").agg(F.max("compound_id")).first()[0] == 9


def test_half_written_predictions_are_written_again(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = spark.range(5).select("id", F.lit(-1.0).alias("predicted"))
    assert K.write_predictions(rows, path)
    os.remove(f"{path}/_SUCCESS")
    assert not table_complete(spark, path)
    assert K.write_predictions(rows, path) and not K.write_predictions(rows.limit(1), path)
    assert spark.read.parquet(path).count() == 5


def test_fingerprint_store_is_sorted_over_files(spark, tmp_path):
    path = str(tmp_path / "fp")
    fps = spark.range(1000).repartition(7).select("id", F.array(F.col("id")).alias("fp"))
    K.write_fingerprints(fps, path, 4)
    spans = spark.read.parquet(path).groupBy(F.col("_metadata.file_path")).agg(F.min("id"), F.max("id")).collect()
    spans = sorted((r[1], r[2]) for r in spans)
    assert len(spans) > 1 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_update_touches_both_columns_only_where_given(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, "z", "CC", "t", None, 1.0), (2, "y", "C", "t", 5.0, 5.0), (3, "x", "", "u", None, None)], schemas.COMPOUNDS
    )
    updates = spark.createDataFrame([(1, 28.0, 0.5)], "id long, mw double, logp double")
    rows.write.partitionBy("tranche").parquet(str(tmp_path / "c"))
    other = sorted((tmp_path / "c" / "tranche=u").glob("*.parquet"))
    K.update_from(updates, str(tmp_path / "c"), schemas.COMPOUNDS)
    assert sorted((tmp_path / "c" / "tranche=u").glob("*.parquet")) == other
    got = spark.read.schema(schemas.COMPOUNDS).parquet(str(tmp_path / "c")).orderBy("id").select("id", "mw", "logp").collect()
    assert [tuple(r) for r in got] == [(1, 28.0, 0.5), (2, 5.0, 5.0), (3, None, None)]


def library(spark, path):
    """Six files in two tranches, one of them with a name that must be escaped."""
    for lo in (0, 100, 200):
        for tranche in ("en/web", "u v"):
            rows = spark.range(lo, lo + 20).selectExpr(
                f"id + {0 if tranche == 'u v' else 50} AS id", "concat('z', id) AS zinc_id", "'CC' AS smiles", f"'{tranche}' AS tranche",
                "cast(null AS double) AS mw", "1.0D AS logp",
            )
            rows.coalesce(1).write.mode("append").partitionBy("tranche").parquet(path)


def content(spark, path):
    return {r.id: (r.mw, r.logp, r.tranche) for r in spark.read.schema(schemas.COMPOUNDS).parquet(path).collect()}


def test_update_writes_only_files_with_hits(spark, tmp_path):
    path = str(tmp_path / "c")
    library(spark, path)
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "c").rglob("*.parquet")}
    before = files()
    updates = spark.createDataFrame([(105, 7.0, 8.0), (105, 9.0, 8.0), (152, 5.0, 6.0), (9999, 1.0, 1.0)], "id long, mw double, logp double")
    K.update_from(updates, path, schemas.COMPOUNDS)
    kept = {p: m for p, m in before.items() if files().get(p) == m}
    assert len(before) == 6 and len(kept) == 4
    new = [str(p) for p in files() if p not in before]
    assert spark.read.option("basePath", path).parquet(*new).count() == 40
    got = content(spark, path)
    assert len(got) == 120 and spark.read.parquet(path).count() == 120
    assert got[105] == (7.0, 8.0, "u v") and got[152] == (5.0, 6.0, "en/web") and got[104] == (None, 1.0, "u v")
    assert not [p for p in (tmp_path / "c").iterdir() if p.name.startswith(("_staged", "_swap"))]


@pytest.mark.parametrize("step", ["before the marker", "between moves", "between deletes"])
def test_a_broken_update_is_finished(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "c")
    library(spark, path)
    updates = spark.createDataFrame([(5, 7.0, 8.0), (55, 5.0, 6.0)], "id long, mw double, logp double")
    finish, calls = swap.finish, []

    def broken(*a):
        calls.append(a)
        if len(calls) == 1:
            return finish(*a)
        raise OSError("lost")

    if step == "before the marker":
        monkeypatch.setattr(swap, "decide", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    else:
        monkeypatch.setattr(swap, "finish", broken)
    try:
        K.update_from(updates, path, schemas.COMPOUNDS)
    except OSError:
        pass
    monkeypatch.undo()
    if step == "between moves":  # one new file is in, no old one is out
        staged = next(p for p in (tmp_path / "c").iterdir() if p.name.startswith("_staged"))
        one = sorted(staged.rglob("*.parquet"))[0]
        one.rename(tmp_path / "c" / one.relative_to(staged))
    if step == "between deletes":  # all new files are in, one old one is out
        marker = next(p for p in (tmp_path / "c").iterdir() if p.name.startswith("_swap"))
        told = json.loads(marker.read_text())
        for one in sorted((tmp_path / "c" / os.path.basename(told["staged"])).rglob("*.parquet")):
            one.rename(tmp_path / "c" / one.relative_to(tmp_path / "c" / os.path.basename(told["staged"])))
        os.remove(told["old"][0].removeprefix("file:"))
    K.update_from(updates, path, schemas.COMPOUNDS)
    got = content(spark, path)
    assert len(got) == 120 == spark.read.parquet(path).count()
    assert got[5] == (7.0, 8.0, "u v") and got[55] == (5.0, 6.0, "en/web") and got[6][0] is None
    assert not [p for p in (tmp_path / "c").iterdir() if p.name.startswith(("_staged", "_swap"))]


def test_first_per_key_combines_before_the_shuffle(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    got = I.first_per_key(rows, "k", ["id"])
    assert got.count() == 20_001 and got.where("k = 'hot'").first()["id"] == 0


def test_metrics_keep_null_and_replace_a_round(spark, tmp_path):
    row = spark.createDataFrame([("T", "e", 0, 1.5, None)], "target string, experiment_id string, round int, best1 double, val_rmse double")
    K.append_round_metrics(row, str(tmp_path / "m"))
    K.append_round_metrics(row.withColumn("best1", F.lit(2.5)), str(tmp_path / "m"))
    got = spark.read.schema(schemas.ROUND_METRICS).parquet(str(tmp_path / "m")).collect()
    assert len(got) == 1 and got[0]["best1"] == 2.5 and got[0]["val_rmse"] is None


def test_alert_report(spark, tmp_path):
    hits = spark.createDataFrame([(2, -1.0, True, "a; b"), (1, -2.5, False, "")], "compound_id long, score double, flagged boolean, alert_names string")
    K.write_alert_report(hits, str(tmp_path / "r"))
    got = spark.read.csv(str(tmp_path / "r"), header=True).collect()
    assert [tuple(r) for r in got] == [("1", "-2.500", "0", None), ("2", "-1.000", "1", "a; b")]


def test_ingest_opens_only_what_is_left(spark, tmp_path):
    from assayloom.catalog.sinks import staged
    from assayloom.plans import ingest as PI
    from assayloom.sources.files import list_files

    folder, root = tmp_path / "in", str(tmp_path / "lib")
    (folder / "A").mkdir(parents=True)
    (folder / "A" / "one.smi").write_text("h\n" + "".join(f"{c}b Z{i}\n" for i, c in enumerate("3456789")))
    (folder / "A" / "empty.smi").write_text("h\n")
    PI.ingest_folder(spark, str(folder), staged, root, "run-1")
    status = lambda: {(r.tranche, r.status, r.batch) for r in spark.read.schema(schemas.TRANCHE_STATUS).parquet(f"{root}/tranche_status").collect()}
    names = {r.tranche for r in list_files(spark, str(folder)).collect()}
    assert status() == {(n, "completed", "run-1") for n in names} and len(names) == 2
    seen = []
    (folder / "A" / "two.smi").write_text("h\n7x Z7\nx Z20\n")
    watched = lambda lines: staged(lines).where(F.lit(seen.append(sorted({r.file for r in lines.select("file").distinct().collect()})) is None))
    PI.ingest_folder(spark, str(folder), watched, root, "run-2")
    assert len(seen) == 1 and all(f.endswith("two.smi") for f in seen[0])
    PI.ingest_folder(spark, str(folder), lambda lines: 1 / 0, root, "run-3")  # nothing is left to open

    def broken(lines):
        raise OSError("lost")

    (folder / "A" / "three.smi").write_text("h\n8x Z8\n")
    try:
        PI.ingest_folder(spark, str(folder), broken, root, "run-4")
    except OSError:
        pass
    assert {s for _, s, b in status() if b == "run-4"} == {"processing"}
    PI.ingest_folder(spark, str(folder), staged, root, "run-4")
    assert {s for _, s, b in status() if b == "run-4"} == {"completed"}
    assert not (tmp_path / "lib" / "staging" / "run-4").exists()
