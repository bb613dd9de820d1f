"""The keyed library: first arrivals, few buckets opened, crashes at every step."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from assayloom.sinks import keyed as K

COLUMNS = "id long, k string, o long"


@pytest.fixture
def lib(spark, tmp_path):
    class Lib:
        path = str(tmp_path / "lib")
        schema = spark.createDataFrame([], COLUMNS).schema

        def add(self, rows, **kw):
            df = spark.createDataFrame(rows, "k string, o long").repartition(3)
            return K.insert_first(df, self.path, "k", ["o"], self.schema, serial="id", **kw)

        def rows(self):
            return sorted((r.id, r.k, r.o) for r in K.read_keyed(spark, self.path, self.schema).collect())

        def names(self):
            return sorted(n for n in os.listdir(f"{self.path}_keys") if not n.startswith("."))

    return Lib()


def test_numbers_go_on_and_the_first_stays(lib):
    assert lib.rows() == []
    assert lib.add([("a", 2), ("a", 1), ("b", 3), (None, 0)]) == []
    lib.add([("b", 0), ("c", 5), ("d", 4)])
    lib.add([("b", 0), ("c", 5), ("d", 4)])
    assert lib.rows() == [(1, "a", 1), (2, "b", 3), (3, "d", 4), (4, "c", 5)]
    assert lib.add([]) == [] and lib.add([(None, 1)]) == []
    assert len(lib.rows()) == 4


def spoil(lib, but):
    """Makes every bucket unreadable but those named."""
    n = 0
    for folder in os.listdir(lib.path):
        if folder.startswith("bucket=") and int(folder[7:]) not in but:
            for f in os.listdir(f"{lib.path}/{folder}"):
                if f.endswith(".parquet"):
                    with open(f"{lib.path}/{folder}/{f}", "wb") as out:
                        out.write(b"spoiled")
                    n += 1
            for f in os.listdir(f"{lib.path}/{folder}"):
                if f.endswith(".crc"):
                    os.remove(f"{lib.path}/{folder}/{f}")
    return n


def test_a_small_arrival_opens_few_buckets(spark, lib, tmp_path):
    layout = K.Layout(buckets=64)
    lib.add([(f"key{i}", i) for i in range(2000)], layout=layout)
    assert len([d for d in os.listdir(lib.path) if d.startswith("bucket=")]) == 64
    held = [("key7", -1), ("key8", -2)]
    want = {r[0] for r in spark.createDataFrame(held, "k string, o long").select(layout.bucket("k")).collect()}
    # the buckets of unknown keys and of all others cannot even be read
    assert spoil(lib, want) >= 62
    assert set(lib.add(held, layout=layout)) == want
    opened = lib.add([(f"new{i}", i) for i in range(20)] + held, layout=layout)
    assert want <= set(opened) <= want and len(opened) <= 2
    with pytest.raises(Exception):
        lib.add([("key9", 1)], layout=layout) or lib.add([("key10", 1)], layout=layout)


def test_filters_let_no_held_key_through(lib):
    layout = K.Layout(buckets=2, pages=3)
    for start in range(0, 900, 300):
        lib.add([(f"key{i}", i) for i in range(start, start + 300)], layout=layout)
    lib.add([(f"key{i}", i - 5000) for i in range(1000)], layout=layout)
    rows = lib.rows()
    assert [r[0] for r in rows] == list(range(1, 1001)) and {r[1] for r in rows} == {f"key{i}" for i in range(1000)}
    assert all(o == int(k[3:]) for _, k, o in rows[:900])


def test_runs_are_folded(lib, monkeypatch):
    monkeypatch.setattr(K, "FOLDED_RUNS", 3)
    for i in range(5):
        lib.add([(f"k{i}", i), ("same", i)])
    assert lib.names() == ["commit=5-6", "folded=3", "layout=32-1-3", "run=4", "run=5"]
    lib.add([("k9", 9), ("k0", 0)])
    assert lib.names() == ["commit=6-7", "folded=6", "layout=32-1-3"] and [r[1] for r in lib.rows()] == ["k0", "same", "k1", "k2", "k3", "k4", "k9"]


def test_crashes_between_the_writes(lib, monkeypatch):
    lib.add([("a", 1), ("b", 2)])
    commit = K._Runs.commit
    monkeypatch.setattr(K._Runs, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        lib.add([("c", 3)])  # bitmaps and rows, no commit
    monkeypatch.setattr(K._Runs, "commit", commit)
    lib.add([("c", 9), ("d", 4)])
    assert lib.rows() == [(1, "a", 1), (2, "b", 2), (3, "c", 3), (4, "d", 4)]
    # bitmaps without rows: the run is there, its rows are not
    before = lib.path + "-before"
    shutil.copytree(lib.path, before)
    lib.add([("e", 5)])
    os.rename(lib.path, lib.path + "-after")
    os.rename(before, lib.path)
    os.remove(f"{lib.path}_keys/commit=4-5")
    lib.add([("e", 6), ("a", 0)])
    assert lib.rows()[-1] == (5, "e", 6) and len(lib.rows()) == 5


def test_layouts_do_not_mix_and_foreign_tables_are_refused(spark, lib):
    lib.add([("a", 1)])
    with pytest.raises(ValueError, match="made with"):
        lib.add([("b", 1)], layout=K.Layout(buckets=8))
    spark.range(3).select("id", F.lit("x").alias("k"), F.col("id").alias("o")).write.parquet(lib.path + "2")
    lib.path += "2"
    with pytest.raises(ValueError, match="without bitmaps"):
        lib.add([("a", 1)])


def test_a_hot_key_and_without_numbers(spark, lib):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("o"))
    schema = spark.createDataFrame([], "k string, o long").schema
    for _ in range(2):
        K.insert_first(rows, lib.path, "k", ["o"], schema)
    got = K.read_keyed(spark, lib.path, schema)
    assert got.count() == 13_334 and got.where("k = 'hot'").first()["o"] == 0
