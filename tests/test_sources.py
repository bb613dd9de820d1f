"""Readers on hand-made files with the faults that real folders have."""

import json

import pytest
from pyspark.sql import functions as F

from assayloom.functions.text import trailing_round
from assayloom.operators.joins import latest_hparams
from assayloom.sources import files as S


def test_line_files(spark, tmp_path):
    (tmp_path / "AA").mkdir()
    (tmp_path / "AB" / "deep").mkdir(parents=True)
    (tmp_path / "AA" / "AAML.smi").write_text("smiles zinc_id\nC1 Z1\nonly\n\n  C\\2\"x\t Z2  extra\n")
    (tmp_path / "AB" / "ABML.smi").write_text("smiles zinc_id\nC3 Z1\n")
    (tmp_path / "AB" / "deep" / "x.smi").write_text("header\nC4,5 Z4\n")
    (tmp_path / "AB" / "notes.txt").write_text("h\nC9 Z9\n")
    got = sorted((r["raw"], r["zinc_id"], r["tranche"]) for r in S.read_lines(spark, str(tmp_path)).collect())
    assert got == [("C1", "Z1", "AA/AAML"), ("C3", "Z1", "AB/ABML"), ("C4,5", "Z4", "deep/x"), ('C\\2"x', "Z2", "AA/AAML")]


def test_progress_csv(spark, tmp_path):
    head = "docked,valid,failed,best1,best10,best100,best1000,elapsed_s,timestamp\n"
    (tmp_path / "dock_progress_e_round2.csv").write_text(head + "500,490,10,-9.5,-8.0,,,3,t\nbad,1,1,-1,,,,3,t\n1000,980,20,oops,,,,6,t\n")
    (tmp_path / "dock_progress_e_round10.csv").write_text(head + "500,500,0,-7,,,,3,t\n")
    got = sorted(tuple(r) for r in S.read_progress(spark, str(tmp_path / "*.csv")).collect())
    assert got == [(2, 500, -9.5, -8.0, None, None), (10, 500, -7.0, None, None, None)]


def test_metrics_json(spark, tmp_path):
    (tmp_path / "metrics_round3.json").write_text(json.dumps({"val_rmse": 1.5, "n_train": 9, "n_val": 1, "best_docking_score": -3}, indent=2))
    (tmp_path / "metrics_round4.json").write_text(json.dumps({"n_train": 9}))
    (tmp_path / "metrics.json").write_text(json.dumps({"val_rmse": 2.0}))
    got = S.read_metrics_json(spark, str(tmp_path / "*.json")).collect()
    assert [(r["round"], r["val_rmse"], r["n_train"]) for r in got] == [(3, 1.5, 9)]


def test_latest_hparams_by_number_not_by_name(spark, tmp_path):
    for r in range(12):
        (tmp_path / f"hparams_T_e_round{r}.json").write_text(json.dumps({"max_depth": 3 + r, "learning_rate": 0.1}))
    table = S.read_hparams_json(spark, str(tmp_path / "*.json"))
    assert latest_hparams(table, 11).first()["params"]["max_depth"] == 14
    assert latest_hparams(table, 9).first()["params"]["max_depth"] == 12
    assert latest_hparams(table, -1).first()["params"] is None


def test_result_xml(spark, tmp_path):
    def put(n, text):
        (tmp_path / f"ligand_{n}.xml").write_text(text)

    put(1, "<r><best_energy>-5</best_energy><a><best_energy> -7.5 </best_energy></a></r>")
    put(2, "<r><free_NRG_binding>-3</free_NRG_binding><x><free_NRG_binding>-4</free_NRG_binding></x></r>")
    put(3, "<r><other>1</other></r>")
    put(4, "<r><best_energy>-5</best_energy>")
    put(5, "<r><best_energy>2.5</best_energy></r>")
    put(6, "<r><best_energy>n/a</best_energy><free_NRG_binding>-2</free_NRG_binding></r>")
    got = {r["compound_id"]: r["score"] for r in S.read_result_xml(spark, str(tmp_path)).collect()}
    assert got == {1: -7.5, 2: -4.0, 3: None, 4: None, 5: None, 6: -2.0}


@pytest.mark.parametrize("path,want", [
    ("/m/hparams_T_round12.json", 12), ("/round3/x.json", None), ("/m/a_round.json", None), ("/m/round7", 7),
])
def test_trailing_round(spark, path, want):
    assert spark.range(1).select(trailing_round(F.lit(path)).alias("r")).first()["r"] == want


def test_delimited(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("Name\tLogP\nA b\t3.1\nC\tx\n")
    got = S.read_delimited(spark, str(tmp_path / "t.tsv"), "Name string, LogP double", sep="\t").collect()
    assert [tuple(r) for r in got] == [("A b", 3.1), ("C", None)]


def test_more_lines_make_more_files_in_the_same_order(spark, folder, monkeypatch):
    """All lines went through four tasks, however many there were."""
    from assayloom.catalog import registry, sources

    monkeypatch.setattr(sources, "LINES_PER_TASK", 20, raising=False)
    views = registry.Views(spark, folder)
    out = sources.write_line_files(views, "many-lines", F.concat(F.lit("c"), "doc_id", F.lit(" Z"), "doc_id"))
    rows = S.read_lines(spark, out).select("raw", "file", "block", "pos").collect()
    docs = views.table("documents").select("doc_id", "lang").collect()
    assert sorted(r["raw"] for r in rows) == sorted(f"c{d['doc_id']}" for d in docs)
    by_lang = {}
    for r in sorted(rows, key=lambda r: (r["file"], r["block"], r["pos"])):
        by_lang.setdefault(r["file"].split("lang=")[1].split("/")[0], []).append(int(r["raw"][1:]))
    assert all(ids == sorted(ids) for ids in by_lang.values())
    assert len({r["file"].rsplit("/", 1)[1] for r in rows}) == -(-len(docs) // 20)
