"""Exact dedup: ties, nulls, repeated rows, colliding digests, restarts."""

from pyspark.sql import functions as F

from assayloom.llm import exact_dedup as D
from assayloom.runtime import work_path
from small_tables import docs_of  # noqa: F401


def rows(df):
    return {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect()}


def test_nulls_empties_and_ties(docs_of):
    got = rows(D.decide(docs_of(["a", None, "", "a", "b", "A", "a "])))
    assert got == {(0, 3, 2, False), (3, 3, 2, True), (1, 2, 2, False), (2, 2, 2, True), (4, 4, 1, True), (5, 5, 1, True), (6, 6, 1, True)}


def test_colliding_digests_are_told_apart_by_bytes(docs_of):
    docs = docs_of(["a", "b", "a", "b", "c", "cc", "d"])
    one = D.decide(docs, digest=lambda t: F.length(t).cast("string"))
    assert rows(one) == {(0, 2, 2, False), (2, 2, 2, True), (1, 3, 2, False), (3, 3, 2, True), (4, 4, 1, True), (5, 5, 1, True), (6, 6, 1, True)}
    left = D.drop_copies(docs, digest=lambda t: F.length(t).cast("string"))
    assert sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 5, 6]


def test_repeated_rows_and_null_ids(docs_of):
    docs = docs_of([(1, "x", "s"), (1, "x", "s"), (None, "x", "s"), (None, "y", "s"), (1, "y", "s")], extra="digest")
    assert rows(D.decide(docs)) == {(1, 1, 3, True), (None, 1, 3, False), (None, 1, 2, False), (1, 1, 2, True)}
    left = D.drop_copies(docs)
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(1, "x"), (1, "y")]
    assert left.columns == docs.columns


def test_empty_table(docs_of, spark):
    none = docs_of(["a"]).where("false")
    assert D.decide(none).count() == 0 and D.drop_copies(none).count() == 0


def test_large_group_and_long_text(docs_of):
    text = "word " * 40_000
    got = D.decide(docs_of([text] * 300 + [text + "x"])).where("kept").collect()
    assert {(r.doc_id, r.group_size) for r in got} == {(299, 300), (300, 1)}


def test_state_goes_on_after_a_restart(docs_of, spark):
    state = work_path(spark, "kept-state")
    for _ in range(2):
        D.decide(docs_of([(1, "a", "s"), (2, "b", "s")]), state_path=state, batch="first")
    again = D.decide(docs_of([(3, "a", "s"), (4, "c", "s")]), state_path=state)
    assert rows(again) == {(3, 3, 2, True), (4, 4, 1, True)}
