"""Graph search against brute force: recall, exact scores, ties, copies, odd vectors."""

import numpy as np
import pytest

from assayloom.llm import hnsw as H


def brute(vectors, queries, k):
    width = max(len(v) for v in [*vectors.values(), *queries.values()])
    pad = lambda v: np.array([*v, *[0.0] * (width - len(v))])
    ids = np.array(sorted(vectors))
    held = np.stack([pad(vectors[i]) for i in ids.tolist()])
    lengths = np.sqrt((held * held).sum(axis=1))
    out = {}
    for q, a in queries.items():
        a = pad(a)
        scores = (held * a).sum(axis=1) / (lengths * np.sqrt((a * a).sum()))
        order = [i for i in np.lexsort((ids, -scores)).tolist() if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(scores[i])) for i in order]
    return out


def run(spark, vectors, queries, k=5, extra="", **kw):
    v = spark.createDataFrame([(i, x) for i, x in vectors], "vec_id long, vector array<double>").repartition(4)
    q = spark.createDataFrame([(i, x) for i, x in queries], "query_id long, query array<double>")
    if extra:
        v, q = v.selectExpr("*", f"1 AS {extra}"), q.selectExpr("*", f"1 AS {extra}")
    shape = kw.pop("shape", H.Graph())
    found = H.search(H.build_index(v, kw.pop("most", k), shape, kw.pop("shard_rows", 700)), q, k, shape, **kw).collect()
    out = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    hit = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in rows}) for q, rows in want.items())
    return hit / sum(len(rows) for rows in want.values())


@pytest.mark.parametrize("kind", ["even", "clusters"])
def test_recall_and_scores(spark, kind):
    rng = np.random.default_rng(5)
    whole = rng.normal(size=(3000, 32))
    if kind == "clusters":
        whole = whole * 0.2 + rng.normal(size=(12, 32))[rng.integers(0, 12, 3000)]
    vectors = {i: v.tolist() for i, v in enumerate(whole)}
    queries = {i: vectors[i] for i in range(0, 3000, 50)} | {10_000: rng.normal(size=32).tolist()}
    got, want = run(spark, vectors.items(), queries.items(), query_rows=20), brute(vectors, queries, 5)
    assert recall(got, want) >= 0.97
    every = brute(vectors, queries, 3000)
    for q, rows in got.items():
        scores = dict(every[q])
        assert len(rows) == 5 and all(abs(scores[i] - s) < 1e-12 for i, s in rows)
        assert rows == sorted(rows, key=lambda r: (-r[1], r[0]))


def test_one_layered_graph_is_reachable():
    rng = np.random.default_rng(1)
    shape = H.Graph()
    layers = H.build_graph(rng.normal(size=(1500, 16)), shape)
    assert [len(layer) for layer in layers] == [6, 94, 1500] and layers[-1].shape[1] == 2 * shape.links
    for layer in layers:
        assert ((layer >= -1) & (layer < len(layer))).all()
        for i, row in enumerate(layer.tolist()):
            real = [x for x in row if x >= 0]
            assert len(set(real)) == len(real) and i not in real and -1 not in row[: len(real)]
    seen, todo = {0}, [0]
    while todo:
        new = {x for x in layers[-1][todo.pop()].tolist() if x >= 0} - seen
        seen |= new
        todo += new
    assert len(seen) == 1500


def test_copies_and_ties_go_to_smaller_ids(spark):
    rng = np.random.default_rng(2)
    vectors = {i: [1.0, 2.0, 3.0] for i in range(900)}  # a hot vector
    vectors |= {900 + i: rng.normal(size=3).tolist() for i in range(60)}
    vectors |= {-5: [2.0, 4.0, 6.0], 2000: [0.5, 1.0, 1.5]}  # the same direction
    queries = {0: [1.0, 2.0, 3.0], 4: [4.0, 8.0, 12.0], 950: vectors[950]}
    assert {q: [i for i, _ in rows] for q, rows in run(spark, vectors.items(), queries.items()).items()} == {
        0: [-5, 1, 2, 3, 4], 4: [-5, 0, 1, 2, 3], 950: [i for i, _ in brute(vectors, queries, 5)[950]],
    }


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    sound = {1: [1.0, 0.0], 2: [0.0, 1.0], 3: [2.0**600, 2.0**600], 4: [2.0**-600, 0.0], 5: [1.0, 1.0, 1.0], 6: [-1.0]}
    odd = [(7, None), (8, []), (9, [0.0, -0.0]), (10, [nan, 1.0]), (11, [inf, 1.0]), (12, [None, 1.0]), (None, [1.0, 1.0])]
    twice = [(1, [9.0, 9.0])]  # the smaller vector of a repeated id counts
    queries = [*sound.items(), (20, None), (21, [0.0]), (22, [nan]), (None, [1.0]), (23, [0.0, 0.0, 0.0, 2.0])]
    got = run(spark, [*sound.items(), *odd, *twice], queries, k=5, extra="shard")
    flat = sound | {3: [1.0, 1.0], 4: [1.0, 0.0]}
    want = brute(flat, {i: flat[i] for i in flat}, 5)
    for q in flat:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]])
    assert [i for i, _ in got[23]] == [1, 2, 3, 4, 5] and set(got) == {*flat, 23}


def test_few_and_none(spark):
    assert run(spark, [(1, [1.0])], [(1, [1.0])]) == {}
    assert run(spark, [], [(1, [1.0])]) == {} and run(spark, [(1, [1.0])], []) == {}
    assert run(spark, [(1, [1.0]), (2, [2.0])], [(1, [1.0])]) == {1: [(2, 1.0)]}


def test_registered_query_reaches_its_recall(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    vectors = {r.vec_id: [float(x) for x in r.embedding] for r in rows}
    want = brute(vectors, {i: v for i, v in vectors.items() if i % 50 == 0}, 5)
    got = {}
    for r in H.op11(spark, folder).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert recall(got, want) >= 0.99
