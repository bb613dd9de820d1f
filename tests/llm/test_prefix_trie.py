"""The trie against plain Python, with sound and with bad hashes, long conversations, odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from assayloom.llm import prefix_trie as P


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    nodes, ends = defaultdict(set), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        path = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            nodes[path[:d]].add(c)
        ends[path].append(c)
    kids = defaultdict(list)
    for path in nodes:
        if path:
            kids[path[:-1]].append(path)
    leaves, saved, out = {}, {}, set()
    for path in sorted(nodes, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in kids[path]) or 1
        saved[path] = sum(saved[k] for k in kids[path]) + ((len(nodes[path]) - 1) * len(path[-1][1]) if path else 0)
        digest = hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest()
        out.add((min(nodes[path]), len(path), min(nodes[path[:-1]]) if path else None, len(nodes[path]), len(kids[path]), leaves[path], saved[path], digest))
    return out


def table(spark, rows, extra=False):
    rows = [(*r, "x") if extra else tuple(r) for r in rows]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string" + (", depth string" if extra else "")).repartition(3)


def result(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in df.collect())


def random_rows(n, seed, texts=3):
    rnd = random.Random(seed)
    return [
        (c, t, rnd.choice(["user", "assistant"]), "é" * rnd.randint(0, texts))
        for c in [*range(n), *range(200, 200 + n // 2), -1, -150] for t in range(rnd.choice([1, 1, 2, 3, 7, 9]))
    ]


def test_brute_force(spark):
    rows = random_rows(60, 4)
    got = result(P.prefix_trie(table(spark, rows)))
    assert got == sorted(brute(rows)) and len(got) > 100


def weak(role, text):
    return F.pmod(F.length(text).cast("long"), F.lit(2)), F.lit(7).cast("long")


@pytest.mark.parametrize("hashes", [weak, lambda r, t: (F.lit(0).cast("long"), F.lit(0).cast("long"))])
def test_bad_hashes_are_found_out(spark, hashes):
    rows = random_rows(30, 9)
    assert result(P.prefix_trie(table(spark, rows), hashes)) == sorted(brute(rows))


def test_mixed_fingerprints_of_different_paths(spark, monkeypatch):
    """Turns are told apart, but their places carry no weight: prefixes of permuted turns collide."""
    monkeypatch.setattr(P, "_power", lambda lane, place: F.lit(1).cast("long"))
    monkeypatch.setattr(P, "_moved", lambda lane, value, back: value)
    rnd = random.Random(3)
    rows = [(c, t, "user", rnd.choice("ab")) for c in range(30) for t in range(6)]
    assert result(P.prefix_trie(table(spark, rows))) == sorted(brute(rows))


def test_odd_rows(spark):
    rows = [
        (1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, 0, "a", "z"), (None, 1, "user", "lost"),
        (3, 5, "user", ""), (100, 0, "user", "hi"), (101, 0, "user", "other"), (102, 3, "", "u\U0001f600"), (102, 4, "user", "long" * 50_000),
    ]
    rows += [(c, t, "user", f"same {t}") for c in range(300, 360) for t in range(3)]  # copies
    assert result(P.prefix_trie(table(spark, rows, extra=True))) == sorted(brute(rows))


def test_long_conversations_are_cut_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 7)
    monkeypatch.setattr(P, "SEGMENT", 4)
    rows = [(c, t, "user", "abc"[(t * t + (t > 90) * c) % 3]) for c in range(12) for t in range(100)]
    assert result(P.prefix_trie(table(spark, rows))) == sorted(brute(rows))


def test_empty(spark):
    assert result(P.prefix_trie(table(spark, []))) == []
    assert result(P.prefix_trie(table(spark, [(None, 0, "user", "x")]))) == []


def test_powers_of_large_places(spark):
    places = [0, 1, 255, 256, 70_000, 2**31 + 5]
    got = spark.createDataFrame([(p,) for p in places], "p long").select("p", *[P._power(i, F.col("p")) for i in range(4)]).collect()
    assert all(tuple(r)[1:] == tuple(pow(b, r.p, p) for b, p in zip(P.BASES, P.PRIMES)) for r in got)
