"""Collocations against plain Python: counts, parts of any size, odd rows, long texts."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from assayloom.llm import collocations as C


def grams(items):
    """Counts of all phrases of 1 to 4 words by language, and words by language."""
    out, total = defaultdict(Counter), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in items:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total["und" if lang is None else lang] += len(ws)
            for k in range(1, 5):
                out["und" if lang is None else lang].update(" ".join(ws[i: i + k]) for i in range(len(ws) - k + 1))
    return out, total


def brute(items, top=2000, least=30, covered=80):
    out = set()
    counts, total = grams(items)
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if a >= least and " " in p}
        rows = []
        for p, a in found.items():
            ws = p.split(" ")
            cuts = []
            for k in range(1, len(ws)):
                l, r = f[" ".join(ws[:k])], f[" ".join(ws[k:])]
                cuts.append((2000000 * a // (l + r), k, l, r))
            score, _, l, r = min(cuts)
            inside = [b for q, b in found.items() if len(q) > len(p) and f" {p} " in f" {q} "]
            if not any(100 * b >= covered * a for b in inside):
                rows.append((-score, -a, p.encode(), l, r))
        out |= {(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])}
    return out


def table(spark, items, extra=False):
    rows = [(lang, text, i) + (("x",) if extra else ()) for i, (lang, text) in enumerate(items)]
    return spark.createDataFrame(rows, "lang string, text string, doc_id long" + (", rank string" if extra else "")).repartition(3)


def random_items(n, seed):
    rnd = random.Random(seed)
    words = ["a", "B", "b", "cc", "ç", "dé", "e\x1f", "f" * 40, "the", "of", "\x00", "z"]
    return [
        (rnd.choice(["en", "en", "en", "de", None, ""]), "".join(rnd.choice(words) + rnd.choice([" "] * 9 + [". ", "\t", ";x ", "\r\n"]) for _ in range(rnd.randint(0, 40))))
        for _ in range(n)
    ]


@pytest.mark.parametrize("part,mark,chunk", [(2_000_000, 8192, 1_000_000), (64, 4, 150), (1, 1, 33)])
def test_brute_force(spark, part, mark, chunk):
    items = random_items(150 if part > 1 else 30, part)
    least = 6 if part > 1 else 4
    got = C.collocations(table(spark, items), least=least, sizes=C.Sizes(chunk, part, mark))
    want = brute(items, least=least)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 5


def test_odd_rows(spark):
    items = [("en", None), ("en", ""), ("en", " \t\n.;"), (None, "one two. one two"), ("und", "one two")] + [("en", "hot key phrase here")] * 40
    items += [("fr", "x" * 300_000 + " y"), ("fr", "x" * 300_000 + " y"), ("", "no lang"), ("", "no lang")]
    got = {tuple(r) for r in C.collocations(table(spark, items, extra=True), least=2).collect()}
    assert got == brute(items, least=2) and any(r[0] == "und" and r[3] == 3 for r in got)


def test_empty_and_too_few(spark):
    assert C.collocations(table(spark, [("en", "a b")])).count() == 0
    empty = spark.createDataFrame([], "lang string, text string")
    assert C.collocations(empty).count() == 0


def test_long_text_goes_on_over_slices_and_chunks(spark):
    rnd = random.Random(1)
    text = " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "eps,"]) for _ in range(90_000))
    items = [("en", text)]
    assert {tuple(r) for r in C.collocations(table(spark, items), sizes=C.Sizes(20_000, 500, 50)).collect()} == brute(items)


def test_top_is_cut_after_ties(spark):
    items = [("en", f"p{i} q{i}.") for i in range(30) for _ in range(5)]
    got = {tuple(r) for r in C.collocations(table(spark, items), top=7, least=5).collect()}
    assert got == brute(items, top=7, least=5) and len(got) == 7


def test_equal_partitions_of_weighted_pointers():
    rng = np.random.default_rng(3)
    words = [rng.integers(0 if d else 1, 30, 20_000) ** 2 // 40 + (0 if d else 1) for d in range(3)]
    for d in range(1, 3):
        words[d][words[d - 1] == 0] = 0
    times = rng.integers(1, 5, 20_000)
    want = Counter()
    for i, t in enumerate(times.tolist()):
        key = tuple(int(w[i]) for w in words)
        for k in range(1, 4):
            if all(key[:k]):
                want[key[:k]] += t
    got = {tuple(int(words[j][p]) for j in range(k)): n for k, p, n in C.equal_partitions(words, times, 50)}
    assert got == {k: n for k, n in want.items() if n >= 50} and any(len(k) == 3 for k in got)


def test_scores_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(9 * 10**15, 9 * 10**15 + 1, 9 * 10**15 + 2)], "a long, l long, r long")
    got = row.select(F.expr("(CAST(a AS decimal(20, 0)) * 2000000) DIV (CAST(l AS decimal(20, 0)) + r)")).first()[0]
    assert got == 2000000 * 9 * 10**15 // (2 * 9 * 10**15 + 3)
