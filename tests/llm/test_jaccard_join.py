"""Jaccard join against brute force, the signature theorem, and odd inputs."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from assayloom.llm import components as C, jaccard_join as J
from small_tables import docs_of  # noqa: F401


def brute(texts, n, under, over):
    sets = []
    for t in texts:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        sets.append({tuple(w[i: i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and over * len(a & b) >= under * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {(i, len(s), find(i)) for i, s in enumerate(sets)}


def corpus(seed, groups=12, copies=6):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(groups):
        base = [rnd.choice(words) for _ in range(rnd.choice([3, 6, 12, 40, 150, 600]))]
        for _ in range(copies):
            own = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            texts.append(" ".join(own))
    return texts + ["", None, " \t\n", "one", "ONE", "one two", "É é", "é É"]


@pytest.mark.parametrize("n, under", [(4, 85), (5, 80)])
def test_against_brute_force(docs_of, n, under):
    texts = corpus(under)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in J.similar_groups(docs_of(texts), n, under, 100).collect()}
    assert got == brute(texts, n, under, 100)


def test_blocks_find_links_that_the_smallest_member_lacks(docs_of, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 3)
    texts = corpus(5, groups=4, copies=14)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in J.similar_groups(docs_of(texts), 4, 85, 100).collect()}
    assert got == brute(texts, 4, 85, 100)


@pytest.mark.parametrize("n", [4, 5])
@pytest.mark.parametrize("text", ["a", "a b", "a b c", "a b c d"])
def test_a_short_text_hashed_alone(docs_of, text, n):
    got = [tuple(r) for r in J.similar_groups(docs_of([text]), n, 80, 100).collect()]
    assert got == [(0, 1, 0)]


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 900), st.integers(0, 10**6), st.sampled_from([(85, 100), (80, 100), (4, 5), (9, 10)]))
def test_similar_sets_share_a_signature(size, seed, ratio):
    under, over = ratio
    like = J.Likeness(4, under, over)
    rng = np.random.default_rng(seed)
    whole = np.unique(rng.integers(0, 2**63, size, dtype=np.int64).astype(np.uint64) * np.uint64(2))
    drop = rng.integers(0, len(whole) * (over - under) // over + 1)
    a = np.delete(whole, rng.choice(len(whole), drop, replace=False))
    add = np.unique(rng.integers(0, 2**63, len(whole), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    b = whole
    for extra in range(0, len(whole)):
        wider = np.union1d(whole, add[: extra + 1])
        if over * len(a) < under * len(wider):
            break
        b = wider
    if J._linked(a, b, like) and not np.array_equal(a, b):
        assert set(J.signatures(a, like).tolist()) & set(J.signatures(b, like).tolist())
    assert J._may_link(J._binned(a), J._binned(b), like) or not J._linked(a, b, like)


def test_odd_rows(docs_of):
    docs = docs_of([(None, "a b c d e", "s"), (4, "a b c d e", "s"), (4, "a b c d e", "s"), (3, "p q r s t u", "s"), (4, "p q r s t u", "s")], extra="component_id")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in J.similar_groups(docs, 4, 85, 100).collect())
    assert got == [(False, 3, 3, 3), (False, 4, 2, 3), (False, 4, 2, 3), (False, 4, 3, 3), (True, 0, 2, 0)]
    left = J.keep_one(docs, 4, 85, 100)
    assert left.columns == docs.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 3]
    assert J.similar_groups(docs.where("false"), 4, 85, 100).count() == 0


def test_a_doc_id_with_a_copy_and_a_text_of_its_own(docs_of):
    a, b = "a b c d e", " ".join(f"w{i}" for i in range(60))
    c = " ".join(f"v{i}" for i in range(60))
    docs = docs_of([
        (1, a, "s"), (4, a, "s"), (4, b, "s"), (7, b + " x", "s"), (2, a + " z", "s"),
        (20, "p q r s t", "s"), (21, "p q r s t", "s"), (21, c, "s"), (22, c, "s"), (23, c + " x", "s"), (30, c + " q r s t u v w x y z a b c d", "s"),
    ])
    got = sorted({(r.doc_id, r.component_id) for r in J.similar_groups(docs, 4, 85, 100).collect()})
    assert got == [(1, 1), (2, 2), (4, 1), (7, 1), (20, 20), (21, 20), (22, 20), (23, 20), (30, 30)]
    assert sorted({r.doc_id for r in J.keep_one(docs, 4, 85, 100).collect()}) == [1, 2, 20, 30]


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).selectExpr("id AS u", "id + 1 AS v").union(spark.sql("SELECT 900L AS u, 901L AS v"))
    got = {r.id: r.component for r in C.components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {900: 900, 901: 900}


def test_words_that_meet_under_polynomial_hashes_stay_apart(docs_of):
    """The word of Thue and Morse and its mirror have one polynomial hash modulo 2^64, whatever the base."""
    texts = []
    for bits in (10, 11, 12):
        marks = [bin(i).count("1") % 2 for i in range(1 << bits)]
        texts += ["".join("ab"[m] for m in marks), "".join("ba"[m] for m in marks)]
    got = {r.doc_id: r.component_id for r in J.similar_groups(docs_of(texts), 4, 85, 100).collect()}
    assert got == {i: i for i in range(6)}


def test_word_hashes_take_every_byte_and_the_length():
    from assayloom.llm.shingles import word_hashes

    words = [b"x" * n for n in range(1, 300)] + [b"x" * n + b"y" for n in range(0, 299)] + [b"y" + b"x" * n for n in range(1, 299)]
    data = np.frombuffer(b" ".join(words), np.uint8)
    hashes, first, last = word_hashes(data, np.zeros(1, np.int64))
    assert len(hashes) == len(words) and len(set(hashes.tolist())) == len(set(words))
    again, _, _ = word_hashes(np.frombuffer(b" ".join(words).upper(), np.uint8), np.zeros(1, np.int64))
    assert (again == hashes).all() and [data[a:z].tobytes() for a, z in zip(first, last)] == words


def test_a_very_long_text(docs_of):
    """Texts beyond the size that is hashed together, one of them a single word."""
    long = " ".join(f"w{i % 70_000}" for i in range(300_000))
    got = [tuple(r)[1:] for r in J.similar_groups(docs_of([long, long + " tail", "z" * 3_000_000, "a b c d e"]), 4, 85, 100).orderBy("doc_id").collect()]
    assert got == [(70_000, 0), (70_001, 0), (1, 2), (2, 3)]


def test_one_signature_of_a_third_of_all_rows(docs_of):
    base = [f"w{i}" for i in range(80)]
    texts = [" ".join([*base, f"own{i}"]) for i in range(60)] + [" ".join(f"t{i}x{j}" for j in range(30)) for i in range(120)]
    got = [r.component_id for r in J.similar_groups(docs_of(texts), 4, 85, 100).orderBy("doc_id").collect()]
    assert got == [0] * 60 + list(range(60, 180))


@pytest.mark.parametrize("size", [7, 33, 95, 240, 1700, 9000])
def test_sets_that_differ_in_their_strongest_parts_share_a_signature(size):
    """The most differences that a link allows, each in another part, the fullest parts first."""
    like = J.Likeness(5, 80, 100)
    for seed in range(5):
        rng = np.random.default_rng(seed)
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.int64).astype(np.uint64) * np.uint64(2))
        lasts = J._bands(like, 4 * size)
        own = int(np.searchsorted(lasts, size))
        n1, n2, _, borders, _ = J._layout(like, own, int(lasts[own]))
        part = np.searchsorted(borders, a, side="right")
        held = np.bincount(part, minlength=n1 * n2)
        turn = np.empty(len(a), int)  # a shingle's turn within its part
        for p in range(n1 * n2):
            turn[part == p] = np.arange(held[p])
        b = np.delete(a, np.lexsort((-held[part], turn))[: size // 5])
        assert J._linked(a, b, like)
        assert set(J.signatures(a, like).tolist()) & set(J.signatures(b, like).tolist())


def test_unlike_sets_with_common_lines_seldom_share_signatures():
    """600 shingles each, a fifth of them out of 300 common ones; with all signatures of a set kept, 5,041 rows were shared."""
    like, rng = J.Likeness(5, 80, 100), np.random.default_rng(3)
    draw = lambda n: rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2)
    common = draw(300)
    sets = [np.unique(np.concatenate([rng.choice(common, 120, replace=False), draw(480)])) for _ in range(200)]
    _, held = np.unique(np.concatenate([J.signatures(s, like) for s in sets]), return_counts=True)
    assert held[held > 1].sum() < 3000


def test_rows_grow_with_a_group_and_not_with_its_square(docs_of, monkeypatch):
    """Texts just below the threshold, all with one base: no two link, so every signature stays open."""
    monkeypatch.setattr(J, "BLOCK", 4)
    monkeypatch.setattr(J, "MOST_BLOCKS", 3, raising=False)
    written, put = {}, J.put

    def counted(df, label):
        table = put(df, label)
        written[label] = written.get(label, 0) + table.count()
        return table

    monkeypatch.setattr(J, "put", counted)
    base, rows = [f"w{i}" for i in range(100)], []
    for m in (40, 120):
        written.clear()
        texts = [" ".join(base + [f"own{i}x{j}" for j in range(9)]) for i in range(m)]
        got = {(r.doc_id, r.n_shingles, r.component_id) for r in J.similar_groups(docs_of(texts), 4, 85, 100).collect()}
        assert got == {(i, 106, i) for i in range(m)}
        rows.append(dict(written))
    few, many = rows
    assert many["mixed"] > many["few-bins"] and all(many[k] <= 3.9 * n + 40 for k, n in few.items())


@pytest.mark.parametrize("block, most, size", [(3, 2, 1), (2, 32, 10**9), (256, 32, 16 << 20)])
def test_buckets_are_dealt_without_loss(docs_of, monkeypatch, block, most, size):
    """However blocks are cut and tiles laid, the groups are those of brute force."""
    for name, value in (("BLOCK", block), ("MOST_BLOCKS", most), ("BLOCK_BYTES", size), ("_TILE", 5)):
        monkeypatch.setattr(J, name, value)
    rnd, texts = random.Random(block), []
    for base in range(3):
        words = [f"b{base}w{i}" for i in range(90)]
        for i in range(25):
            own = words[:]
            for at in rnd.sample(range(90), rnd.choice([1, 1, 2, 3])):
                own[at] = f"b{base}o{rnd.randrange(6)}"
            texts.append(" ".join(own + [f"b{base}e{rnd.randrange(4)}"] * (i % 3)))
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in J.similar_groups(docs_of(texts), 4, 85, 100).collect()}
    assert got == brute(texts, 4, 85, 100)


def test_alike_buckets_become_one_and_others_stay(spark):
    """Each bucket's rows stay together, and neither rows nor pairs grow."""
    held = {1: range(0, 30), 2: range(0, 31), 3: [0, 40, 41, 42], 4: [50, 60, 61, 62], 5: [50, 70, 71, 72], 6: [50, 80, 81, 82]}
    rows = [(b, i, i, min(ids), len(ids)) for b, ids in held.items() for i in ids]
    got = J._gathered(spark.createDataFrame(rows, "bucket long, id long, component long, low long, held long")).collect()
    sets, says = {}, {}
    for r in got:
        sets.setdefault(r.bucket, set()).add(r.id)
        says[r.bucket] = r.held
    assert says == {b: len(s) for b, s in sets.items()} and len(got) == sum(says.values()) == 34 + 12
    assert all(any(set(ids) <= s for s in sets.values()) for ids in held.values())
    assert {b for b in sets if b in held} == {4, 5, 6}


def test_buckets_whose_smallest_ids_meet_become_one(spark):
    """Like sets without their smallest ones: the buckets nest, and their rows are dealt once."""
    held = {1: range(0, 30), 2: range(1, 31), 3: range(2, 32), 4: [0, 90, 91], 5: [90, 91, 92, 93], 6: [92, 94, 95, 96]}
    rows = [(b, i, i, min(ids), len(ids)) for b, ids in held.items() for i in ids]
    got = J._gathered(spark.createDataFrame(rows, "bucket long, id long, component long, low long, held long")).collect()
    sets, says = {}, {}
    for r in got:
        sets.setdefault(r.bucket, set()).add(r.id)
        says.setdefault(r.bucket, set()).add(r.held)
    assert says == {b: {len(s)} for b, s in sets.items()} and len(got) == sum(map(len, sets.values()))
    assert all(any(set(ids) <= s for s in sets.values()) for ids in held.values())
    assert sorted(map(len, sets.values())) == [4, 36]


def test_rows_of_cells_grow_no_faster_than_a_group(docs_of, monkeypatch):
    """Sizes at which blocks of 256 rows made 16 times the rows out of 4 times the texts; none of the texts link."""
    written, put = {}, J.put

    def counted(df, label):
        table = put(df, label)
        written[label] = table.count()
        return table

    monkeypatch.setattr(J, "put", counted)
    base, rows = [f"w{i}" for i in range(100)], []
    for m in (250, 1000):
        texts = [" ".join(base + [f"own{i}x{j}" for j in range(9)]) for i in range(m)]
        assert J.similar_groups(docs_of(texts), 4, 85, 100).where("doc_id != component_id").count() == 0
        rows.append(written["mixed"])
    assert 250 <= rows[0] and rows[1] <= 4 * rows[0]


def test_blocks_are_few_however_large_a_bucket_but_for_bytes(spark):
    def cells(m, size):
        rows = spark.range(m).selectExpr("7L AS bucket", "id", "id AS component", "0L AS low", f"{m}L AS held")
        sets = spark.range(m).selectExpr("id", f"cast(repeat('x', {size}) AS binary) AS packed")
        return J._cells(rows, sets)

    for m in (900, 9_000, 90_000):
        assert cells(m, 8).count() <= 8 * m
    heavy = cells(40, 2 << 20)  # 80 MB in blocks of 16 MB
    assert heavy.count() == 6 * 40 and heavy.groupBy("i", "j").count().agg({"count": "max"}).first()[0] < 40


def test_common_shingles_by_products_of_columns(monkeypatch):
    monkeypatch.setattr(J, "_COLUMNS", 7)
    rng = np.random.default_rng(1)
    x, y = ([np.unique(rng.integers(0, 90, rng.integers(1, 40))).astype(np.uint64) for _ in range(n)] for n in (9, 5))
    for a, b in ((x, y), (x, x), (x[:1], y[:1]), ([x[0] + np.uint64(1000)], y)):
        got, want = J._common(a, b), np.array([[len(np.intersect1d(s, t)) for t in b] for s in a])
        if a is b:  # a set has nothing to say about itself
            np.fill_diagonal(got, 0), np.fill_diagonal(want, 0)
        assert got.tolist() == want.tolist()
