"""Fingerprints of texts against a plain loop."""

from hashlib import md5

from assayloom.functions import bits
from assayloom.operators import features as E


def plain(text, q=4):
    if text is None:
        return None
    return sorted({int(md5(text[i: i + q].encode()).hexdigest()[:3], 16) for i in range(len(text) - q + 1)})


def test_positions_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(E, "_CHARS", 40)
    monkeypatch.setattr(E, "_TEXTS", 3)
    texts = [None, "", "abc", "abcd", "é中😀\U0010ffff\n\0x", "aaaaaaaaa", None, "the cat sat on the mat " * 9, "ab", "cd", "ef", "z" * 41]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    got = E.fingerprints(rows)
    assert "regexp_extract_all" not in got._jdf.queryExecution().toString()  # an expression of a few calls for every character
    found = {r["id"]: (r["outcome"], r["positions"]) for r in bits.unpack_positions(got, E.NBITS).collect()}
    assert found == {i: ("null_input" if t is None else "success", plain(t)) for i, t in enumerate(texts)}


def test_grams_of_any_length_and_many_code_points():
    import pyarrow as pa

    texts = ["".join(chr(48 + (i * 7919) % 55_000) for i in range(3_000)), "abab😀" * 30]
    for q in (1, 2, 4, 9):
        assert E._gram_batch(pa.array(texts), q).to_pylist() == [plain(t, q) for t in texts]
    assert E._gram_batch(pa.array([], pa.string()), 4).to_pylist() == []
