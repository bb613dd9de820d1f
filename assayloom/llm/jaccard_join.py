"""Similarity join of word-shingle sets under Jaccard, with PartEnum signatures.

Sets are put into bands of like sizes; a set takes part in its own band and the next, so any two sets that can be similar
meet in one. In a band, similar sets differ in at most k shingles. The shingle domain is cut into first-level parts, each into
second-level parts; a signature is one first-level part without one of its second-level parts. Since some first-level part
holds at most one of the k differences, similar sets share a signature. With spare parts they share several, and every set
leaves out as many of its weakest, those of the fewest shingles. Sharing one proves nothing: every link is checked on the
whole sets. Shingles go by 64-bit hashes of their words, which have no algebra that texts could meet on.

Equal sets are folded first. Signatures travel as packed arrays, dealt by signature. A signature's sets are compared with
the smallest of them; where a signature still holds more than one component, its sets are compared in blocks, pairs that
already are in one component excepted. So no link between components is missed and no group emits all its pairs. Like sets
meet in many signatures, so signatures of one smallest set, and those whose smallest sets meet each other, are compared as one
where that makes fewer pairs. Before whole sets travel, counts of their shingles in a few bins bound the difference from below
and rule out most pairs safely.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from assayloom.llm.components import components
from assayloom.llm.registry import query
from assayloom.llm.shingles import mix, shingle_sets
from assayloom.llm.tables import documents, narrow_side, put, small_batches

_U = np.uint64
#: Signatures that one task sorts; the number of parts they are dealt to follows from the sum of all set sizes.
SIGNATURES_PER_TASK = 500_000
#: Signatures a task gathers before it hands them on, packed.
SIGNATURES_PER_PACK = 300_000
#: Sets of one block of a large signature, until there are MOST_BLOCKS; then the blocks grow, as each row goes to every block.
BLOCK = 1024
MOST_BLOCKS = 8
#: There are more blocks than that only if one would hold more bytes of packed sets.
BLOCK_BYTES = 16 << 20
_ROWS = 512
#: Bins of pairs that are compared at once, rows of a cell whose pairs are listed at once, and shingles counted at once.
_COMPARED = 1 << 20
_TILE = 512
_COLUMNS = 4096


@dataclass(frozen=True)
class Likeness:
    """Two sets link if over * |A and B| >= under * |A or B|; shingles have n words."""

    n: int
    under: int
    over: int


@lru_cache(maxsize=8)
def _bands(like: Likeness, largest: int) -> np.ndarray:
    """Last sizes of the bands: sizes l..r with r = floor(l / threshold)."""
    out, last = [0], 0
    while last < largest:
        last = (last + 1) * like.over // like.under
        out.append(last)
    return np.array(out)


@lru_cache(maxsize=4096)
def _layout(like: Likeness, band: int, last: int):
    """(first-level parts, second-level parts, signatures to leave out, borders, tags) of a band, or None if only equal sets link."""
    k = 2 * last * (like.over - like.under) // (like.over + like.under)
    if k == 0:
        return None
    n1, n2 = -(-(k + 1) // 2), 3 if k < 32 else 2
    n1 += (n1 + 2) // 10
    parts = n1 * n2
    borders = np.array([(i << 64) // parts for i in range(1, parts)], dtype=_U)
    tags = mix(np.arange(parts, dtype=_U) + (_U(band) << _U(32)))
    # k differences spoil at most parts - (2 * n1 - k) signatures, so similar sets share at least one more than are left out
    return n1, n2, 2 * n1 - k - 1, borders, tags


def signatures(shingles: np.ndarray, like: Likeness) -> np.ndarray:
    """PartEnum signatures of one sorted set, for its own size band and the next.

    Similar sets share more signatures than are left out. Those of the fewest shingles are, since unlike sets meet there most;
    the order goes by what a signature is made of, so the last of the shared ones in it is kept by both sets.
    """
    size = len(shingles)
    if not size:
        return np.zeros(0, _U)
    lasts = _bands(like, 2 * (1 << size.bit_length()))
    own = int(np.searchsorted(lasts, size))
    total = np.concatenate([np.zeros(1, _U), np.cumsum(mix(shingles + _U(0xA5A5A5A5)))])
    out = []
    for band in (own, own + 1):
        layout = _layout(like, band, int(lasts[band]))
        if layout is None:
            continue
        n1, n2, left_out, borders, tags = layout
        at = np.concatenate([[0], np.searchsorted(shingles, borders), [size]])
        sums, held = np.diff(total[at]).reshape(n1, n2), np.diff(at).reshape(n1, n2)
        without = sums.sum(axis=1, keepdims=True) - sums
        made_of = (held.sum(axis=1, keepdims=True) - held).ravel().astype(_U)
        found = mix(mix(without).ravel() + tags)
        order = np.argsort(made_of << _U(32) | found >> _U(32), kind="stable")
        out.append(found[order[left_out:]])
    return np.concatenate(out) if out else np.zeros(0, _U)


def _linked(a: np.ndarray, b: np.ndarray, like: Likeness) -> bool:
    small, large = sorted((len(a), len(b)))
    if not small or like.over * small < like.under * large:
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return like.over * common >= like.under * (small + large - common)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))


def set_keys(docs: DataFrame, like: Likeness) -> DataFrame:
    """(id, n_shingles, k1, k2) of every row: the size and a 128-bit key of its set."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                part = b.slice(at, _ROWS)
                keys = [
                    (len(s), int(mix(s + _U(1)).sum(dtype=_U).view(np.int64)), int(mix(s ^ _U(0x5DEECE66D)).sum(dtype=_U).view(np.int64)))
                    for s in shingle_sets(part.column("text"), like.n)
                ]
                sizes, k1, k2 = zip(*keys) if keys else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(sizes, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64())],
                    names=["id", "n_shingles", "k1", "k2"],
                )

    return _texts(docs).mapInArrow(run, "id long, n_shingles long, k1 long, k2 long")


def _packed(rows: DataFrame, like: Likeness, parts: int) -> DataFrame:
    """Signatures of all rows as packed arrays, one row for each task's pack and part."""

    def pack(ids: list, found: list):
        sigs = np.concatenate(found)
        index = np.repeat(np.arange(len(ids), dtype=np.uint32), [len(f) for f in found])
        order = np.argsort(sigs)
        sigs, index = sigs[order], index[order]
        part = ((sigs >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)
        ends = np.searchsorted(part, np.arange(parts + 1))
        names = np.array(ids, np.int64)
        out = []
        for p in range(parts):
            a, b = ends[p], ends[p + 1]
            if a < b:
                used, where = np.unique(index[a:b], return_inverse=True)
                kind = np.uint16 if len(used) < 1 << 16 else np.uint32
                s = sigs[a:b]
                low = (s & _U(0xFFFFFFFF)).astype(np.uint32).tobytes() + ((s >> _U(32)) & _U(0xFFFF)).astype(np.uint16).tobytes()
                out.append((p, low, where.astype(kind).tobytes(), names[used].tobytes()))
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["part", "sigs", "rows", "ids"],
        )

    def run(batches):
        ids, found, held = [], [], 0
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                part = b.slice(at, _ROWS)
                for i, s in zip(part.column("id").to_pylist(), shingle_sets(part.column("text"), like.n)):
                    sig = signatures(s, like)
                    if len(sig):
                        ids.append(i)
                        found.append(sig)
                        held += len(sig)
                    if held >= SIGNATURES_PER_PACK:
                        yield pack(ids, found)
                        ids, found, held = [], [], 0
        if held:
            yield pack(ids, found)

    return rows.mapInArrow(run, "part int, sigs binary, rows binary, ids binary")


def _shared(packed: DataFrame) -> DataFrame:
    """(bucket, id, low, held): each set of ids that share a signature, once per part, with its smallest id and its size.

    The packs come sorted by part, so a task holds one part at a time.
    """

    def run(batches):
        sigs, ids, part = [], [], None
        for b in batches:
            for p, s, r, i in zip(*[b.column(c).to_pylist() for c in ("part", "sigs", "rows", "ids")]):
                if p != part and sigs:
                    yield from _buckets(np.concatenate(sigs), np.concatenate(ids))
                    sigs, ids = [], []
                part, n = p, len(s) // 6
                low = np.frombuffer(s, np.uint32, n).astype(_U)
                high = np.frombuffer(s, np.uint16, n, 4 * n).astype(_U)
                where = np.frombuffer(r, np.uint16 if len(r) == 2 * n else np.uint32)
                sigs.append(high << _U(32) | low)
                ids.append(np.frombuffer(i, np.int64)[where])
        if sigs:
            yield from _buckets(np.concatenate(sigs), np.concatenate(ids))

    return packed.mapInArrow(run, "bucket long, id long, low long, held long")


def _buckets(sig: np.ndarray, id_: np.ndarray):
    order = np.lexsort((id_, sig))
    sig, id_ = sig[order], id_[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (id_[1:] != id_[:-1])
    sig, id_ = sig[new], id_[new]
    heads = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    held = np.diff(np.append(heads, len(sig)))
    keep = held > 1
    if not keep.any():
        return
    keys = np.add.reduceat(mix(id_.astype(_U) + _U(0x1234567)), heads).view(np.int64)
    _, once = np.unique(keys[keep], return_index=True)
    for i in np.flatnonzero(keep)[once]:
        a, m = heads[i], held[i]
        for at in range(a, a + m, 65536):
            rows = id_[at: min(a + m, at + 65536)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(rows), v, np.int64)) if c != "id" else pa.array(rows)
                 for c, v in (("bucket", keys[i]), ("id", 0), ("low", id_[a]), ("held", m))],
                names=["bucket", "id", "low", "held"],
            )


def _sets_of(docs: DataFrame, ids: DataFrame, like: Likeness, pack) -> DataFrame:
    """(id, packed): the packed sets of the given ids."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                part = b.slice(at, _ROWS)
                sets = [pack(s) for s in shingle_sets(part.column("text"), like.n)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.binary())], names=["id", "packed"])

    wanted = _texts(docs).join(narrow_side(put(ids.select("id").distinct(), "wanted")), "id", "left_semi")
    return put(wanted.mapInArrow(run, "id long, packed binary"), "packed")


def _whole(shingles: np.ndarray) -> bytes:
    return shingles.tobytes()


def _binned(shingles: np.ndarray) -> bytes:
    """Size of a set and its counts in bins of the shingle domain, about two shingles a bin."""
    bits = max(6, (len(shingles) // 2).bit_length())
    counts = np.bincount((shingles >> _U(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.int64(len(shingles)).tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes()


def _bins(packed: bytes) -> tuple[int, np.ndarray]:
    return int(np.frombuffer(packed, np.int64, 1)[0]), np.frombuffer(packed, np.uint8, offset=8).astype(np.int32)


def _few_bins(binned: DataFrame) -> DataFrame:
    """The binned sets with 64 bins each: few bytes for the many rows of mixed buckets, and a bound from below as well."""

    def run(batches):
        for b in batches:
            out = []
            for p in b.column("packed").to_pylist():
                n, bins = _bins(p)
                out.append(np.int64(n).tobytes() + np.minimum(_coarse(bins, 64), 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.binary())], names=["id", "packed"])

    return binned.mapInArrow(run, "id long, packed binary")


def _coarse(bins: np.ndarray, width: int) -> np.ndarray:
    return bins if len(bins) == width else bins.reshape(width, -1).sum(axis=1)


def _may_link(x: bytes, y: bytes, like: Likeness) -> bool:
    """False only if the sets cannot link: sets differ in at least as many shingles as their counts do."""
    (n, a), (m, b) = _bins(x), _bins(y)
    width = min(len(a), len(b))
    least = int(np.abs(_coarse(a, width) - _coarse(b, width)).sum())
    return (like.over - like.under) * (n + m) >= (like.over + like.under) * least


def _set_link(x: bytes, y: bytes, like: Likeness) -> bool:
    return _linked(np.frombuffer(x, _U), np.frombuffer(y, _U), like)


def _checked(pairs: DataFrame, packed: DataFrame, like: Likeness, test) -> DataFrame:
    """The pairs (u, v) that pass a test of their packed sets."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                part = b.slice(at, _ROWS)
                ok = [test(x, y, like) for x, y in zip(part.column("a").to_pylist(), part.column("b").to_pylist())]
                yield part.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    a = packed.select(F.col("id").alias("u"), F.col("packed").alias("a"))
    b = packed.select(F.col("id").alias("v"), F.col("packed").alias("b"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _open(buckets: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows (bucket, id, component, low, held) of the buckets that hold several components."""
    known = buckets.where("held > 2").join(comps.withColumnRenamed("id", "k"), F.col("id") == F.col("k"), "left").select(
        "bucket", "id", F.coalesce("component", "id").alias("component"), "low", "held",
    )
    open_ = known.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("bucket")
    return known.join(open_, "bucket", "left_semi")


def _gathered(rows: DataFrame) -> DataFrame:
    """Rows (bucket, id, component, low, held) of buckets, some as one bucket where that makes fewer pairs.

    First those of one smallest id are put together, then those whose smallest ids lie in buckets of one smallest id. Rows of
    one bucket stay together, so no pair is lost, and neither rows nor pairs grow in number.
    """
    rows = put(_as_one(put(rows, "open").withColumn("lead", F.col("low"))), "open")
    leads = rows.groupBy(F.col("id").alias("low")).agg(F.min("low").alias("lead"))
    return _as_one(put(rows.join(leads, "low"), "led"))


def _as_one(rows: DataFrame) -> DataFrame:
    """Rows with the buckets of one lead as one bucket where that makes fewer pairs."""
    apart = rows.where("id = low").select("lead", "bucket", "held").distinct().groupBy("lead").agg(
        F.sum(F.col("held").cast("double") * F.col("held")).alias("apart"),
        F.count("*").alias("buckets"), F.xxhash64(F.min("bucket")).alias("name"),
    )
    whole = rows.select("lead", "id").distinct().groupBy("lead").agg(F.count("*").alias("whole"), F.min("id").alias("first"))
    alike = whole.join(apart, "lead").where("buckets > 1 and whole * cast(whole as double) <= apart").select("lead", "whole", "first", "name")
    placed = rows.join(put(alike, "alike"), "lead", "left")
    return placed.select(
        F.coalesce("name", "bucket").alias("bucket"), "id", "component",
        F.coalesce("first", "low").alias("low"), F.coalesce("whole", "held").alias("held"),
    ).distinct()


def _cells(rows: DataFrame, packed: DataFrame) -> DataFrame:
    """Rows (bucket, id, component, own, i, j) dealt to pairs of blocks: few blocks a bucket, however many rows it holds.

    Only where a block would hold too many bytes of the packed sets there are more.
    """
    groups = put(rows, "groups")
    lengths = packed.select("id", F.octet_length("packed").alias("bytes"))
    weights = groups.join(lengths, "id").groupBy("bucket").agg(F.sum("bytes").alias("bytes"))
    few = F.least((F.col("held") / BLOCK).cast("int") + 1, F.lit(MOST_BLOCKS))
    light = F.least((F.col("bytes") / BLOCK_BYTES).cast("long") + 1, "held")
    weighed = groups.join(narrow_side(put(weights, "weights")), "bucket")
    rows = weighed.withColumn("blocks", F.greatest(few, light.cast("int")))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    return (
        rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("bucket", "id", "component", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )


def _by_cell(rows: DataFrame, look, kinds: str) -> DataFrame:
    """look(cell) of each (bucket, i, j): its rows meet in one task and are cut out of sorted batches, with no frame per cell."""
    key = ["bucket", "i", "j"]

    def run(batches):
        open_ = []
        for b in batches:
            if open_ and all(b.column(c)[-1] == open_[0].column(c)[0] for c in key):
                open_.append(b)  # sorted, so all of it goes on with the open cell
                continue
            table = pa.Table.from_batches([*open_, b]).combine_chunks()
            values = [table.column(c).to_numpy() for c in key]
            new = np.zeros(table.num_rows, bool)
            for v in values:
                new[1:] |= v[1:] != v[:-1]
            heads = np.append(0, np.flatnonzero(new))
            if len(heads) > 1:
                yield from look(table.slice(0, heads[-1]), heads[:-1])
            open_ = table.slice(heads[-1]).to_batches()
        if open_:
            yield from look(pa.Table.from_batches(open_).combine_chunks(), np.zeros(1, np.int64))

    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, kinds)


def _candidates_in_cells(cells: DataFrame, binned: DataFrame, like: Likeness) -> DataFrame:
    """The rows of cells that may link with a row of another component in their cell."""

    def hits(sizes: np.ndarray, packed: list[bytes], comp: np.ndarray, block: np.ndarray, apart: bool) -> np.ndarray:
        hit, width = np.zeros(len(sizes), bool), min(len(p) for p in packed) - 8
        tiles = [np.arange(at, min(at + _TILE, len(sizes))) for at in range(0, len(sizes), _TILE)]
        for t, a in enumerate(tiles):
            for b in tiles[t:]:
                other = comp[a][:, None] != comp[b][None, :]
                if a is b:
                    other = np.triu(other, 1)
                if apart:
                    other &= block[a][:, None] != block[b][None, :]
                # sizes alone rule out most of a mixed cell, then a few coarse bins, then all bins
                other &= like.over * np.minimum.outer(sizes[a], sizes[b]) >= like.under * np.maximum.outer(sizes[a], sizes[b])
                x, y = np.nonzero(other)
                if not len(x):
                    continue
                x, y = x + a[0], y + b[0]
                some, where = np.unique(np.concatenate([x, y]), return_inverse=True)
                bins = np.stack([_coarse(_bins(packed[r])[1], width) for r in some])
                x, y = where[: len(x)], where[len(x):]
                for layer in (bins.reshape(len(bins), 64, -1).sum(axis=2, dtype=np.int32), bins)[: 1 + (width > 64)]:
                    keep, step = np.zeros(len(x), bool), max(1, _COMPARED // layer.shape[1])
                    for at in range(0, len(x), step):
                        i, j = x[at: at + step], y[at: at + step]
                        least = np.abs(layer[i] - layer[j]).sum(axis=1)
                        n = sizes[some[i]] + sizes[some[j]]
                        keep[at: at + step] = (like.over - like.under) * n >= (like.over + like.under) * least
                    x, y = x[keep], y[keep]
                hit[some[x]], hit[some[y]] = True, True
        return hit

    def look(table: pa.Table, heads: np.ndarray):
        packed = table.column("packed").to_pylist()
        sizes = np.array([int.from_bytes(p[:8], "little") for p in packed])
        comp, block = table.column("component").to_numpy(), table.column("own").to_numpy()
        apart = (table.column("i").to_numpy() != table.column("j").to_numpy()).tolist()
        hit = np.zeros(table.num_rows, bool)
        for a, z in zip(heads.tolist(), [*heads.tolist()[1:], table.num_rows]):
            if z - a > 1:
                hit[a:z] = hits(sizes[a:z], packed[a:z], comp[a:z], block[a:z], apart[a])
        yield from table.drop_columns(["packed"]).filter(pa.array(hit)).to_batches()

    columns = ["bucket", "id", "component", "own", "i", "j"]
    kinds = "bucket long, id long, component long, own int, i int, j int"
    return _by_cell(cells.join(binned, "id").select(*columns, "packed"), look, kinds)


def _dealt_anew(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of cells once a bucket, gathered and dealt anew: few are left, and a whole set travels once for each block."""
    rows = put(cells.select("bucket", "id", "component").distinct(), "left")
    sizes = rows.groupBy("bucket").agg(F.min("id").alias("low"), F.count("*").alias("held"))
    return _cells(_gathered(rows.join(sizes, "bucket")), sets)


def _common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Numbers of common shingles of all sets of x with all of y, by matrix products over the shingles of several sets.

    Where y is x, a set's number with itself is not its size.
    """
    sets = x if y is x else [*x, *y]
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    several = held > 1
    kept = several[column]
    row, column = row[kept], (np.cumsum(several) - 1)[column[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(x), len(y)), np.int64)
    for at in range(0, int(several.sum()), _COLUMNS):
        a, z = np.searchsorted(column, [at, at + _COLUMNS])
        has = np.zeros((len(sets), _COLUMNS), np.float32)
        has[row[a:z], column[a:z] - at] = 1
        out += (has[: len(x)] @ (has if y is x else has[len(x):]).T).astype(np.int64)
    return out


def _links_in_cells(cells: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """Links between components, cell by cell; a pair already joined within its cell is passed over."""

    def links(ids: list, comp: np.ndarray, block: np.ndarray, whole: list, apart: bool) -> list[tuple]:
        out, sizes = [], np.array([len(w) for w in whole])
        comp = np.unique(comp, return_inverse=True)[1]
        tiles = [np.arange(at, min(at + _TILE, len(ids))) for at in range(0, len(ids), _TILE)]
        for t, a in enumerate(tiles):
            for b in tiles[t:]:
                other = comp[a][:, None] != comp[b][None, :]
                if apart:
                    other &= block[a][:, None] != block[b][None, :]
                other &= like.over * np.minimum.outer(sizes[a], sizes[b]) >= like.under * np.maximum.outer(sizes[a], sizes[b])
                if not other.any():
                    continue
                x, y = a[other.any(axis=1)], b[other.any(axis=0)]
                some = [whole[r] for r in x]
                common = _common(some, some if a is b else [whole[r] for r in y])
                alike = like.over * common >= like.under * (np.add.outer(sizes[x], sizes[y]) - common)
                alike &= other[np.ix_(x - a[0], y - b[0])]
                for r, linked in zip(x, alike):
                    linked &= comp[y] != comp[r]
                    while linked.any():
                        s = y[linked.argmax()]
                        out.append((ids[r], ids[s]))
                        comp[comp == comp[s]] = comp[r]
                        linked &= comp[y] != comp[r]
        return out

    def look(table: pa.Table, heads: np.ndarray):
        ids, i, j, packed = [table.column(c).to_pylist() for c in ("id", "i", "j", "packed")]
        comp, block = table.column("component").to_numpy(), table.column("own").to_numpy()
        whole, out = [np.frombuffer(p, _U) for p in packed], []
        for a, z in zip(heads.tolist(), [*heads.tolist()[1:], len(ids)]):
            if z - a > 1:
                out += links(ids[a:z], comp[a:z], block[a:z], whole[a:z], i[a] != j[a])
        u, v = zip(*out) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    columns = ["bucket", "id", "component", "own", "i", "j"]
    return _by_cell(cells.join(sets, "id").select(*columns, "packed"), look, "u long, v long")


def _firsts(docs: DataFrame, whole: DataFrame, several: DataFrame, copies: DataFrame, like: Likeness) -> DataFrame:
    """(id, text) without the texts whose set a smaller id has; a doc_id with different sets keeps those it is the first of."""
    sets = F.struct("k1", "k2", "n_shingles")
    varied = put(whole.groupBy("id").agg(F.min(sets).alias("x"), F.max(sets).alias("y")).where("x != y").select("id"), "varied")
    texts = _texts(docs)
    once = texts.join(narrow_side(put(copies.select("id").union(varied).distinct(), "not-once")), "id", "left_anti")
    if varied.isEmpty():
        return once
    some = put(texts.join(narrow_side(varied), "id", "left_semi").withColumn("row", F.monotonically_increasing_id()), "varied-texts")
    keys = put(set_keys(some.select(F.col("row").alias("doc_id"), "text"), like).withColumnRenamed("id", "row"), "varied-keys")
    later = keys.join(some.select("row", F.col("id")), "row").join(several, ["k1", "k2", "n_shingles"]).where("id != first")
    return once.union(some.join(narrow_side(put(later.select("row"), "varied-copies")), "row", "left_anti").select("id", "text"))


def similar_groups(docs: DataFrame, n: int = 5, under: int = 80, over: int = 100) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included).

    Two documents link when |A and B| / |A or B| >= under / over, for their sets of n-word shingles. A null, empty or blank
    text has an empty set and links with nothing. A null doc_id cannot be linked and gets a null component. Rows that share a
    doc_id are one node that has the links of all its texts. Other columns are not read.
    """
    like = Likeness(n, under, over)
    spark = docs.sparkSession
    small_batches(spark)
    keys = put(set_keys(docs, like), "set-keys")
    whole = keys.where("id IS NOT NULL AND n_shingles > 0")
    folded = whole.groupBy("k1", "k2", "n_shingles").agg(F.min("id").alias("first"), F.count("*").alias("rows"))
    several = put(folded.where("rows > 1").drop("rows"), "equal-sets")
    copies = put(
        whole.join(several, ["k1", "k2", "n_shingles"]).where("id != first").select("id", F.col("first")).distinct(), "copies"
    )
    held = whole.agg(F.sum("n_shingles")).first()[0] or 0
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(width, int(held * 0.6) // SIGNATURES_PER_TASK + 1)
    usable = docs.where("doc_id IS NOT NULL")
    firsts = _firsts(usable, whole, several, copies, like)
    packed = _packed(firsts, like, parts).repartition(parts, "part").sortWithinPartitions("part")
    buckets = put(_shared(packed).dropDuplicates(["bucket", "id"]), "buckets")
    pairs = put(buckets.where("id != low").select(F.col("low").alias("u"), F.col("id").alias("v")).distinct(), "pairs")
    binned = _sets_of(usable, buckets, like, _binned)
    near = put(_checked(pairs, binned, like, _may_link), "near")
    ends = near.select(F.col("u").alias("id")).union(near.select("v"))
    links = put(_checked(near, _sets_of(usable, ends, like, _whole), like, _set_link), "links")
    comps = put(components(links), "components")
    groups = _cells(_gathered(_open(buckets, comps)), binned)
    mixed = put(_candidates_in_cells(groups, put(_few_bins(binned), "few-bins"), like), "mixed")
    cells = put(_candidates_in_cells(mixed, binned, like), "cells")
    if not cells.isEmpty():
        sets = _sets_of(usable, cells, like, _whole)
        rest = put(_links_in_cells(put(_dealt_anew(cells, sets), "dealt"), sets, like), "rest")
        comps = put(components(links.union(rest)), "components")
    equal = copies.select(F.col("id").alias("u"), F.col("first").alias("v"))
    return _reported(keys, comps, equal)


def _reported(keys: DataFrame, comps: DataFrame, equal: DataFrame) -> DataFrame:
    """Puts every row under its component: through the first row of equal sets where it is not that row itself."""
    twice = equal.groupBy("u").agg(F.min("v").alias("v"), F.count("*").alias("n"))
    comps = comps.select(F.col("id").alias("c_id"), "component")
    if not twice.where("n > 1").isEmpty() or not equal.join(equal.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").isEmpty() or not equal.join(comps, F.col("u") == F.col("c_id"), "left_semi").isEmpty():
        # a doc_id with several texts ties their classes together
        edges = equal.union(comps.select("c_id", "component"))
        comps = put(components(edges), "components").select(F.col("id").alias("c_id"), "component")
        twice = twice.where("false")
    via = keys.join(twice.select("u", F.col("v").alias("first")), F.col("id") == F.col("u"), "left")
    via = via.withColumn("node", F.coalesce("first", "id"))
    out = via.join(comps, F.col("node") == F.col("c_id"), "left")
    return out.select(
        F.col("id").alias("doc_id"), "n_shingles", F.least(F.coalesce("component", "node"), "id").alias("component_id"),
    )


def keep_one(docs: DataFrame, n: int = 5, under: int = 80, over: int = 100) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group, columns as they are; rows without a doc_id stay."""
    groups = similar_groups(docs, n, under, over)
    gone = put(groups.where("doc_id != component_id").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    side = narrow_side(gone)
    return docs.join(side, docs["doc_id"].cast("long") == side["__gone"], "left_anti")


@query("op3_jaccard_join")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(documents(spark, sf_dir), 4, 85, 100)
