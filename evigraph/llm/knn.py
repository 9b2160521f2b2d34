"""Most similar vectors for every vector: inverted files of pivots.

Each vector is posted to the inverted files of its ``posts`` nearest pivots. All vectors of a file
are compared by exact cosine, and the results of a vector's files are merged.

Scale. Pivots are the directions of groups in a bounded sample (``SAMPLE`` vectors, or four for
each pivot), broadcast once; their number grows with the square root of the rows (four times it up to
``FLAT`` pivots, twice it beyond, since more pivots cost recall), so that a file does too. Every vector meets every pivot: looking only at groups of pivots with near centres lost a
tenth of the neighbours. Above ``FLAT`` pivots those beside each other share the packs of a
bundle, so that packs stay long and a vector of several of its files travels once. A file longer than
``block`` is cut into blocks, and every block meets every block, so that a task's memory is bounded
and no pair of a file is left out. Vectors travel as byte-shuffled,
compressed packs. Equal vectors are not posted without bound: a task posts the ``k``+1 smallest
ids of each distinct vector, which suffices for everyone's neighbours among equals; the other
members get theirs from a small side table of ids.

Only vectors of ``dim`` finite numbers that are not all zero count. A repeated row counts once.
Ties in cosine go to the smaller id. An empty table gives no rows.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigraph.sources import hash_sample

#: SPOOL: bytes of a long file that a task keeps in memory; the rest waits in a local file.
POSTS, BLOCK, MAX_PIVOTS, SAMPLE, SPOOL = 3, 8192, 65536, 8192, 1 << 27
#: FLAT: above so many pivots, they are sought group by group and bundled. LANES: columns of which only the maximum counts for a bound.
FLAT, LANES = 4096, 32


def usable(df: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """(id, v) of the rows that count."""
    v = F.col(vector_col)
    ok = (F.size(v) == dim) & F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(id_col).alias("id"), v.alias("v")).filter(F.col(id_col).isNotNull() & F.coalesce(ok, F.lit(False)))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
    return (x / n[:, None]).astype(np.float32)


def _prefixes(unit: np.ndarray, pivots: np.ndarray, width: int) -> np.ndarray:
    """Nearest pivots of each vector, nearest first."""
    out = np.empty((len(unit), width), np.int32)
    step = max(256, (1 << 23) // len(pivots))
    for i in range(0, len(unit), step):
        s = unit[i : i + step] @ pivots.T
        at = np.arange(len(s))
        for j in range(width):
            out[at + i, j] = best = s.argmax(1)
            s[at, best] = -3
    return out


def _bundles(prefix: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bundle, files) postings by bundle, each row once a bundle of ``wide`` files; files: places in the bundle, -1 for others."""
    bundle = prefix // wide
    new = np.ones(prefix.shape, bool)
    for j in range(1, prefix.shape[1]):
        new[:, j] = (bundle[:, :j] != bundle[:, j : j + 1]).all(1)
    row, j = np.nonzero(new)
    b = bundle[row, j]
    order = np.argsort(b, kind="stable")
    row, b = row[order], b[order]
    return row, b.astype(np.int64), np.where(bundle[row] == b[:, None], prefix[row] % wide, -1)


def _codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(table, codes) if at most 256 different numbers occur whose low 16 bits are zero; lossless."""
    bits = np.ascontiguousarray(x, "<f4").view(np.uint32)
    if (bits & 0xFFFF).any():
        return None
    high = (bits >> 16).astype(np.uint16)
    table = np.flatnonzero(np.bincount(high.ravel(), minlength=65536))
    if len(table) > 256:
        return None
    code = np.zeros(65536, np.uint8)
    code[table] = np.arange(len(table))
    return table.astype("<u2"), code[high]


def _pack(ids: np.ndarray, prefix: np.ndarray, x: np.ndarray, coded: tuple | None, squeeze: zstandard.ZstdCompressor) -> bytes:
    head = ids.astype("<i8").tobytes() + prefix.astype("<i2").tobytes()
    if coded:
        body = coded[1].tobytes()
    else:
        body = np.ascontiguousarray(x.astype("<f4").view(np.uint8).reshape(len(x), -1, 4).transpose(2, 0, 1)).tobytes()
    table = coded[0].tobytes() if coded else b""
    return squeeze.compress(len(ids).to_bytes(4, "little") + len(table).to_bytes(4, "little") + table + head + body)


def _unpack(data: bytes, width: int, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, t = int.from_bytes(raw[:4], "little"), int.from_bytes(raw[4:8], "little")
    at = 8 + t
    ids = np.frombuffer(raw, "<i8", n, at)
    prefix = np.frombuffer(raw, "<i2", n * width, at + 8 * n).reshape(n, width)
    at += (8 + 2 * width) * n
    if t:
        table = (np.frombuffer(raw, "<u2", t // 2, 8).astype(np.uint32) << 16).view(np.float32)
        return ids, prefix, table[np.frombuffer(raw, np.uint8, n * dim, at)].reshape(n, dim)
    body = np.frombuffer(raw, np.uint8, 4 * n * dim, at).reshape(4, n, dim)
    return ids, prefix, np.ascontiguousarray(body.transpose(1, 2, 0)).view("<f4").reshape(n, dim)


def _spread(sample: np.ndarray, p: int, rounds: int = 6) -> np.ndarray:
    """Pivots: directions of p groups of the sample (spherical k-means from its first vectors)."""
    c = sample[:p].copy()
    if p == len(sample):
        return c
    for _ in range(rounds):
        near = np.concatenate([(sample[i : i + 1024] @ c.T).argmax(1) for i in range(0, len(sample), 1024)])
        total = np.zeros(c.shape, np.float64)
        order = np.argsort(near, kind="stable")
        start = np.r_[0, np.flatnonzero(np.diff(near[order])) + 1]
        total[near[order][start]] = np.add.reduceat(sample[order].astype(np.float64), start)
        norm = np.sqrt((total**2).sum(1))
        c = np.where((norm > 1e-9)[:, None], total / np.maximum(norm, 1e-9)[:, None], c).astype(np.float32)
    return c


def _grow(sample: np.ndarray, p: int) -> np.ndarray:
    """About p pivots, near ones beside each other: the sample in groups, each cut into its part of them."""
    centres = _spread(sample[:SAMPLE], min(round(math.sqrt(p)), len(sample)))
    near = np.concatenate([(sample[i : i + 1024] @ centres.T).argmax(1) for i in range(0, len(sample), 1024)])
    groups = [np.flatnonzero(near == g) for g in range(len(centres))]
    return np.concatenate([_spread(sample[g], min(len(g), max(1, round(p * len(g) / len(sample))))) for g in groups if len(g)])


def _mixers(dim: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1, 2**63, (2, dim), dtype=np.uint64) | np.uint64(1)


def _first_of_equals(ids: np.ndarray, x: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows to keep (each id once, the ``keep`` smallest ids of each distinct vector) and each row's distinct vector."""
    _, first = np.unique(ids, return_index=True)  # ids ascending
    # equal rows have equal 128-bit sums; x + 0.0 makes -0.0 and 0.0 one
    bits = np.ascontiguousarray(x[first] + np.float32(0)).view(np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        mark = np.stack([bits @ m for m in _mixers(x.shape[1])], 1)
    kind = np.unique(mark.view([("a", np.uint64), ("b", np.uint64)]).ravel(), return_inverse=True)[1].ravel()
    order = np.argsort(kind, kind="stable")
    start = np.r_[0, np.flatnonzero(np.diff(kind[order])) + 1]
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
    chosen = np.sort(order[rank < keep])
    return first[chosen], kind[chosen]


def _closest(unit: np.ndarray, distinct: np.ndarray, inverse: np.ndarray, k: int, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other row, cosine) of the k closest among ``distinct[inverse]``, ties at the k-th kept; ``own``: these are the rows themselves."""
    n = len(inverse)
    _, some = np.unique(inverse, return_index=True)
    again = np.delete(np.arange(n), some)
    columns = np.r_[some, again]  # the first of each distinct row, then its repetitions
    place = np.argsort(columns)
    w = n // LANES
    rs, xs, cs = [], [], []
    for i in range(0, len(unit), 512):
        cos = unit[i : i + 512] @ distinct.T
        if len(again):
            cos = np.concatenate([cos, cos[:, inverse[again]]], axis=1)
        at = np.arange(len(cos))
        if own:
            cos[at, place[at + i]] = -3
        if n <= k:
            bound = np.full(len(at), -2.0, np.float32)
        elif w < 4 * k:
            bound = np.partition(cos, n - k, axis=1)[:, n - k]
        else:  # k columns have maxima of lanes not under the k-th of these
            most = cos[:, :w].copy()
            for j in range(1, LANES):
                np.maximum(most, cos[:, j * w : j * w + w], out=most)
            bound = np.partition(most, w - k, axis=1)[:, w - k]
        r, c = np.divmod(np.flatnonzero(cos >= bound[:, None]), n)
        v = cos[r, c]
        if n > k:
            count = np.bincount(r, minlength=len(at))
            table = np.full((len(at), count.max()), -3, np.float32)
            table[r, np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)] = v
            kth = np.partition(table, table.shape[1] - k, axis=1)[:, table.shape[1] - k]
            real = (v >= kth[r]) & (v > -1.5)
        else:
            real = v > -1.5
        rs.append(r[real] + i)
        xs.append(columns[c[real]])
        cs.append(v[real])
    return np.concatenate(rs), np.concatenate(xs), np.concatenate(cs)


def _distinct(unit: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, the distinct row of each row): equal vectors get equal cosines."""
    names, some, inverse = np.unique(kind, return_index=True, return_inverse=True)
    return (unit, np.arange(len(unit))) if len(names) == len(kind) else (unit[some], inverse)


def _search(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, other, cosine) of a file of one block; ties at the k-th kept."""
    rows, kind = _first_of_equals(ids, x, k + 1)
    ids, unit = ids[rows], _unit(x[rows])
    r, c, cos = _closest(unit, *_distinct(unit, kind), k, True)
    return ids[r], ids[c], cos


def _best(r: np.ndarray, other: np.ndarray, cos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k closest of each row, each other id once, ties to the smaller id."""
    order = np.lexsort((-cos, other, r))
    r, other, cos = r[order], other[order], cos[order]
    once = np.r_[True, (np.diff(r) != 0) | (np.diff(other) != 0)][: len(r)]
    r, other, cos = r[once], other[once], cos[once]
    order = np.lexsort((other, -cos, r))
    r, other, cos = r[order], other[order], cos[order]
    start = np.r_[0, np.flatnonzero(np.diff(r)) + 1][: len(r)]
    keep = np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)])) < k
    return r[keep], other[keep], cos[keep]


class _Long:
    """A file of many blocks, in memory up to ``spool`` bytes, every block of which meets every block."""

    def __init__(self, k: int, dim: int, spool: int):
        self.k, self.dim, self.store, self.sizes = k, dim, tempfile.SpooledTemporaryFile(spool), []

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        rows, kind = _first_of_equals(ids, x, self.k + 1)
        self.store.write(ids[rows].astype("<i8").tobytes() + kind.astype("<i8").tobytes() + _unit(x[rows]).astype("<f4").tobytes())
        self.sizes.append(len(rows))

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = self.sizes[i]
        self.store.seek(sum(self.sizes[:i]) * (16 + 4 * self.dim))
        raw = self.store.read(n * (16 + 4 * self.dim))
        return np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<i8", n, 8 * n), np.frombuffer(raw, "<f4", n * self.dim, 16 * n).reshape(n, self.dim)

    def search(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for i in range(len(self.sizes)):
            ids, _, unit = self.block(i)
            best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
            for j in range(len(self.sizes)):
                other, kind, vectors = self.block(j)
                # a repeated row can stand in another block, so that one place goes to the vector itself
                r, c, cos = _closest(unit, *_distinct(vectors, kind), self.k + (i != j), i == j)
                c = other[c]
                real = ids[r] != c
                best = _best(*(np.concatenate(p) for p in zip(best, (r[real], c[real], cos[real]))), self.k)
            yield ids[best[0]], best[1], best[2]
        self.store.close()


def neighbours(df: DataFrame, id_col: str, vector_col: str, k: int = 5, dim: int = 384, posts: int = POSTS, max_pivots: int = MAX_PIVOTS, block: int = BLOCK) -> DataFrame:
    """(id, neighbours array<struct<neg_cos, other>>) with the k nearest others of each indexed vector, nearest first."""
    base = usable(df, id_col, vector_col, dim)
    spark = df.sparkSession
    schema = "q long, x long, cos float"
    n = df.select(id_col).count()
    root = math.sqrt(n)
    wanted = min(max_pivots, max(32, min(int(4 * root), FLAT), int(2 * root)))
    size = SAMPLE if wanted <= FLAT else 4 * wanted

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for b in batches:
            ids, x = b.column(0).to_numpy(zero_copy_only=False), _matrix(b.column(1), dim)
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array([_pack(ids, np.zeros((len(ids), 0)), x, _codes(x), squeeze)], pa.binary())], names=["pack"])

    def gathered(some: DataFrame) -> list:
        return [_unpack(bytes(r[0]), 0, dim) for r in some.mapInArrow(packed, "pack binary").collect()]

    drawn = gathered(usable(hash_sample(df.select(id_col, vector_col), id_col, size), id_col, vector_col, dim))
    drawn = drawn or gathered(base.limit(SAMPLE))  # hardly a usable row: any will do
    if not drawn:
        return spark.createDataFrame([], "id long, neighbours array<struct<neg_cos:float,other:long>>")
    _, first = np.unique(np.concatenate([d[0] for d in drawn]), return_index=True)
    sample = np.concatenate([d[2] for d in drawn])[first]
    sample = _unit(sample[np.random.default_rng(5).permutation(len(sample))[:size]])
    # distinct pivots only: equal ones would fill a prefix with one direction
    _, keep = np.unique(np.ascontiguousarray(sample).view(np.dtype((np.void, dim * 4))).ravel(), return_index=True)
    sample = sample[np.sort(keep)]
    wanted = min(wanted, len(sample))
    pivots = _spread(sample, wanted) if wanted <= FLAT else _grow(sample, wanted)
    wide = 1 if wanted <= FLAT else -(-2 * len(pivots) // FLAT)
    posts = min(posts, len(pivots))
    width = posts if wide > 1 else 0  # one file a bundle: nothing to tell
    shared = spark.sparkContext.broadcast(pivots)
    del drawn, sample

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piv = shared.value
        squeeze = zstandard.ZstdCompressor(level=3)

        def flush(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            rows, _ = _first_of_equals(ids, x, k + 1)
            ids, x = ids[rows], x[rows]
            prefix = _prefixes(_unit(x), piv, posts)
            coded = _codes(x)
            r, f, places = _bundles(prefix, wide)
            places = places[:, :width]
            cuts = np.r_[0, np.flatnonzero(np.diff(f)) + 1, len(f)]
            return pa.RecordBatch.from_arrays(
                [pa.array(f[cuts[:-1]]), pa.array([_pack(ids[r[a:b]], places[a:b], x[r[a:b]] if coded is None else x[:0], coded and (coded[0], coded[1][r[a:b]]), squeeze) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())],
                names=["file", "pack"],
            )

        held, size = [], 0
        for b in batches:
            held.append((b.column(0).to_numpy(zero_copy_only=False), _matrix(b.column(1), dim)))
            size += b.num_rows
            if size >= 40_000:
                yield flush(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
                held, size = [], 0
        if size:
            yield flush(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def files(held: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            ids, places, x = (np.concatenate([h[i] for h in held]) for i in range(3))
            for f in range(wide):
                at = (places == f).any(1) if width else slice(None)
                if len(ids[at]):
                    yield f, ids[at], x[at]

        def put(held: list, long: dict[int, _Long]) -> None:
            for f, ids, x in files(held):
                if f not in long:
                    long[f] = _Long(k, dim, SPOOL // wide)
                long[f].add(ids, x)

        def out(held: list, long: dict[int, _Long]) -> Iterator[pa.RecordBatch]:
            if long:
                put(held, long)
            for found in (f.search() for f in long.values()) if long else ([_search(ids, x, k)] for _, ids, x in files(held)):
                for q, o, c in found:
                    if len(q):
                        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(o), pa.array(c, pa.float32())], names=["q", "x", "cos"])

        held, size, bundle, long = [], 0, None, {}
        for b in batches:
            for f, p in zip(b.column(0).to_pylist(), b.column(1)):
                if held and f != bundle:
                    yield from out(held, long)
                    held, size, long = [], 0, {}
                elif size >= block * min(wide, 4):
                    put(held, long)
                    held, size = [], 0
                bundle = f
                held.append(_unpack(p.as_py(), width, dim))
                size += len(held[-1][0])
        if held:
            yield from out(held, long)

    packs = base.mapInArrow(post, "file long, pack binary").repartition("file").sortWithinPartitions("file")
    found = packs.mapInArrow(search, schema)
    best = found.repartition("q").groupBy("q", "x").agg((-F.max("cos")).alias("neg_cos"))
    return best.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("neg_cos", F.col("x").alias("other")))), 1, k).alias("neighbours")).withColumnRenamed("q", "id")


def neighbour_pairs(df: DataFrame, id_col: str, vector_col: str, k: int = 5, dim: int = 384, **options: int) -> DataFrame:
    """(a, b), a < b: pairs of which one is among the k nearest of the other."""
    near = neighbours(df, id_col, vector_col, k, dim, **options).select("id", F.explode("neighbours.other").alias("other"))
    # members of large groups of equal vectors beyond the first k+1 ids: their neighbours are the group's first k
    marked = usable(df, id_col, vector_col, dim).select("id", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2")).distinct()
    big = marked.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > k + 1).select("h1", "h2")
    members = marked.join(big, ["h1", "h2"], "left_semi")
    from pyspark.sql import Window

    first = members.withColumn("_r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).filter(F.col("_r") <= k)
    heads = first.groupBy("h1", "h2").agg(F.collect_list("id").alias("heads"), F.max("id").alias("last"))
    rest = members.join(heads, ["h1", "h2"]).filter(F.col("id") > F.col("last")).select("id", F.explode("heads").alias("other"))
    pairs = near.unionByName(rest)
    return pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).filter("a < b").distinct()


VECTOR = T.ArrayType(T.FloatType())
