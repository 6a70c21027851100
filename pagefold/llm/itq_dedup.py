"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables (operator 8).

A rotation learnt on a bounded sample (PCA, then alternating sign codes and an orthogonal
Procrustes step) gives each vector a balanced binary code.  A code is cut into substrings, one
hash table each; every code is entered under its substring and all substrings one bit away, so
codes whose substrings differ in up to two bits meet.  Codes of up to RADIUS differing bits that
meet are candidates, and the original vectors decide by cosine in double precision.

Equal vectors are one row with a multiplicity from the start.  A pair that meets in several
tables is taken in its first common table only.  The tables are the same at every size, so whether
two vectors are linked does not depend on how many others there are: codes of up to 11 differing
bits always meet (four substrings of three or more differing bits would make 12).  A bucket of more
than MEET codes is compared in tiles that are dealt over the tasks.  Vectors of one bucket are held
against each other in tiles of TILE rows, and a tile pair gives sums and the edges of a spanning
forest: the pairs themselves are never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.llm.common import connected_components, stage
from pagefold.llm.shingles import mix

#: Vectors to learn the rotation on, at most; rounds; candidates' differing bits; rows of a tile.
SAMPLE, ROUNDS, RADIUS, TILE = 8_192, 40, 16, 256
#: Tables; codes of a bucket that one task compares with each other.
TABLES, MEET = 4, 16_384


def learn_rotation(x: np.ndarray, bits: int = 64, rounds: int = ROUNDS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimensions x bits) of iterative quantisation; more bits than dimensions
    take further rotations of the same projection."""
    mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
    centred = x - mean
    _, _, axes = np.linalg.svd(centred.T @ centred)
    rng = np.random.default_rng(seed)
    out = []
    while sum(p.shape[1] for p in out) < bits:
        pca = axes[:bits].T
        v = centred @ pca
        r, _ = np.linalg.qr(rng.normal(size=(pca.shape[1], pca.shape[1])))
        for _ in range(rounds if len(x) > 1 else 0):
            b = np.where(v @ r >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(v.T @ b)
            r = left @ right
        out.append(pca @ r)
    return mean, np.concatenate(out, 1)[:, :bits]


def encode(unit: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """64-bit codes of normalised vectors."""
    bits = ((unit - mean) @ projection >= 0).astype(np.uint8)
    return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)


class Tables:
    """``count`` tables over substrings of a 64-bit code."""

    def __init__(self, count: int) -> None:
        self.count, self.width = count, 64 // count

    def substring(self, codes: np.ndarray, t: int) -> np.ndarray:
        return codes >> np.uint64(t * self.width) & np.uint64((1 << self.width) - 1)

    def entries(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets (table and substring) of each code, and the code's row."""
        flips = np.concatenate(([0], 1 << np.arange(self.width))).astype(np.uint64)
        keys = [(self.substring(codes, t)[:, None] ^ flips | np.uint64(t << 40)).ravel() for t in range(self.count)]
        rows = np.repeat(np.arange(len(codes)), len(flips))
        return np.concatenate(keys), np.tile(rows, self.count)

    def here(self, bucket: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of codes (broadcast) are candidates to be taken in this bucket and in no other."""
        t, key = bucket >> 40, np.uint64(bucket & ((1 << 40) - 1))
        x = a ^ b
        ok = np.bitwise_count(x) <= RADIUS
        for before in range(t):
            ok &= np.bitwise_count(self.substring(x, before)) > 2
        d = self.substring(x, t)
        near = np.bitwise_count(d)
        p, q = self.substring(a, t), self.substring(b, t)
        low = d & (~d + np.uint64(1))
        middle = np.where(near == 0, p, np.where(near == 1, np.minimum(p, q), np.minimum(p ^ low, q ^ low)))
        return ok & (near <= 2) & (middle == key)

    def pairs(self, bucket: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``a`` and ``b`` whose pair is taken here; few pairs are near enough for the full test."""
        r, c = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= RADIUS)
        ok = self.here(bucket, a[r], b[c])
        return r[ok], c[ok]


def unit_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, mult, vector)``: distinct usable vectors under their smallest id, normalised (doubles as bytes)."""
    usable = rows_with_vectors(rows, id_col, vector_col).filter("vector IS NOT NULL")
    return usable.groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("mult")).select("id", "mult", "vector")


def _matrix(column) -> np.ndarray:
    rows = [np.frombuffer(x.as_buffer(), "<f8") for x in column]
    return np.stack(rows) if rows else np.zeros((0, 1))


def with_codes(vectors: DataFrame, mean: np.ndarray, projection: np.ndarray) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast((mean, projection))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = encode(_matrix(batch.column("vector")), *shared.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes.view(np.int64))], [*batch.schema.names, "code"])

    return vectors.mapInArrow(run, "id long, mult long, vector binary, code long")


def bucket_tiles(codes: DataFrame, tables: Tables) -> dict[int, int]:
    """Tiles of the buckets that hold more than MEET codes.

    Counted by substring (``count * 2 ** width`` at most, whatever the input); a bucket holds the codes
    of its substring and of those one bit away."""
    if codes.count() <= MEET:
        return {}
    low = (1 << tables.width) - 1
    each = F.explode(F.array(*(F.shiftrightunsigned("code", t * tables.width).bitwiseAND(F.lit(low)).bitwiseOR(F.lit(t << 40)) for t in range(tables.count))))
    told = codes.select(each.alias("bucket")).groupBy("bucket").count().toArrow()
    bucket, n = told["bucket"].to_numpy(), told["count"].to_numpy()
    sizes = np.zeros((tables.count, low + 1), np.int64)
    sizes[bucket >> 40, bucket & low] = n
    around = sizes + sum(sizes[:, np.arange(low + 1) ^ (1 << i)] for i in range(tables.width))
    return {int(t) << 40 | int(k): -(-int(around[t, k]) // MEET) for t, k in zip(*np.nonzero(around > MEET))}


def shared_buckets(codes: DataFrame, tables: Tables) -> DataFrame:
    """``(bucket, code)`` of the codes that have a candidate to be taken in that bucket.

    Codes travel as packed arrays; a bucket's codes are compared in blocks.  The codes of a large
    bucket are dealt over tiles by their hash, and each pair of tiles meets by itself."""
    n = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = bucket_tiles(codes, tables)
    shared = codes.sparkSession.sparkContext.broadcast((np.array(sorted(large), np.uint64), np.array([large[k] for k in sorted(large)], np.uint64)))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, tiles = shared.value
        for batch in batches:
            code = batch.column("code").to_numpy().view(np.uint64)
            several = batch.column("several").to_numpy(zero_copy_only=False).astype(np.uint64)
            bucket, row = tables.entries(code)
            # the tile pair (31 bits each), the side of it, and ``several``
            cell = several[row]
            if len(split):
                slot = np.minimum(np.searchsorted(split, bucket), len(split) - 1)
                parts = np.where(split[slot] == bucket, tiles[slot], np.uint64(1))
                again = np.repeat(np.arange(len(bucket)), parts.astype(np.int64))
                other = (np.arange(len(again)) - np.repeat(np.cumsum(parts) - parts, parts.astype(np.int64)).astype(np.int64)).astype(np.uint64)
                bucket, row, cell, parts = bucket[again], row[again], cell[again], parts[again]
                own = mix(code[row]) % parts
                cell |= np.minimum(own, other) << np.uint64(33) | np.maximum(own, other) << np.uint64(2) | (own > other).astype(np.uint64) << np.uint64(1)
            target = (mix(bucket ^ mix(cell >> np.uint64(2))) % np.uint64(n)).astype(np.int64)
            order = np.argsort(target, kind="stable")
            first = np.searchsorted(target[order], np.arange(n + 1))
            packs = [(t, b"".join(x[order[first[t]:first[t + 1]]].tobytes() for x in (bucket, code[row], cell)))
                     for t in range(n) if first[t] < first[t + 1]]
            if packs:
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in packs], pa.int32()), pa.array([b for _, b in packs], pa.binary())],
                                                 ["target", "pack"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(x, np.uint64).reshape(3, -1) for b in batches for x in b.column("pack").to_pylist()]
        if not parts:
            return
        bucket, code, cell = np.concatenate(parts, 1)
        order = np.lexsort((code, cell >> np.uint64(1), bucket))
        bucket, code, cell = bucket[order], code[order], cell[order]
        several, side, pair = (cell & np.uint64(1)).astype(bool), (cell & np.uint64(2)).astype(bool), cell >> np.uint64(2)
        first = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (pair[1:] != pair[:-1]))))
        out_b, out_c = [], []
        for a, b in zip(first, [*first[1:], len(bucket)]):
            if b - a == 1 and not several[a]:
                continue
            k, own, whole = int(bucket[a]), code[a:b], int(pair[a]) >> 31 == int(pair[a]) & ((1 << 31) - 1)
            hit = tables.here(k, own, own) & several[a:b] if whole else np.zeros(b - a, bool)
            # the second side comes behind the first
            cut = b - a if whole else int(np.argmax(side[a:b])) if side[a:b].any() else b - a
            for i in range(0, cut, 1024):
                p = np.arange(i, min(i + 1024, cut))
                for j in range(i if whole else cut, b - a, 1024):
                    q = np.arange(j, min(j + 1024, b - a))
                    r, c = tables.pairs(k, own[p], own[q])
                    r, c = p[r], q[c]
                    apart = r != c
                    hit[r[apart]] = True
                    hit[c[apart]] = True
            if hit.any():
                out_b.append(np.full(int(hit.sum()), k, np.int64))
                out_c.append(own[hit].view(np.int64))
        if out_b:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_b)), pa.array(np.concatenate(out_c))], ["bucket", "code"])

    found = codes.mapInArrow(emit, "target int, pack binary").repartition(n, "target").mapInArrow(meet, "bucket long, code long")
    # a code of a large bucket meets others in several pairs of tiles
    return found.distinct() if large else found


def rerank(members: DataFrame, tables: Tables, least: float) -> DataFrame:
    """``(a, b, n)`` of ``members(bucket, id, mult, vector, code)``: with b null, n vectors more that a is
    linked with; else an edge of a spanning forest of the links."""
    sizes = stage(members.groupBy("bucket").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")), "itq-tiles")
    tiled = members.join(sizes, "bucket").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    tiled = (tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .select("bucket", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "id", "mult", "vector", "code"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        bucket, i, j = (table[c][0].as_py() for c in ("bucket", "i", "j"))
        tile, ids, mult = (table[c].to_numpy() for c in ("tile", "id", "mult"))
        code, x = table["code"].to_numpy().view(np.uint64), _matrix(table["vector"].chunk(0))
        p, q = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        links = (x[p] @ x[q].T >= least) & tables.here(bucket, code[p][:, None], code[q][None, :])
        if i == j:
            np.fill_diagonal(links, False)
        a, n = ids[p], links @ mult[q]
        if i != j:
            a, n = np.append(a, ids[q]), np.append(n, links.T @ mult[p])
        # spanning forest: the first link of each vertex to another tree
        root = {}

        def top(v):
            while root.get(v, v) != v:
                v = root[v]
            return v

        edges = []
        for r, c in zip(*np.nonzero(links)):
            u, v = top(int(p[r])), top(int(q[c]))
            if u != v:
                root[max(u, v)] = min(u, v)
                edges.append((int(ids[p[r]]), int(ids[q[c]])))
        keep = n > 0
        out = [(int(y), None, int(z)) for y, z in zip(a[keep], n[keep])] + [(u, v, 0) for u, v in edges]
        cols = list(zip(*out)) or [(), (), ()]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip("abn", cols)})

    return tiled.groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long, n long")


def _linked(same: DataFrame, length: int, count: int, least: float, index: Tables) -> DataFrame:
    """``(vector, n_links, component_id)`` of the ``count`` distinct vectors of one length."""
    part = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    sample = same.filter(part < int((1 << 30) * min(1, SAMPLE / count))).select("id", "vector").toArrow().sort_by("id").combine_chunks()
    mean, projection = learn_rotation(_matrix(sample["vector"].chunk(0)) if len(sample) else np.zeros((1, length)))
    coded = stage(with_codes(same, mean, projection), "itq-codes")
    codes = coded.groupBy("code").agg((F.count("*") > 1).alias("several"))
    members = stage(shared_buckets(codes, index), "itq-buckets").join(coded, "code")
    found = stage(rerank(members, index, least), "itq-links")
    cc = connected_components(same.sparkSession, found.filter("b IS NOT NULL").select("a", "b"), "itq-cc")
    links = found.filter("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    return (same.join(links, "id", "left").join(cc, "id", "left")
            .select("vector", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")))


def near_duplicates(rows: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", tables: int | None = None) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row: the links of cosine ``least`` or more found,
    and the smallest id reachable by links.

    Null and zero vectors, and vectors that hold null or non-finite components, link with nothing;
    vectors of different lengths don't link with each other; equal vectors (after normalising) are linked with each other;
    a repeated id counts as one vector more; a null id has no links and a null component.  Other
    columns are ignored.
    """
    rows = rows.select(F.col(id_col).cast("long").alias(id_col), vector_col)
    vectors = stage(unit_vectors(rows, id_col, vector_col), "itq-vectors")
    # vectors of different lengths have no cosine: each length is searched by itself (few lengths: one per model)
    several = vectors.groupBy(F.length("vector").alias("n")).agg(F.count("*").alias("vectors")).filter("vectors > 1").orderBy("n")
    known = [_linked(vectors.filter(F.length("vector") == r.n), r.n // 8, r.vectors, least, Tables(tables or TABLES)) for r in several.collect()]
    alone = vectors.join(several.select("n"), F.length("vector") == F.col("n"), "left_anti")
    known = reduce(DataFrame.unionAll, known, alone.select("vector", (F.col("mult") - 1).alias("n_links"), F.col("id").alias("component_id")))
    # back to the rows: by their normalised vectors
    told = rows_with_vectors(rows, id_col, vector_col).join(known, "vector", "left")
    return told.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                       F.coalesce("component_id", "id").alias("component_id"),
                       F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(False)).alias("kept"))


def rows_with_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, vector)`` of every row; the vector is null where it can't be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, v in zip(batch.column(id_col).to_pylist(), batch.column(vector_col)):
                x = None
                if i is not None and v.is_valid and not v.values.null_count and len(v.values):
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    top = np.abs(x).max()
                    x = x / top if np.isfinite(x).all() and top > 0 else None
                out.append(None if x is None else (x / np.sqrt((x * x).sum())).astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(out, pa.binary())], ["id", "vector"])

    return rows.select(id_col, vector_col).mapInArrow(run, "id long, vector binary")
