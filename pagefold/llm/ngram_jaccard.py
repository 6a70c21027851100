"""N-gram Jaccard join by parity sketches (operator 5).

A text's distinct word shingles are dealt into the blocks of a sketch by their hashes; a block
holds the XOR of the hashes that fall into it.  A shingle that only one of two texts has alters
one block, so the number of blocks that differ (the sketches' Hamming distance, counted in
blocks) is never more than the symmetric difference.  Two sets of similarity t differ in at most
d = (1 - t) / t * (size of the smaller) shingles, hence with k > d blocks at least k - d blocks
agree: linked texts meet in a join on single blocks.  k depends on the size band of the smaller
set; a text whose smaller partners may lie in the band below also emits that band's blocks.
Blocks that are empty say nothing; k has room for the empty ones (bands where that room would
not close join on two or three blocks together instead), and a text with more of them emits them
too, so no link is lost.

Candidates are not all pairs of a block's texts.  First each text is held against one
representative of its block; the links found give components; then only texts of one block that
lie in different components are compared, in tiles of a few hundred by their bit sketches, and only
what these allow becomes a candidate.  Each candidate passes two exact tests: a parity bit
sketch (one bit a shingle, its Hamming distance is a lower bound as well) and the shingle sets.

Texts with equal sets are one class from the start and are never paired.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.llm.common import connected_components, frugal, slices, stage
from pagefold.llm.shingles import mix, shingle_sets

#: Ratio of the size bands.
BAND = 1.4
#: Keys that a task holds before it deals them out; texts of one block in such a run from which on
#: the task forwards a representative only.
RUN_KEYS, RUN_GROUP = 1 << 20, 8
#: Texts of one block that are held against each other at a time.
TILE = 256
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class Bands:
    """Blocks of each size band for a similarity of ``percent`` / 100 or more."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.known: dict[int, tuple] = {}

    def of(self, n: int) -> int:
        return int(math.floor(math.log(n) / math.log(BAND) + 1e-9))

    def lists(self, n: int) -> list[int]:
        """Bands in which a set of ``n`` shingles may be the smaller or the larger one."""
        own = self.of(n)
        low = self.of(max(1, math.ceil(self.percent * n / 100)))
        return list(range(low, own + 1))

    def most_apart(self, n: int) -> int:
        """Symmetric difference at most, when the smaller set has ``n`` shingles."""
        return (100 - self.percent) * n // self.percent

    def plan(self, band: int) -> tuple:
        """Blocks, empty blocks allowed for, blocks joined together, combinations of these."""
        if band not in self.known:
            d = self.most_apart(math.ceil(BAND ** (band + 1)) - 1)
            if d == 0:
                self.known[band] = (0, 0, 0, None)
            else:
                k, spare, c = d + 1, 0, 1
                while spare < d + 8:
                    empty = k * math.exp(-(BAND ** band) / k)
                    need = math.ceil(empty + 4 * math.sqrt(empty))
                    if need <= spare:
                        break
                    spare += 1
                    k = d + 1 + spare
                else:
                    c = 3 if d <= 2 else 2
                    k, spare = d + c, 0
                self.known[band] = (k, spare, c, np.array(list(combinations(range(k), c))) if c > 1 else None)
        return self.known[band]

    def keys(self, hashes: np.ndarray) -> list[np.ndarray]:
        """Join keys of a sorted set of hashes."""
        out = []
        if not len(hashes):
            return out
        for band in self.lists(len(hashes)):
            k, spare, c, combos = self.plan(band)
            if not k:
                continue
            block = (((hashes >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)).astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
            sketch = np.zeros(k, np.uint64)
            sketch[block[first]] = np.bitwise_xor.reduceat(hashes, first)
            salt = np.uint64(band * 7919 + 1)
            if c > 1:
                words = mix(sketch[combos] + np.arange(1, c + 1, dtype=np.uint64) * _GOLD)
                out.append(mix(words.sum(1, dtype=np.uint64) * _GOLD + np.arange(len(combos), dtype=np.uint64) + mix(np.full(1, salt))))
                continue
            at = block[first] if k - len(first) <= spare else np.arange(k)
            out.append(mix(sketch[at] + mix(at.astype(np.uint64) * _GOLD + salt)))
        return out


def bit_sketch(hashes: np.ndarray) -> np.ndarray:
    """Parity bits of the hashes, a power of two of them (256 to 32,768) by the set's size; folding
    the halves together gives the sketch of half the size."""
    bits = 1 << min(15, max(8, int(len(hashes)).bit_length() + 1))
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8))


def sketch_distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two bit sketches at the smaller one's size."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def set_number(hashes: np.ndarray) -> int:
    """64 bits that stand for a set."""
    if not len(hashes):
        return 0
    return int(mix(np.bitwise_xor.reduce(mix(hashes * _GOLD), keepdims=True) + hashes.sum(dtype=np.uint64) + np.uint64(len(hashes))).view(np.int64)[0])


def describe(docs: DataFrame, words: int) -> DataFrame:
    """``(doc_id, n_shingles, set, sketch)`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                sets = shingle_sets(part.column("text"), words)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_number(s) for s in sets], pa.int64()),
                     pa.array([bit_sketch(s).tobytes() for s in sets], pa.binary())], ["doc_id", "n_shingles", "set", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(frugal(run), "doc_id long, n_shingles long, set long, sketch binary")


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of a sorted array."""
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(key)))


def _sorted(key: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key, set) pairs by key; within a key by a hash of both, so that different keys of a
    group choose different representatives."""
    order = np.lexsort((mix(number.view(np.uint64) ^ key), key))
    key, number = key[order], number[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (number[1:] != number[:-1])
    return key[keep], number[keep]


_MEMBERS = ["bucket", "pack", "key", "set", "rep"]
_MEMBER_KINDS = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]


def _members(key: np.ndarray, number: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
    n = len(key)
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(key.view(np.int64)),
                                       pa.array(number), pa.array(rep)], _MEMBERS)


def block_members(docs: DataFrame, words: int, bands: Bands) -> DataFrame:
    """``(key, set, rep)``: the texts that share a block with others, and a representative of them.

    Keys travel as packed arrays, a row for each run of a task and target partition.  Where a run
    holds many texts of one block, it lists them itself and forwards one for all, so a block that a
    third of all texts share comes to its partition once a run.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        numbers: list[np.ndarray] = []
        held = 0

        def deal() -> Iterator[pa.RecordBatch]:
            key, number = _sorted(np.concatenate(keys), np.concatenate(numbers))
            first, size = _runs(key)
            many = size >= RUN_GROUP
            if many.any():
                rows = np.repeat(many, size)
                yield _members(key[rows], number[rows], np.repeat(number[first], size)[rows])
                forward = ~rows
                forward[first] = True
                key, number = key[forward], number[forward]
            target = (mix(key + _GOLD) % np.uint64(n)).astype(np.int64)
            order = np.argsort(target, kind="stable")
            key, number, target = key[order], number[order], target[order]
            first, size = _runs(target)
            yield pa.RecordBatch.from_arrays(
                [pa.array(target[first], pa.int32()),
                 pa.array([key[a:a + s].tobytes() + number[a:a + s].tobytes() for a, s in zip(first, size)], pa.binary()),
                 *(pa.nulls(len(first), k) for k in _MEMBER_KINDS[2:])], _MEMBERS)

        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                for s in shingle_sets(part.column("text"), words):
                    number = set_number(s)
                    for x in bands.keys(s):
                        keys.append(x)
                        numbers.append(np.full(len(x), number, np.int64))
                        held += len(x)
                if held >= RUN_KEYS:
                    yield from deal()
                    keys, numbers, held = [], [], 0
        if held:
            yield from deal()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, numbers = [], []
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("pack")[i].is_valid:
                    pack = np.frombuffer(batch.column("pack")[i].as_py(), np.uint64)
                    keys.append(pack[:len(pack) // 2])
                    numbers.append(pack[len(pack) // 2:].view(np.int64))
        if keys:
            key, number = _sorted(np.concatenate(keys), np.concatenate(numbers))
            first, size = _runs(key)
            rows = np.repeat(size > 1, size)
            out = _members(key[rows], number[rows], np.repeat(number[first], size)[rows])
            for a in range(0, out.num_rows, 100_000):
                yield out.slice(a, 100_000)

    schema = "bucket int, pack binary, key long, set long, rep long"
    dealt = docs.select("doc_id", "text").mapInArrow(frugal(emit), schema)
    spread = F.coalesce(F.col("bucket"), F.pmod(F.xxhash64("key", "set"), F.lit(n)).cast("int"))
    # one exchange: packed runs go to the partition of their keys, members that a run listed itself to any
    met = dealt.withColumn("bucket", spread).repartition(n, "bucket").mapInArrow(frugal(_pass_members(meet)), schema)
    return met.select("key", "set", "rep")


def _pass_members(meet):
    """``meet`` over the packed rows, with the rows listed before handed on as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = []
        for batch in batches:
            listed = batch.filter(pa.compute.is_null(batch.column("pack")))
            if listed.num_rows:
                yield listed
            packed.append(batch.filter(pa.compute.is_valid(batch.column("pack"))))
        yield from meet(iter(packed))

    return run


def link(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, bands: Bands) -> DataFrame:
    """The rows of ``pairs(a, b)`` (set numbers) whose similarity reaches the threshold, as ``(a, b)``."""
    percent = bands.percent
    side = lambda c: classes.select(F.col("set").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = zip(batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist(), batch.column("s_a"), batch.column("s_b"))
            # |A xor B| <= (100 - t) / (100 + t) * (|A| + |B|)
            keep = [(100 + percent) * sketch_distance(x.as_buffer(), y.as_buffer()) <= (100 - percent) * (p + q) for p, q, x, y in n]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sized = pairs.join(side("a"), "a").join(side("b"), "b").filter(
        F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    pairs = stage(sized.mapInArrow(frugal(near), "a long, b long"), "jaccard-pairs")
    needed = pairs.select(F.col("a").alias("set")).unionAll(pairs.select(F.col("b").alias("set"))).distinct()
    needed = stage(classes.join(needed, "set", "left_semi").select("doc_id"), "jaccard-needed")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                found = shingle_sets(part.column("text"), words)
                yield pa.RecordBatch.from_arrays([pa.array([set_number(s) for s in found], pa.int64()),
                                                  pa.array([s.tobytes() for s in found], pa.binary())], ["set", "hashes"])

    whole = stage(docs.select("doc_id", "text").join(needed, "doc_id", "left_semi").mapInArrow(frugal(sets), "set long, hashes binary")
                  .dropDuplicates(["set"]), "jaccard-sets")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("h_a"), batch.column("h_b")):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    full = pairs.join(whole.select(F.col("set").alias("a"), F.col("hashes").alias("h_a")), "a").join(
        whole.select(F.col("set").alias("b"), F.col("hashes").alias("h_b")), "b")
    return stage(full.mapInArrow(frugal(verify), "a long, b long"), "jaccard-links")


def between_components(placed: DataFrame, bands: Bands) -> DataFrame:
    """``(a, b)`` of ``placed(key, set, component, tiles, n_shingles, sketch)``: texts of one block and different
    components whose sizes and bit sketches allow a link.

    A block's texts are compared in tiles of TILE rows, a tile pair at a time in arrays; pairs that
    the sketches rule out are never rows."""
    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    percent = bands.percent
    tiled = placed.withColumn("tile", F.pmod(F.xxhash64("set"), F.col("tiles")).cast("int"))
    tiled = (tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other")))

    def compare(rows: list[dict]) -> tuple[list[int], list[int]]:
        size = np.array([r["n_shingles"] for r in rows])
        component = np.array([r["component"] for r in rows])
        width = min(len(r["sketch"]) for r in rows)
        sketch = np.zeros((len(rows), width), np.uint8)
        for k, r in enumerate(rows):
            x = np.frombuffer(r["sketch"], np.uint8)
            while len(x) > width:
                x = x[:len(x) // 2] ^ x[len(x) // 2:]
            sketch[k] = x
        side = np.array([r["tile"] == r["i"] for r in rows])
        out_a, out_b = [], []
        for k, r in enumerate(rows):
            if r["i"] != r["j"] and not side[k]:
                continue
            ok = (component != component[k]) & (100 * np.minimum(size, size[k]) >= percent * np.maximum(size, size[k]))
            ok &= ~side if r["i"] != r["j"] else np.arange(len(rows)) > k
            at = np.flatnonzero(ok)
            if len(at):
                apart = np.bitwise_count(sketch[at] ^ sketch[k]).sum(1, dtype=np.int64)
                for m in at[(100 + percent) * apart <= (100 - percent) * (size[at] + size[k])]:
                    out_a.append(min(r["set"], rows[m]["set"]))
                    out_b.append(max(r["set"], rows[m]["set"]))
        return out_a, out_b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, now = [], None
        for batch in batches:
            a, b = [], []
            for r in batch.to_pylist():
                if (r["key"], r["i"], r["j"]) != now:
                    if len(group) > 1:
                        x, y = compare(group)
                        a += x
                        b += y
                    group, now = [], (r["key"], r["i"], r["j"])
                group.append(r)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        if len(group) > 1:
            a, b = compare(group)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    order = ["key", "i", "j"]
    return (tiled.select("key", "i", "j", "tile", "set", "component", "n_shingles", "sketch")
            .repartition(n, *order).sortWithinPartitions(*order).mapInArrow(frugal(run), "a long, b long"))


def components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: the texts linked by a Jaccard similarity of ``percent`` / 100
    or more of their ``words``-word shingles, directly or through others.

    Null and empty texts, and texts of white space, have empty sets and link with nothing; a text
    of fewer words has its whole sequence as its one shingle; equal sets are linked whatever their
    number.  Ids are taken to be unique: a repeated id with equal text is one document told twice, and
    each row is returned.  A null id links with nothing and has a null component.  Other columns
    are ignored.
    """
    spark, bands = docs.sparkSession, Bands(percent)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    told = stage(describe(docs, words), "jaccard-told")
    classes = stage(told.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "jaccard-classes")
    members = stage(block_members(docs.filter("doc_id IS NOT NULL"), words, bands), "jaccard-members")

    star = stage(members.filter("set != rep").select(F.least("set", "rep").alias("a"), F.greatest("set", "rep").alias("b")).distinct(), "jaccard-star")
    links = link(star, classes, docs, words, bands)
    found = connected_components(spark, links, "jaccard-cc")
    # texts of one block in different components are held against each other
    placed = stage(members.select("key", "set").distinct().join(found.withColumnRenamed("id", "set"), "set", "left")
                   .withColumn("component", F.coalesce("component", "set")), "jaccard-placed")
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).filter("lo < hi")
    mixed = stage(mixed.select("key", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")), "jaccard-mixed")
    placed = placed.join(mixed, "key").join(classes.select("set", "n_shingles", "sketch"), "set")
    across = between_components(placed, bands).distinct().join(star, ["a", "b"], "left_anti")
    links = links.unionAll(link(stage(across, "jaccard-across"), classes, docs, words, bands))
    # numbers of sets give way to the smallest ids of their classes
    ids = classes.select("set", "doc_id")
    edges = links.join(ids.toDF("a", "x"), "a").join(ids.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    found = connected_components(spark, edges, "jaccard-cc")
    classes = ids.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("set", F.coalesce("component", "doc_id").alias("component_id"))
    return told.join(classes, "set", "left").select(
        "doc_id", "n_shingles",
        F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
