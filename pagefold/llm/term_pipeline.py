"""Ranked lexical search by pipelined term partitioning (operator 13).

Terms belong to owners by how common they are, the rarest first.  Items travel in bundles: a
bundle carries, for each block of documents, the sparse accumulators of its items through one
owner after the other.  An owner is a stage: the accumulators are cogrouped with the postings that
the owner holds of that block, and integer contributions are added.  The last owner selects.

Between two owners an accumulator is dropped only when nothing it can still gain reaches the k-th
best partial score that some k documents of the item already have.  Scores only grow, so no row
of the result is lost; bounds are counted over all blocks by buckets of scores (map-side combine).

A block holds so many documents and postings at most, a bundle so many items, so every cogroup
is bounded whatever the term; a term in all documents is spread over all blocks.

Rows: a null, empty or termless text is no document (it counts in no statistic); a null, empty or
termless item, and one whose terms occur nowhere or in nearly all documents (weight 0), has no
rows; rows that repeat an id are documents, or items, of their own, ranked each; ids of any type
that Spark can order (null ids first among ties); a text of any length is cut as bytes; empty
tables give an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagefold.llm.common import frugal, stage

#: Items of a bundle, documents of a block (both below 65,536), postings of a block, at most.
BUNDLE_ITEMS, BLOCK_DOCS, BLOCK_POSTINGS = 256, 8_192, 1 << 19
#: A term that at most one document in so many holds goes to the first such owner; the rest to the last.
OWNERS = (256, 32, 8)
#: Bits of the filter that keeps terms of no item out of the index (its size never grows: 512 KB).
FILTER_BITS = 1 << 22
#: No term contributes more than its weight times this (fixed value of the score).
MOST = 1_000_000
#: Lower edges of the buckets in which partial scores are counted, 16 an octave.
EDGES = np.unique(np.floor(2.0 ** (np.arange(63 * 16) / 16)).astype(np.int64))
#: Bytes that separate terms become spaces, A-Z become a-z, all others stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

STATE = ("bundle long, block long, keys binary, scores binary, "
         "tops array<struct<slot:int,edge:long,n:long>>")


def terms_of(raw: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, with repeats."""
    return raw.translate(FOLD).split() if raw else []


class Wanted(dict):
    """Term -> whether some item may hold it (by the filter); bounded."""

    def __init__(self, bits: bytes) -> None:
        super().__init__()
        self.bits = bits

    def __missing__(self, term: bytes) -> bool:
        if len(self) >= 400_000:
            self.clear()
        at = zlib.crc32(term) % FILTER_BITS
        known = self[term] = bool(self.bits[at >> 3] & 1 << (at & 7))
        return known


def _binary(batch: pa.RecordBatch, column: str) -> pa.Array:
    return batch.column(column).cast(pa.binary())


def item_terms(items: DataFrame, item_col: str, text_col: str, size: int = BUNDLE_ITEMS) -> DataFrame:
    """``(bundle, slot, item_col, term)``: the distinct terms of each item; staged."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, raw in enumerate(_binary(batch, text_col).to_pylist()):
                terms = sorted(set(terms_of(raw)))
                if terms:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part << 32 | n // size] * len(terms), pa.int64()),
                         pa.array([n % size] * len(terms), pa.int32()),
                         batch.column(item_col).take(pa.array([i] * len(terms))), pa.array(terms, pa.binary())],
                        ["bundle", "slot", "item", "term"])
                    n += 1

    kind = dict(items.dtypes)[item_col]
    return stage(items.select(item_col, text_col).mapInArrow(run, f"bundle long, slot int, item {kind}, term binary"), "search-items")


def index(docs: DataFrame, bits, id_col: str, text_col: str, most: int = BLOCK_DOCS) -> DataFrame:
    """Inverted lists by block, staged.  One row per block holds its ids and counts (``term`` null), one
    row per block and term the places of its documents, their occurrences and their lengths."""
    kind = dict(docs.dtypes)[id_col]
    names = ["block", "n_docs", "n_terms", "ids", "term", "ords", "tfs", "lens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        wanted = Wanted(bits.value)
        ids, lens, held, local, which, tfs = [], [], [], {}, [], []
        ids_type = None

        def block() -> Iterator[pa.RecordBatch]:
            at = part << 24 | number
            length = np.asarray(lens, "<u4")
            yield pa.RecordBatch.from_arrays(
                [pa.array([at]), pa.array([len(lens)]), pa.array([int(length.sum(dtype=np.int64))]),
                 pa.ListArray.from_arrays(pa.array([0, len(lens)], pa.int32()), pa.concat_arrays(ids)),
                 *(pa.nulls(1, pa.binary()) for _ in range(4))], names)
            if not which:
                return
            owner = np.asarray(which)
            order = np.argsort(owner, kind="stable")
            ords = np.repeat(np.arange(len(lens), dtype="<u2"), held)[order]
            tf, n = np.asarray(tfs, "<u4")[order], length[ords]
            ends = np.cumsum(np.bincount(owner, minlength=len(local)))
            terms = list(local)
            for a in range(0, len(terms), 2048):
                span = list(zip([0, *ends[:-1]][a:a + 2048], ends[a:a + 2048]))
                k = len(span)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at] * k), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(ids_type)),
                     pa.array(terms[a:a + 2048], pa.binary()),
                     *(pa.array([x[i:j].tobytes() for i, j in span], pa.binary()) for x in (ords, tf, n))], names)

        for batch in batches:
            column, ids_type = batch.column(id_col), batch.column(id_col).type
            for i, raw in enumerate(_binary(batch, text_col)):
                terms = terms_of(raw.as_py())
                if not terms:
                    continue
                counts = Counter(terms)
                hits = [t for t in counts if wanted[t]]
                ids.append(column.slice(i, 1))
                lens.append(len(terms))
                held.append(len(hits))
                which += [local.setdefault(t, len(local)) for t in hits]
                tfs += map(counts.__getitem__, hits)
                if len(lens) >= most or len(which) >= BLOCK_POSTINGS:
                    yield from block()
                    number += 1
                    ids, lens, held, local, which, tfs = [], [], [], {}, [], []
        if lens:
            yield from block()

    return stage(docs.select(id_col, text_col).mapInArrow(
        frugal(run), f"block long, n_docs long, n_terms long, ids array<{kind}>, term binary, ords binary, tfs binary, lens binary"),
        "search-index", "zstd")


def _bits(terms: DataFrame):
    """The filter over the terms of all items, broadcast: of fixed size, however many terms there are."""
    found = terms.select((F.crc32("term") % FILTER_BITS).alias("at")).distinct().toArrow().column("at").to_numpy()
    bits = np.zeros(FILTER_BITS, bool)
    bits[found] = True
    return terms.sparkSession.sparkContext.broadcast(np.packbits(bits, bitorder="little").tobytes())


def weights(terms: DataFrame, postings: DataFrame, n_docs: int) -> DataFrame:
    """``(bundle, slot, term, w, owner)`` for the terms whose weight is above 0; staged."""
    df = postings.groupBy("term").agg((F.sum(F.octet_length("ords")) / 2).cast("long").alias("df"))
    owner = F.lit(len(OWNERS))
    for s, share in reversed(list(enumerate(OWNERS))):
        owner = F.when(F.col("df") * share <= n_docs, s).otherwise(owner)
    w = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    return stage(terms.join(df, "term").select("bundle", "slot", "term", w.alias("w"), owner.alias("owner")).filter("w > 0"), "search-weights")


def bounds(state: DataFrame, weighted: DataFrame, owner: int, k: int) -> DataFrame:
    """Per bundle, for each of its items: the score that k documents have reached already (0: fewer than k),
    the most that the owners from ``owner`` on can add, and the most that those behind it can."""
    rest = weighted.groupBy("bundle", "slot").agg(
        (F.sum(F.when(F.col("owner") >= owner, F.col("w")).otherwise(0)) * MOST).alias("open"),
        (F.sum(F.when(F.col("owner") > owner, F.col("w")).otherwise(0)) * MOST).alias("rest"))
    counted = (state.select("bundle", F.explode("tops").alias("t")).groupBy("bundle", "t.slot", "t.edge").agg(F.sum("t.n").alias("n")))
    above = F.sum("n").over(Window.partitionBy("bundle", "slot").orderBy(F.desc("edge")))
    reached = (counted.withColumn("above", above).filter(F.col("above") >= k).groupBy("bundle", "slot").agg(F.max("edge").alias("edge")))
    return (rest.join(reached, ["bundle", "slot"], "left")
            .select("bundle", F.struct("slot", F.coalesce("edge", F.lit(0)).alias("reached"), "open", "rest").alias("b"))
            .groupBy("bundle").agg(F.collect_list("b").alias("bounds")))


def _accumulate(left: pa.Table, right: pa.Table, stats: tuple[int, int]) -> np.ndarray:
    """The accumulators (items by documents) with the owner's contributions, without those that can't win."""
    n_docs, n_terms = stats
    keys = [np.frombuffer(x.as_py() or b"", "<u4") for x in left.column("keys")]
    places = [np.frombuffer(x.as_py(), "<u2") for x in right.column("ords")]
    width = 1 + max([int(x.max()) for x in places] + [int((x & 0xFFFF).max()) for x in keys if len(x)], default=-1)
    acc = np.zeros((BUNDLE_ITEMS, width), np.int64)
    for x, s in zip(keys, left.column("scores")):
        acc[x >> 16, x & 0xFFFF] = np.frombuffer(s.as_py() or b"", "<i8")
    reached, most, rest = (np.zeros(BUNDLE_ITEMS, np.int64) for _ in range(3))
    for b in left.column("bounds")[0].as_py() or []:
        reached[b["slot"]], most[b["slot"]], rest[b["slot"]] = b["reached"], b["open"], b["rest"]
    shut = np.flatnonzero(most < reached)
    known = acc[shut] > 0
    for w, slots, at, tf, n in zip(right.column("w").to_pylist(), right.column("slots").to_pylist(), places, right.column("tfs"), right.column("lens")):
        tf, n = np.frombuffer(tf.as_py(), "<u4").astype(np.int64), np.frombuffer(n.as_py(), "<u4").astype(np.int64)
        m = 100 - 50 + 50 * n * n_docs // n_terms
        acc[np.ix_(slots, at)] += w * (1_000_000_000 * tf // (1000 * tf + 20 * m))
    if len(shut):
        acc[shut] *= known
    acc[acc + rest[:, None] < reached[:, None]] = 0
    return acc


def _carry(key: tuple, left: pa.Table, right: pa.Table, stats: tuple[int, int], k: int) -> pa.Table:
    """The state row that goes on to the next owner."""
    acc = _accumulate(left, right, stats)
    slot, at = np.nonzero(acc)
    scores = acc[slot, at]
    tops = []
    ends = np.cumsum(np.bincount(slot, minlength=BUNDLE_ITEMS))
    for s, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
        if b > a:
            best = scores[a:b] if b - a <= k else np.partition(scores[a:b], b - a - k)[-k:]
            edge, n = np.unique(EDGES[np.searchsorted(EDGES, best, "right") - 1], return_counts=True)
            tops += [{"slot": s, "edge": x, "n": y} for x, y in zip(edge.tolist(), n.tolist())]
    top = pa.struct([("slot", pa.int32()), ("edge", pa.int64()), ("n", pa.int64())])
    return pa.table({"bundle": pa.array([key[0].as_py()], pa.int64()), "block": pa.array([key[1].as_py()], pa.int64()),
                     "keys": pa.array([(slot << 16 | at).astype("<u4").tobytes()], pa.binary()),
                     "scores": pa.array([scores.astype("<i8").tobytes()], pa.binary()),
                     "tops": pa.array([tops], pa.list_(top))})


def _select(key: tuple, left: pa.Table, right: pa.Table, stats: tuple[int, int], k: int) -> pa.Table:
    """The k best documents of the block for each item, ties by ascending id."""
    acc = _accumulate(left, right, stats)
    ids = left.column("ids")[0].values
    rank = np.empty(len(ids), np.int64)
    rank[pc.sort_indices(ids, sort_keys=[("", "ascending")], null_placement="at_start").to_numpy()] = np.arange(len(ids))
    slots, places, scores = [], [], []
    for s in np.flatnonzero(acc.any(axis=1)):
        at = np.flatnonzero(acc[s])
        at = at[np.lexsort((rank[at], -acc[s][at]))][:k]
        slots.append(np.full(len(at), s))
        places.append(at)
        scores.append(acc[s][at])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    at = join(places)
    return pa.table({"bundle": pa.array([key[0].as_py()] * len(at), pa.int64()), "slot": pa.array(join(slots), pa.int32()),
                     "id": ids.take(pa.array(at, pa.int64())), "score": pa.array(join(scores), pa.int64())})


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", bundle_items: int = BUNDLE_ITEMS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``(item_col, rank, id_col, score)``: the ``k`` best documents of every item, best first.  Bundles of up to
    ``BUNDLE_ITEMS`` items and blocks of up to 65,536 documents may be asked for."""
    spark = docs.sparkSession
    doc_kind, item_kind = dict(docs.dtypes)[id_col], dict(items.dtypes)[item_col]
    terms = item_terms(items, item_col, item_text_col, bundle_items)
    table = index(docs, _bits(terms), id_col, text_col, block_docs)
    blocks, postings = table.filter("term is null"), table.filter("term is not null")
    n_docs, n_terms = blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not n_docs:
        return spark.createDataFrame([], f"`{item_col}` {item_kind}, rank int, `{id_col}` {doc_kind}, score long")
    stats = (n_docs, n_terms)
    weighted = weights(terms, postings, n_docs)
    lists = weighted.groupBy("bundle", "owner", "term", "w").agg(F.collect_list("slot").alias("slots"))
    state = spark.createDataFrame([], STATE)
    for owner in range(len(OWNERS) + 1):
        last = owner == len(OWNERS)
        held = (postings.join(lists.filter(F.col("owner") == owner).drop("owner"), "term")
                .select("bundle", "block", "w", "slots", "ords", "tfs", "lens"))
        # a block may have its first postings of a bundle here: it takes part with the bundle's bounds, too
        carried = (held.select("bundle", "block").distinct().join(state.drop("tops"), ["bundle", "block"], "full")
                   .join(bounds(state, weighted, owner, k), "bundle", "left"))
        if last:
            carried = carried.join(blocks.select("block", "ids"), "block")
        both = carried.groupBy("bundle", "block").cogroup(held.groupBy("bundle", "block"))
        if not last:
            state = stage(both.applyInArrow(lambda key, a, b: _carry(key, a, b, stats, k), STATE), f"search-owner{owner}", "zstd")
            continue
        best = both.applyInArrow(lambda key, a, b: _select(key, a, b, stats, k), f"bundle long, slot int, id {doc_kind}, score long")
    order = Window.partitionBy("bundle", "slot").orderBy(F.desc("score"), F.asc("id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = terms.select("bundle", "slot", "item").distinct()
    return ranked.join(names, ["bundle", "slot"]).select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
