"""Removal of long byte strings that an earlier document holds too (operator 2).

A byte goes when a string of ``LENGTH`` bytes that covers it also starts in a document of a
smaller id.  The corpus is cut so that equal strings meet in one task, and there the
Burrows-Wheeler transforms of the shards that come together are merged:

1. Each string of LENGTH bytes has an anchor, the GRAM-byte string of least hash in it.  A run of
   strings with one anchor is a span of at most 2 * LENGTH - GRAM bytes; equal strings have equal
   anchors, so only spans of one anchor can share a string.
2. Equal spans are stored once: of a class the documents behind the smallest are repeated as a
   whole, and the smallest stands for it (in each task's run first, then in the anchor's partition).
3. Anchors with several different spans are the ends of repeated passages.  Their spans, cut down
   to what any other span of the anchor agrees with, come to the anchor's partition in one shard a
   task.  Each shard's multi-string BWT is built on its own; the BWTs are merged by refining the
   interleave of their suffixes symbol by symbol (suffixes of all shards are never sorted
   together).  A bucket boundary that appears in pass h is a common prefix of h - 1 symbols, so
   after LENGTH passes each interval left is one repeated string; all but its smallest document lose it.

Documents travel in packs of about 1 MB, compressed, and are rewritten pack by pack.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.llm.common import frugal, slices, stage
from pagefold.llm.shingles import column_bytes, mix, powers
from pagefold.session import materialize

#: Bytes of a repeated string; bytes of an anchor; bytes of a pack; spans that a task holds in a run.
LENGTH, GRAM, PACK_BYTES, RUN_SPANS = 50, 16, 1 << 20, 1 << 18
#: Partitions of the exchanges by anchor, for each shuffle partition: a task holds its spans in memory.
SPREAD = 4
_REACH = LENGTH - GRAM  # furthest that a string extends to either side of its anchor
_PLACE = np.uint64((1 << 28) - 1)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(77).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


# ---- packs ---------------------------------------------------------------------------------------

def make_packs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(pack, body)``: the rows of ``docs`` in compressed Arrow streams of about ``PACK_BYTES`` of text,
    as a table bucketed by ``pack``: the joins that bring ranges to their packs don't move the texts again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 5))
        for batch in batches:
            for part in slices(batch, text_col, PACK_BYTES):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=options) as w:
                    w.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                                                 ["pack", "body"])
                number += 1

    return materialize(docs.mapInArrow(frugal(run), "pack long, body binary"), "dedup-packs", key="pack")


def open_pack(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all().combine_chunks()


def _columns(table: pa.Table, id_col: str, text_col: str):
    """Ids (with a mask of nulls), bytes and ends of a pack's texts."""
    flat = lambda c: table[c].chunk(0) if table[c].num_chunks else pa.array([], table[c].type)
    ids = flat(id_col)
    raw, ends = column_bytes(flat(text_col))
    return pa.compute.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64), pa.compute.is_valid(ids).to_numpy(zero_copy_only=False), raw, ends


# ---- spans ---------------------------------------------------------------------------------------

def spans(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor hash, hash of the whole span, start, length and anchor offset of each span."""
    n = len(raw)
    nothing = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n < LENGTH:
        return nothing
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * powers(_BASE, n), dtype=np.uint64)))
    inverse = powers(_INVERSE, n + 1)
    gram = mix((sums[GRAM:] - sums[:-GRAM]) * inverse[:n - GRAM + 1])
    # the anchor of a string: the leftmost of its grams of least hash (a position fits 28 bits)
    least, size, width = gram & ~_PLACE | np.arange(len(gram), dtype=np.uint64), 1, _REACH + 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[:size - width], least[width - size:])
    inside = np.ones(len(least), bool)  # strings that don't cross the end of a text
    for e in ends[1:-1]:
        inside[max(0, e - LENGTH + 1):e] = False
    at = np.flatnonzero(inside)
    if not len(at):
        return nothing
    place = (least[at] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1))))
    lo, hi, place = at[first], at[np.append(first[1:], len(at)) - 1], place[first]
    whole = mix((sums[hi + LENGTH] - sums[lo]) * inverse[lo] + (hi - lo).astype(np.uint64) * _BYTE[9])
    return gram[place], whole, lo, hi - lo + LENGTH, place - lo


_FIELDS = (("anchor", "<u5"), ("whole", "<u8"), ("doc", "<i8"), ("pack", "<i8"), ("start", "<u4"), ("size", "<u1"), ("place", "<u1"))


def _pack_rows(rows: dict[str, np.ndarray], fields=_FIELDS) -> bytes:
    """Columns one behind the other, compressed.  u5 keeps 40 bits: enough to tell the anchors of one
    partition apart, and two that fall together only bring spans to a comparison that finds nothing."""
    import zstandard

    out = []
    for k, t in fields:
        if t == "<u5":
            out += [rows[k].astype("<u4").tobytes(), (rows[k] >> np.uint64(32)).astype("<u1").tobytes()]
        else:
            out.append(np.ascontiguousarray(rows[k], t).tobytes())
    return zstandard.compress(b"".join(out), 1)


def _unpack_rows(blob: bytes, fields=_FIELDS) -> dict[str, np.ndarray]:
    import zstandard

    blob = zstandard.decompress(blob) if blob else b""
    n, at, out = len(blob) // sum(5 if t == "<u5" else np.dtype(t).itemsize for _, t in fields), 0, {}
    for k, t in fields:
        if t == "<u5":
            low = np.frombuffer(blob, "<u4", n, at).astype(np.uint64)
            out[k] = low | np.frombuffer(blob, "<u1", n, at + 4 * n).astype(np.uint64) << np.uint64(32)
            at += 5 * n
        else:
            out[k] = np.frombuffer(blob, t, n, at)
            at += n * np.dtype(t).itemsize
    return out


def _take(rows: dict[str, np.ndarray], which) -> dict[str, np.ndarray]:
    return {k: v[which] for k, v in rows.items()}


def _concat(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _first_of_class(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by (anchor, span, document), and per ordered row the smallest document of its class."""
    order = np.lexsort((rows["doc"], rows["whole"], rows["anchor"]))
    a, w = rows["anchor"][order], rows["whole"][order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (w[1:] != w[:-1])
    return order, rows["doc"][order][np.flatnonzero(new)][np.cumsum(new) - 1]


_RANGE = (("start", "<u4"), ("size", "<u4"))
_REQUEST = (("anchor", "<u8"), ("start", "<u4"), ("size", "<u1"), ("place", "<u1"))


def _by_pack(rows: dict[str, np.ndarray], kind: int, fields) -> Iterator[tuple[int, int, bytes]]:
    order = np.argsort(rows["pack"], kind="stable")
    pack = rows["pack"][order]
    first = np.flatnonzero(np.concatenate(([True], pack[1:] != pack[:-1]))) if len(pack) else []
    for a, b in zip(first, [*first[1:], len(pack)]):
        yield kind, int(pack[a]), _pack_rows(_take(rows, order[a:b]), fields)


def _send(rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(rows), 2048):
        k, p, b = zip(*rows[a:a + 2048])
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(p, pa.int64()), pa.array(b, pa.binary())], ["kind", "key", "blob"])


#: Kinds of rows: packed spans for a partition; repeated ranges of a pack; spans of a pack that are asked for.
SPANS, RANGES, REQUESTS = 0, 1, 2
_SCHEMA = "kind int, key long, blob binary"


def find_classes(packs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Steps 1 and 2: ranges repeated as whole spans, and the spans that step 3 asks for, by pack."""
    n = SPREAD * int(packs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        count = 0

        def deal() -> Iterator[pa.RecordBatch]:
            rows = _concat(held)
            order, smallest = _first_of_class(rows)
            again = np.zeros(len(order), bool)
            again[order] = rows["doc"][order] > smallest
            yield from _send(list(_by_pack(_take(rows, again), RANGES, _RANGE)))
            rows = _take(rows, ~again)  # in the order of the texts, which compresses well
            target = (mix(rows["anchor"] + _GOLD) % np.uint64(n)).astype(np.int64)
            order = np.argsort(target, kind="stable")
            first = np.searchsorted(target[order], np.arange(n + 1))
            yield from _send([(SPANS, t, _pack_rows(_take(rows, order[first[t]:first[t + 1]]))) for t in range(n) if first[t] < first[t + 1]])

        for batch in batches:
            for pack, body in zip(batch.column("pack").to_pylist(), batch.column("body")):
                ids, valid, raw, ends = _columns(open_pack(body.as_buffer()), id_col, text_col)
                anchor, whole, lo, size, place = spans(raw, ends)
                doc = np.searchsorted(ends, lo, "right") - 1
                keep = valid[doc]
                rows = {"anchor": anchor, "whole": whole, "doc": ids[doc], "pack": np.full(len(lo), pack), "start": lo, "size": size, "place": place}
                held.append(_take(rows, keep))
                count += int(keep.sum())
                if count >= RUN_SPANS:
                    yield from deal()
                    held, count = [], 0
        if count:
            yield from deal()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            mine = pa.compute.equal(batch.column("kind"), SPANS)
            others = batch.filter(pa.compute.invert(mine))
            if others.num_rows:
                yield others
            parts += [_unpack_rows(x) for x in batch.filter(mine).column("blob").to_pylist()]
        if not parts:
            return
        rows = _concat(parts)
        parts.clear()
        order, smallest = _first_of_class(rows)
        rows = _take(rows, order)
        again = rows["doc"] > smallest
        yield from _send(list(_by_pack(_take(rows, again), RANGES, _RANGE)))
        rows = _take(rows, ~again)
        # anchors with different spans in different documents
        new = np.concatenate(([True], rows["anchor"][1:] != rows["anchor"][:-1]))
        group, first = np.cumsum(new) - 1, np.flatnonzero(new)
        several = np.maximum.reduceat(rows["whole"], first) != np.minimum.reduceat(rows["whole"], first)
        several &= np.maximum.reduceat(rows["doc"], first) != np.minimum.reduceat(rows["doc"], first)
        yield from _send(list(_by_pack(_take(rows, several[group]), REQUESTS, _REQUEST)))

    dealt = packs.mapInArrow(frugal(emit), _SCHEMA).withColumn("to", F.when(F.col("kind") == SPANS, F.col("key")).otherwise(F.pmod("key", F.lit(n))))
    return dealt.repartition(n, "to").select("kind", "key", "blob").mapInArrow(frugal(meet), _SCHEMA)


# ---- merging of shard BWTs -----------------------------------------------------------------------

class Shard:
    """The multi-string BWT of some strings of symbols 1..255; 0 ends a string."""

    def __init__(self, strings: np.ndarray, sizes: np.ndarray) -> None:
        """``strings``: a row each, zeros behind ``sizes`` symbols."""
        k, width = strings.shape
        wide = np.zeros((k, width + 64), np.uint8)
        wide[:, 1:width + 1] = strings  # column 0: what precedes the first symbol, the end mark
        words = np.zeros((k, width + 57), np.uint64)
        for t in range(8):
            words = (words << np.uint64(8)) | wide[:, t:t + words.shape[1]]
        row = np.repeat(np.arange(k), sizes)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        keys = [words[row, offset + 1 + 8 * j] for j in range((LENGTH + 7) // 8)]
        order = np.lexsort(keys[::-1])
        # the ends first, in the order of the strings, then the suffixes in theirs
        self.row = np.concatenate((np.arange(k), row[order]))
        self.offset = np.concatenate((sizes, offset[order]))
        self.bwt = wide[self.row, self.offset]
        self.strings = k


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' suffixes by their first ``depth`` symbols: the shard of each place, and
    the number of the interval of equal prefixes that the place lies in (short suffixes have their own).

    Pass h takes the interleave by h - 1 symbols, reads each shard's BWT along it and deals the
    places out by these symbols, keeping their order: the interleave by h symbols.
    """
    ids = np.arange(len(shards)).astype(np.uint8 if len(shards) <= 256 else np.uint16)
    ends = sum(s.strings for s in shards)
    tops = np.repeat(ids, [s.strings for s in shards])
    rest = np.repeat(ids, [len(s.bwt) - s.strings for s in shards])
    bwt = np.concatenate([s.bwt for s in shards])
    place = np.concatenate((tops, rest))
    own = np.arange(ends, dtype=np.int32)  # from one symbol on an end is like no other suffix
    interval = np.zeros(len(bwt), np.int32)
    symbol = np.empty(len(bwt), np.uint8)
    boundary = np.empty(len(rest), bool)
    for _ in range(depth):
        symbol[np.argsort(place, kind="stable")] = bwt
        order = np.argsort(symbol, kind="stable")[ends:]  # a string's first suffix has the end mark in front: ``ends`` of these
        place = np.concatenate((tops, place[order]))
        symbols, before = symbol[order], interval[order]
        boundary[0] = True
        boundary[1:] = (symbols[1:] != symbols[:-1]) | (before[1:] != before[:-1])
        interval = np.concatenate((own, np.cumsum(boundary, dtype=np.int32) + np.int32(ends - 1)))
        if interval[-1] == len(interval) - 1:
            break  # no two suffixes are alike any more
    return place, interval


def repeated_starts(groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]], length: int = LENGTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """For shards of ``(strings, sizes, documents)``: per shard the (row, offset) of each string of
    ``length`` symbols that a smaller document holds too."""
    shards = [Shard(s, n) for s, n, _ in groups]
    place, interval = merge(shards, length)
    by_shard = np.argsort(place, kind="stable")
    starts = np.cumsum([0, *(len(s.bwt) for s in shards)])
    doc = np.empty(len(place), np.int64)
    for i, (s, (_, _, d)) in enumerate(zip(shards, groups)):
        doc[by_shard[starts[i]:starts[i + 1]]] = d[s.row]
    first = np.flatnonzero(np.concatenate(([True], interval[1:] != interval[:-1])))
    smallest = np.minimum.reduceat(doc, first)
    again = doc > np.repeat(smallest, np.diff(np.append(first, len(doc))))
    out = []
    for i, s in enumerate(shards):
        hit = again[by_shard[starts[i]:starts[i + 1]]]
        out.append((s.row[hit], s.offset[hit]))
    return out


def _common(a: np.ndarray) -> np.ndarray:
    """Per row of a sorted symbol matrix, the longer of the prefixes it has in common with its neighbours."""
    same = np.cumprod(a[1:] == a[:-1], axis=1, dtype=np.uint8).sum(1)
    return np.maximum(np.append(same, 0), np.append(0, same))


def _sides(rows: dict[str, np.ndarray], text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which part of each span any other span of its anchor agrees with: (from, to), offsets in the span."""
    n = len(at)
    size, place = rows["size"].astype(np.int64), rows["place"].astype(np.int64)
    found = []
    for left in (True, False):
        reach = np.arange(_REACH)
        offset = place[:, None] - 1 - reach if left else place[:, None] + GRAM + reach
        ok = (offset >= 0) & (offset < size[:, None])
        side = np.where(ok, text[np.minimum(at[:, None] + np.clip(offset, 0, 255), len(text) - 1)], 0).astype(np.uint8)
        wide = np.zeros((n, 40), np.uint8)
        wide[:, :_REACH] = side
        words = wide.view(">u8").astype(np.uint64)
        order = np.lexsort([*(words[:, j] for j in range(4, -1, -1)), rows["anchor"]])
        mark = np.concatenate((rows["anchor"].view(np.uint8).reshape(n, 8), side), axis=1)[order]
        common = np.empty(n, np.int64)
        common[order] = np.maximum(_common(mark).astype(np.int64) - 8, 0)
        found.append(np.minimum(common, ok.sum(1)))
    return np.stack((place - found[0], place + GRAM + found[1]), 1)


def merge_ends(packs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Step 3: ranges of the spans asked for that a smaller document holds too, by pack."""
    n = SPREAD * int(packs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = (("anchor", "<u8"), ("doc", "<i8"), ("pack", "<i8"), ("start", "<u4"), ("size", "<u1"), ("place", "<u1"))
    asked = found.filter(F.col("kind") == REQUESTS).groupBy(F.col("key").alias("pack")).agg(F.collect_list("blob").alias("blobs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        texts: list[np.ndarray] = []
        count = 0

        def deal() -> Iterator[pa.RecordBatch]:
            rows, text = _concat(held), np.concatenate(texts)
            size = rows["size"].astype(np.int64)
            begin = np.cumsum(size) - size
            target = (mix(rows["anchor"] + _GOLD) % np.uint64(n)).astype(np.int64)
            out = []
            order = np.argsort(target, kind="stable")
            first = np.searchsorted(target[order], np.arange(n + 1))
            for t in range(n):
                own = order[first[t]:first[t + 1]]
                if len(own):
                    where = np.repeat(begin[own] - np.cumsum(size[own]) + size[own], size[own]) + np.arange(size[own].sum())
                    head = _pack_rows(_take(rows, own), fields)
                    out.append((SPANS, t, len(head).to_bytes(8, "little") + head + text[where].tobytes()))
            yield from _send(out)

        for batch in batches:
            for pack, body, blobs in zip(batch.column("pack").to_pylist(), batch.column("body"), batch.column("blobs").to_pylist()):
                ids, _, raw, ends = _columns(open_pack(body.as_buffer()), id_col, text_col)
                rows = _concat([_unpack_rows(b, _REQUEST) for b in blobs])
                start, size = rows["start"].astype(np.int64), rows["size"].astype(np.int64)
                held.append({**rows, "doc": ids[np.searchsorted(ends, start, "right") - 1], "pack": np.full(len(start), pack)})
                texts.append(raw[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())])
                count += len(start)
                if count >= RUN_SPANS // 2:
                    yield from deal()
                    held, texts, count = [], [], 0
        if count:
            yield from deal()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, texts, shard = [], [], []
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                head = 8 + int.from_bytes(blob[:8], "little")
                parts.append(_unpack_rows(blob[8:head], fields))
                texts.append(np.frombuffer(blob, np.uint8, offset=head))
                shard.append(np.full(len(parts[-1]["doc"]), len(shard)))
        if not parts:
            return
        rows, text, shard = _concat(parts), np.concatenate(texts), np.concatenate(shard)
        size = rows["size"].astype(np.int64)
        at = np.cumsum(size) - size
        part = _sides(rows, text, at)
        keep = np.flatnonzero(part[:, 1] - part[:, 0] >= LENGTH)
        if not len(keep):
            return
        part, shard = part[keep], shard[keep]
        rows = _take(rows, keep)
        sizes = part[:, 1] - part[:, 0]
        column = np.arange(2 * LENGTH - GRAM)
        strings = np.where(column < sizes[:, None], text[np.minimum((at[keep] + part[:, 0])[:, None] + column, len(text) - 1)] + 1, 0).astype(np.uint8)
        groups, members = [], []
        for s in np.unique(shard):
            own = np.flatnonzero(shard == s)
            groups.append((strings[own], sizes[own], rows["doc"][own]))
            members.append(own)
        out = {"pack": [], "start": [], "size": []}
        for own, (row, offset) in zip(members, repeated_starts(groups)):
            out["pack"].append(rows["pack"][own][row])
            out["start"].append(rows["start"][own][row] + part[own, 0][row] + offset)
        out = {"pack": np.concatenate(out["pack"]), "start": np.concatenate(out["start"])}
        yield from _send(list(_by_pack({**out, "size": np.full(len(out["start"]), LENGTH)}, RANGES, _RANGE)))

    cuts = packs.join(asked, "pack").mapInArrow(frugal(cut), _SCHEMA)
    return cuts.repartition(n, "key").mapInArrow(frugal(meet), _SCHEMA)


# ---- the whole operator --------------------------------------------------------------------------

def removed_runs(starts: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """Maximal runs ``(text, from, to)`` covered by the ranges (none crosses the end of a text)."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    lo, hi = starts[order], np.maximum.accumulate(starts[order] + sizes[order])
    doc = np.searchsorted(ends, lo, "right") - 1
    new = np.concatenate(([True], (lo[1:] > hi[:-1]) | (doc[1:] != doc[:-1])))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(lo)) - 1
    return list(zip(doc[first].tolist(), (lo[first] - ends[doc[first]]).tolist(), (hi[last] - ends[doc[first]]).tolist()))


def rewrite(docs: DataFrame, schema: str, finish: Callable, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``finish(table, texts, runs)`` -> Arrow batch, for each pack: its rows, the bytes of each text
    and per text the list of removed ``(from, to)``.

    Null and empty texts have nothing to remove; rows with a null id are neither looked up nor cut;
    rows of one id are one document (no string of theirs counts against another); texts of any
    length and other columns pass through whole.
    """
    packs = make_packs(docs, id_col, text_col)
    found = stage(find_classes(packs, id_col, text_col), "dedup-found")
    ends_found = stage(merge_ends(packs, found, id_col, text_col), "dedup-ends")
    ranges = (found.filter(F.col("kind") == RANGES).unionAll(ends_found)
              .groupBy(F.col("key").alias("pack")).agg(F.collect_list("blob").alias("blobs")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, blobs in zip(batch.column("body"), batch.column("blobs").to_pylist()):
                table = open_pack(body.as_buffer())
                _, _, raw, ends = _columns(table, id_col, text_col)
                cuts = _concat([_unpack_rows(b, _RANGE) for b in blobs or [b""]])
                runs: list[list[tuple[int, int]]] = [[] for _ in range(len(ends) - 1)]
                for d, a, b in removed_runs(cuts["start"].astype(np.int64), cuts["size"].astype(np.int64), ends):
                    runs[d].append((a, b))
                yield finish(table, [raw[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], runs)

    return packs.join(ranges, "pack", "left").mapInArrow(frugal(run), schema)


def kept_bytes(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in runs:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def digests(docs: DataFrame) -> DataFrame:
    """Per document: bytes, removed bytes, maximal removed runs, digest of what is left."""

    def finish(table: pa.Table, texts: list[bytes], runs: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [table["doc_id"].combine_chunks().cast(pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
             pa.array([sum(b - a for a, b in r) for r in runs], pa.int64()), pa.array([len(r) for r in runs], pa.int64()),
             pa.array([hashlib.sha256(kept_bytes(t, r)).hexdigest() for t, r in zip(texts, runs)], pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rewrite(docs.select("doc_id", "text"), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", finish)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated strings cut out of ``text`` (whole characters only: a character that
    a run cuts through stays) and ``n_chars`` counted anew; other columns as they were."""
    schema = docs.schema

    def finish(table: pa.Table, texts: list[bytes], runs: list) -> pa.RecordBatch:
        out = []
        for was, t, r in zip(table["text"].to_pylist(), texts, runs):
            whole = []
            for a, b in r:
                while a < b and t[a] & 0xC0 == 0x80:
                    a += 1
                while b < len(t) and b > a and t[b] & 0xC0 == 0x80:
                    b -= 1
                whole.append((a, b))
            out.append(kept_bytes(t, whole).decode() if whole else was)
        columns = {c: table[c].combine_chunks() for c in table.column_names}
        columns["text"] = pa.array(out, columns["text"].type)
        if "n_chars" in columns:
            cut = [len(x) if r else None for x, r in zip(out, runs)]
            columns["n_chars"] = pa.compute.coalesce(pa.array(cut, columns["n_chars"].type), columns["n_chars"])
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return rewrite(docs, schema, finish)
