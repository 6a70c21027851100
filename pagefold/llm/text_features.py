"""Hashed features of whole texts, and bounded labelled samples, for the classifiers."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.llm.common import frugal, slices, worker_cache

#: Words whose hashes a worker keeps.
CACHE_ENTRIES = 150_000
#: Classes of bytes counted by ``structure``.
_CLASS = np.zeros(256, np.uint8)
for _k, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n",
                           b".,;:'\"()-?", b"!", b"#$%&*", b"|<>[]{}\\/=+_^~`@", bytes(range(128, 192)), bytes(range(192, 256))), 1):
    _CLASS[list(_set)] = _k
N_STRUCTURE = 18


class Hashes(dict):
    """Word -> little-endian int32 feature numbers, kept until ``CACHE_ENTRIES`` words are known."""

    def __init__(self, numbers: Callable[[str], list[int]]) -> None:
        self.numbers = numbers

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        out = np.asarray(self.numbers(word), "<i4").tobytes()
        if len(word) <= 64:
            self[word] = out
        return out


def structure(text: str, words: list[str]) -> np.ndarray:
    """Statistics of the whole text: shares of byte classes, word lengths, repetition, size."""
    raw = np.frombuffer(text.encode(), np.uint8)
    counts = np.bincount(_CLASS[raw], minlength=12)
    n, w = max(1, len(raw)), max(1, len(words))
    lines = text.split("\n")
    return np.array([*(counts[1:12] / n), len(set(words)) / w, sum(map(str.__eq__, words, words[1:])) / w,
                     len(set(lines)) / len(lines), counts[5] / w, len(raw) / w / 20,
                     counts[2] / max(1, counts[1] + counts[2]), np.log1p(len(raw)) / 12], np.float32)


def in_batches(docs: DataFrame, id_col: str, text_col: str, schema: str, extra: list[str], work) -> DataFrame:
    """``work(ids, texts, others)`` -> Arrow batch, over slices of a few MB of whole texts (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {}
        for batch in batches:
            for part in slices(batch, text_col):
                yield work(state, part, [t or "" for t in part.column(text_col).to_pylist()])

    return docs.select(id_col, text_col, *extra).mapInArrow(frugal(run), schema)


def labelled_sample(labels: DataFrame, label: str, modulus: int, held_remainder: int, most: int) -> tuple[DataFrame, int, int]:
    """About ``most`` labelled rows outside the held-out fold, chosen by a hash of their ids, with the
    counts of all labelled rows there (negative, positive).  Repeated ids count once (largest label);
    null ids and null labels don't count.  The bound keeps what is sent to the driver, and what is
    broadcast, the same at every size."""
    rows = (labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
            .filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) != held_remainder)
            .groupBy("doc_id").agg(F.max(F.col(label)).alias("label")))
    found = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    total = sum(found.values())
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    return rows.filter(part < int((1 << 20) * min(1, most / max(1, total)))), found.get(0, 0), found.get(1, 0)


def held_out(id_col: str, modulus: int, remainder: int):
    """Whether the id's crc32 has the held-out remainder; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def hash_cache(name: str, numbers: Callable[[str], list[int]]) -> Hashes:
    return worker_cache(f"hashes-{name}", lambda: Hashes(numbers))


def word_hash(word: str, size: int, seed: int = 0) -> int:
    return zlib.crc32(word.encode(), seed) % size
