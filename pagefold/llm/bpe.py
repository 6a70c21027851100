"""Byte-level BPE encoding and decoding (operator 1).

Merges follow a hierarchical-bitmap rank queue: one bucket per merge rank holds positions of a
linked list of tokens, a three-level bitmap finds the lowest rank that has a bucket, and entries
whose pair changed since are skipped when they come up.  Finding a rank costs O(1) whatever the
length, a position in its bucket a heap step, so a pre-token of a megabyte is no special case.  Many short pre-tokens share one
list (a barrier between neighbours), so that a bucket is found once for all of them.

Rows: null and empty texts give an empty id list; repeated rows are each encoded; other columns
are not looked at, whatever their names.  An id outside the vocabulary fails the decode.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.llm.common import frugal, slices, worker_cache

NO_PAIR = 1 << 30
#: Encoded pre-tokens that a worker keeps, in each of two generations.
CACHE_ENTRIES = 400_000


class RankQueue:
    """Positions by merge rank; ``first()`` is the lowest rank that holds any."""

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.words: dict[int, int] = {}  # 64 ranks a word
        self.mid: dict[int, int] = {}  # 64 words a word
        self.top = 0

    def push(self, rank: int, at: int) -> None:
        if bucket := self.buckets.get(rank):
            heappush(bucket, at)
            return
        self.buckets[rank] = [at]
        w, m = rank >> 6, rank >> 12
        self.words[w] = self.words.get(w, 0) | 1 << (rank & 63)
        self.mid[m] = self.mid.get(m, 0) | 1 << (w & 63)
        self.top |= 1 << m

    def first(self) -> int:
        if not self.top:
            return -1
        m = (self.top & -self.top).bit_length() - 1
        x = self.mid[m]
        w = m << 6 | (x & -x).bit_length() - 1
        x = self.words[w]
        return w << 6 | (x & -x).bit_length() - 1

    def drop(self, rank: int) -> None:
        """Forget the (empty) bucket of ``rank``."""
        del self.buckets[rank]
        w, m = rank >> 6, rank >> 12
        self.words[w] &= ~(1 << (rank & 63))
        if not self.words[w]:
            self.mid[m] &= ~(1 << (w & 63))
            if not self.mid[m]:
                self.top &= ~(1 << m)


class Vocabulary:
    """Merge ranks of a tiktoken file and what follows from them."""

    def __init__(self, rank_file: bytes, pattern: str) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.single = [self.ranks.get(bytes([i]), NO_PAIR) for i in range(256)]
        self.first_pairs = [self.ranks.get(bytes([a, b]), NO_PAIR) for a in range(256) for b in range(256)]
        self.pairs: dict[int, int] = {}  # left id << 20 | right id -> rank of the joined bytes
        self.split = splitter(pattern)
        # all tokens' bytes in one array, by id, for decoding with gathers
        by_id = [self.tokens.get(i, b"") for i in range(max(self.tokens, default=-1) + 1)]
        self.flat = np.frombuffer(b"".join(by_id), np.uint8)
        self.sizes = np.fromiter(map(len, by_id), np.int64, len(by_id))
        self.begins = np.cumsum(self.sizes) - self.sizes

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for; an id outside the vocabulary fails."""
        out = []
        for a in range(0, len(ids), 1 << 20):
            part = ids[a:a + (1 << 20)]
            if len(part) and (part.min() < 0 or part.max() >= len(self.sizes) or not self.sizes[part].all()):
                raise KeyError("an id outside the vocabulary")
            sizes = self.sizes[part]
            ends = np.cumsum(sizes)
            places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begins[part] - ends + sizes, sizes)
            out.append(self.flat[places].tobytes())
        return b"".join(out)

    def pair_rank(self, left: int, right: int) -> int:
        key = left << 20 | right
        rank = self.pairs.get(key)
        if rank is None:
            rank = self.pairs[key] = self.ranks.get(self.tokens[left] + self.tokens[right], NO_PAIR)
        return rank

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of each piece; a piece that is a token is that token."""
        single, pairs, pair_rank, ranks = self.single, self.pairs, self.pair_rank, self.ranks
        whole = [ranks.get(p) for p in pieces]
        token: list[int] = []
        rank_at: list[int] = []
        starts: list[int] = []
        queue = RankQueue()
        push, buckets, first_pairs = queue.push, queue.buckets, self.first_pairs
        for p, w in zip(pieces, whole):
            at = len(token)
            starts.append(at)
            if w is None:
                token += [single[b] for b in p]
                ranks_here = [first_pairs[a << 8 | b] for a, b in zip(p, p[1:])]
                rank_at += ranks_here
                for i, r in enumerate(ranks_here, at):
                    if r != NO_PAIR:
                        if r in buckets:
                            buckets[r].append(i)  # ascending, so still a heap
                        else:
                            push(r, i)
                if p:
                    rank_at.append(NO_PAIR)
            token.append(-1)  # barrier
            rank_at.append(NO_PAIR)
        n = len(token)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        while (rank := queue.first()) >= 0:
            bucket, lower = buckets[rank], False
            while bucket and not lower:
                i = heappop(bucket)
                if rank_at[i] != rank:
                    continue  # stale
                j = nxt[i]
                k = nxt[j]
                token[i], token[j], rank_at[j] = rank, -2, NO_PAIR
                nxt[i], prv[k] = k, i
                right = token[k]
                if right >= 0:
                    r = pairs.get(rank << 20 | right)
                    if r is None:
                        r = pair_rank(rank, right)
                    rank_at[i] = r
                    if r != NO_PAIR:
                        push(r, i)
                        lower = r < rank
                else:
                    rank_at[i] = NO_PAIR
                h = prv[i]
                if h >= 0 and token[h] >= 0:
                    r = pairs.get(token[h] << 20 | rank)
                    if r is None:
                        r = pair_rank(token[h], rank)
                    if r != rank_at[h]:
                        rank_at[h] = r
                        if r != NO_PAIR:
                            push(r, h)
                            lower = lower or r < rank
            if not bucket:
                queue.drop(rank)
        out = []
        for s, w in zip(starts, whole):
            if w is not None:
                out.append([w])
                continue
            ids, i = [], s
            while token[i] != -1:
                ids.append(token[i])
                i = nxt[i]
            out.append(ids)
        return out


def splitter(pattern: str):
    """``findall`` of the pattern.  Texts of Latin-1 characters go to the standard library's matcher,
    with the Unicode classes spelt out for these 256 characters (several times as fast)."""
    import regex

    latin = "".join(map(chr, range(256)))
    spelt = {cls: "".join(f"\\x{ord(c):02x}" for c in regex.findall(name, latin))
             for cls, name in ((r"\p{L}", r"\p{L}"), (r"\p{N}", r"\p{N}"), (r"\s", r"\p{White_Space}"))}
    every = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
    out, i, inside = [], 0, False
    while i < len(pattern):
        name = next((x for x in (r"\p{L}", r"\p{N}", r"\s", r"\S") if pattern.startswith(x, i)), "")
        if name:
            cls = spelt.get(name) or spelt[r"\s"]
            out.append(cls if inside else f"[{'^' * (name == chr(92) + 'S')}{cls}]")
            i += len(name)
            continue
        inside = pattern[i] == "[" or inside and pattern[i] != "]"
        out.append(pattern[i])
        i += 1
    fast = re.compile("".join(out)).findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return every(text)
        return fast(text)

    return split


class Encoded(dict):
    """Pre-token -> little-endian int32 ids, in two generations so that memory stays bounded."""

    def __init__(self, vocabulary: Vocabulary, entries: int) -> None:
        self.vocabulary, self.entries, self.old = vocabulary, entries, {}

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > self.entries:
            self.old = dict(self)
            self.clear()
            new = list(words)
        missing = []
        for w in new:
            if (known := self.old.get(w)) is None:
                missing.append(w)
            else:
                self[w] = known
        for a in range(0, len(missing), 4096):
            part = missing[a:a + 4096]
            for w, ids in zip(part, self.vocabulary.merge([w.encode() for w in part])):
                self[w] = np.asarray(ids, "<i4").tobytes()


def _vocabulary(rank_file, pattern: str) -> Vocabulary:
    return worker_cache(f"bpe-{hash(rank_file.value)}-{pattern}", lambda: Vocabulary(rank_file.value, pattern))


def _encoded(shared, pattern: str, id_col: str, text_col: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The vocabulary, an Arrow batch's ids and the token ids of its texts, slice by slice."""
    vocabulary = _vocabulary(shared, pattern)
    known = worker_cache(f"bpe-cache-{hash(shared.value)}-{pattern}", lambda: Encoded(vocabulary, CACHE_ENTRIES))
    split = vocabulary.split
    for batch in batches:
        for part in slices(batch, text_col, 1 << 20):
            words = [split(t or "") for t in part.column(text_col).to_pylist()]
            known.learn(set().union(*words))
            yield vocabulary, part.column(id_col), [np.frombuffer(b"".join(map(known.__getitem__, w)), "<i4") for w in words]


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows) if rows else np.zeros(0, "<i4"), pa.int32()))


def _ranks(docs: DataFrame, rank_path: str):
    with open(rank_path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids array<int>)``: the token ids of every whole text; no shuffle.

    ``rank_path`` is a local file of the driver (under 1 MB for 50,000 ranks); its bytes are
    broadcast, so executors need no copy.
    """
    shared = _ranks(docs, rank_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, rows in _encoded(shared, pattern, id_col, text_col, batches):
            yield pa.RecordBatch.from_arrays([ids, _lists(rows)], [id_col, "ids"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(frugal(run), f"`{id_col}` {kind}, ids array<int>")


def decode(tokens: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id_col, ids_col, decoded binary)``: the bytes that the ids stand for; null ids count as none."""
    shared = _ranks(tokens, rank_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared, pattern)
        for batch in batches:
            column = batch.column(ids_col)
            out = [vocabulary.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else b"" for x in column]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), column, pa.array(out, pa.binary())],
                                             [id_col, ids_col, "decoded"])

    kind = dict(tokens.dtypes)
    return tokens.select(id_col, ids_col).mapInArrow(frugal(run), f"`{id_col}` {kind[id_col]}, `{ids_col}` {kind[ids_col]}, decoded binary")


def encode_and_decode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids, decoded)`` in one pass: ``encode``, and ``decode`` of the ids that it gave."""
    shared = _ranks(docs, rank_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for vocabulary, ids, rows in _encoded(shared, pattern, id_col, text_col, batches):
            yield pa.RecordBatch.from_arrays([ids, _lists(rows), pa.array(map(vocabulary.decode, rows), pa.binary())], [id_col, "ids", "decoded"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(frugal(run), f"`{id_col}` {kind}, ids array<int>, decoded binary")


def digested(decoded: DataFrame, keep_ids: bool = False) -> DataFrame:
    """Number of tokens, digest of the ids, digest of the decoded bytes; with ``keep_ids`` the ids too."""
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), *(["ids"] if keep_ids else []))


def token_digests(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """Per document: number of tokens, digest of the ids, digest of the bytes decoded from them."""
    return digested(encode_and_decode(docs, rank_path, pattern))
