"""Token counts of a sentencepiece model without a pre-token shuffle (operator 3).

A text with U+0020 written as U+2581 is cut in front of each run of spaces.  No piece of the
model holds U+2581 after another character (checked against the model), so no merge crosses a
cut and the count of a text is the sum over its pre-tokens.  Lengths come from two tiers: a
compact table of the frequent pre-tokens, broadcast to all tasks, and a cache in each worker
that encodes what the table lacks.  The table is a cache only: it never changes a count.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.llm.common import frugal, slices, worker_cache

#: Frequent pre-tokens broadcast: so many at most, each of so many bytes at most (about 4 MB).
TABLE_ENTRIES, TABLE_BYTES = 65_536, 48
#: Candidates that a task reports for the table.
TASK_ENTRIES = 4_096
#: Pre-token lengths that a worker keeps.
CACHE_ENTRIES = 400_000
SPACE = "▁"
#: A run of spaces with the word behind it (U+2581 in a text is the same symbol as a space).
PRE_TOKEN = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens without their first U+2581; ``None`` of an empty text gives no pre-token."""
    text = text.replace(SPACE, " ")
    if "  " in text or text[-1:] == " " or text[:1] == " ":
        return [x[1:] for x in PRE_TOKEN.findall((SPACE + text).replace(" ", SPACE))]
    return text.split(" ") if text else []


class Lengths(dict):
    """Pre-token -> number of tokens; encodes what it lacks."""

    def __init__(self, processor, table: dict[str, int], entries: int) -> None:
        super().__init__(table)
        self.processor, self.table, self.entries = processor, table, entries

    def __missing__(self, word: str) -> int:
        # the processor puts the first U+2581 in front itself; of nothing it makes nothing
        n = len(self.processor.encode(word.replace(SPACE, " "))) if word else 1
        if len(word) <= 256:
            if len(self) >= self.entries + len(self.table):
                self.clear()
                self.update(self.table)
            self[word] = n
        return n


def load_processor(model: bytes):
    """The library's processor, after checking that the cut in front of spaces is safe."""
    import sentencepiece as spm

    processor = spm.SentencePieceProcessor(model_proto=model)
    for i in range(processor.get_piece_size()):
        if re.search(f"[^{SPACE}]{SPACE}", processor.id_to_piece(i)):
            raise ValueError("a piece of this model crosses a space: its texts can't be cut there")
    if processor.encode(" ") == processor.encode("") or len(processor.encode("a ")) != len(processor.encode("a")) + 1:
        raise ValueError("this model drops or rewrites spaces: its texts can't be cut there")
    return processor


def frequent_pre_tokens(docs: DataFrame, text_col: str, entries: int = TABLE_ENTRIES) -> list[str]:
    """The pre-tokens most counted over all texts: each task counts its own texts and reports its
    ``TASK_ENTRIES`` commonest (bounded, so no pre-token shuffle), Spark adds these up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for part in slices(batch, text_col):
                for t in part.column(text_col).to_pylist():
                    counts.update(pre_tokens(t or ""))
                if len(counts) > CACHE_ENTRIES // 2:
                    counts = Counter(dict(counts.most_common(CACHE_ENTRIES // 8)))
        top = [(w, n) for w, n in counts.most_common(TASK_ENTRIES) if n > 1 and len(w.encode()) <= TABLE_BYTES]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())],
                                         ["word", "n"])

    found = docs.select(text_col).mapInArrow(frugal(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in found.orderBy(F.desc("n"), "word").limit(entries).collect()]


def pack_table(words: list[str], processor) -> tuple[bytes, bytes, bytes]:
    """Texts, their byte lengths and their token counts as three flat arrays."""
    raw = [w.encode() for w in words]
    counts = [len(processor.encode(w.replace(SPACE, " "))) if w else 1 for w in words]
    return b"".join(raw), np.asarray([len(x) for x in raw], "<u2").tobytes(), np.asarray(counts, "<u2").tobytes()


def unpack_table(table: tuple[bytes, bytes, bytes]) -> dict[str, int]:
    ends = np.cumsum(np.frombuffer(table[1], "<u2").astype(int)).tolist()
    return {table[0][a:b].decode(): n for a, b, n in zip([0, *ends], ends, np.frombuffer(table[2], "<u2").tolist())}


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """``(id_col, n_bytes, n_tokens, over_limit)`` of every whole text.

    Null and empty texts count 0 bytes and 0 tokens; a text of any length is cut into pre-tokens
    and never held as ids; repeated rows and rows with null ids are each counted; other columns
    are ignored.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    context = docs.sparkSession.sparkContext
    shared_model = context.broadcast(model)
    shared = context.broadcast(pack_table(frequent_pre_tokens(docs, text_col), load_processor(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = worker_cache(f"sp-{hash(shared_model.value)}", lambda: load_processor(shared_model.value))
        known = worker_cache(f"sp-len-{hash(shared_model.value)}-{hash(shared.value)}",
                             lambda: Lengths(processor, unpack_table(shared.value), CACHE_ENTRIES))
        for batch in batches:
            for part in slices(batch, text_col):
                texts = part.column(text_col)
                counts = [sum(map(known.__getitem__, pre_tokens(t or ""))) for t in texts.to_pylist()]
                sizes = pa.compute.cast(pa.compute.fill_null(pa.compute.binary_length(texts), 0), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col), sizes, pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                    [id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(frugal(run), f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
