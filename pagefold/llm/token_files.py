"""Token ids in binary files under a shared Zstandard dictionary (operator 11).

The dictionary is trained on serialized id arrays of a sample of documents and stored once; its
SHA-256 stands in the head of every file.  Each document is a frame of its own, so a short one is
read alone: the index, kept in each file's foot and in the table of documents, says where.

A file: head ``PFTK1``, bytes an id, SHA-256 of the dictionary; the frames in ascending id order; the
index (Zstandard frame of an Arrow stream ``id, offset, size, n_tokens``); its size in 8 bytes and
``PFTK1`` again.  Ids are little-endian and unsigned, two bytes wide when all ids of the tokenizer are
below 65,536, else four.

Texts are range-partitioned by document id and sorted, and each task encodes its range straight
into files, so the order of the files is the order of the documents.  Tasks write under names of
their own and only those that finished tasks returned are read: a lost executor leaves an
unlisted file, never a wrong result.

Rows: null and empty texts hold the end id alone; null ids come first; rows that repeat an id are
documents of their own, in the order of their texts' hash; a text of any length is cut at spaces
and line feeds (no token crosses one) and its ids are held as bytes; an empty table writes no file;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pagefold.llm.common import frugal, new_folder, slices, stage, worker_cache
from pagefold.llm.warc import _dictionary, open_folder, train_dictionary

#: Fixed value of the format.
MAGIC = b"PFTK1"
#: Documents sampled for the dictionary, bytes of ids taken of each, size of the dictionary.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 1_000, 4_096, 65_536
#: A file is closed once it holds so many compressed bytes or documents (its index is held in memory).
FILE_BYTES, FILE_DOCS = 128 << 20, 1 << 20
#: Encoded words that a worker keeps in each of two generations, and the longest of them.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 64

INDEX = [("id", None), ("offset", pa.int64()), ("size", pa.int64()), ("n_tokens", pa.int64())]


#: The front of a tokenizer whose words of lower-case letters go to its model as they are (fixed values).
PLAIN_FRONT = (
    [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
     {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
)


#: ASCII marks, none of which belongs to a word; a stop or comma that another mark may precede.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
RUN_OF_MARKS = re.compile("[^a-z0-9\xdf-\xf6\xf8-\xff \n][.,][ \n]")


def _byte_letters() -> dict[int, int]:
    """The letters of a byte-level model: printable bytes stand for themselves, the others for U+0100 onwards."""
    odd = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF)]
    return {b: 256 + i for i, b in enumerate(odd)}


class Words(dict):
    """Word (text between spaces) -> its serialized ids, in two generations so that memory stays bounded."""

    def __init__(self, tokenizer_json: str, entries: int = CACHE_ENTRIES) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.entries, self.old = entries, {}
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = 2 if all(i < 1 << 16 for i in vocabulary.values()) else 4
        # the cut is safe when nothing of a text's spaces and of what stands beside them reaches the ids
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        if ids(" ") or ids("\n") or ids("a b\nc") != ids("a") + ids("b") + ids("c") or any(" " in t or "\n" in t for t in vocabulary):
            raise ValueError("this tokenizer has tokens that cross spaces: its texts can't be cut there")
        spec = json.loads(tokenizer_json)
        front = tuple((spec.get(x) or {}).get(y) for x, y in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        self.plain = front == PLAIN_FRONT and not any(t["content"].isalpha() for t in spec["added_tokens"])
        self.letters, self.model = _byte_letters(), self.tokenizer.model

    def pack(self, ids) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def _simple(self, word: str) -> bytes | None:
        """Ids of a word of letters below U+0250, which no normalization but lower case changes."""
        word = word.lower()
        if not word.isalpha() or max(word) >= "\u0250":
            return None
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return self.pack([t.id for t in self.model.tokenize(word)])

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self._make(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def _make(self, word: str) -> bytes:
        if self.plain and word:
            ids = self._simple(word)
            if ids is not None:
                return ids
            stem = word.rstrip(MARKS)  # marks behind letters are a piece of their own
            if stem and len(stem) < len(word) and (ids := self._simple(stem)) is not None:
                return ids + self[word[len(stem):]]
        return self.pack(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def _fold(self, text: str) -> str:
        """A text of the same ids with fewer different words: Latin-1 letters in lower case, full stops and
        commas behind letters or digits set off."""
        if not self.plain or "<|" in text:
            return text
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        text = text.lower()
        if not RUN_OF_MARKS.search(text):
            for mark in (". ", ", ", ".\n", ",\n"):
                text = text.replace(mark, " " + mark)
        return text

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The serialized ids of whole texts."""
        get = self.__getitem__
        for text in texts:
            yield b"".join(map(get, self._fold(text).replace("\n", " ").split(" ")))

    def encode(self, text: str) -> bytes:
        """The serialized ids of a whole text, piece by piece."""
        return b"".join(self.encode_all(pieces(text)))


def pieces(text: str, most: int = 1 << 20) -> Iterator[str]:
    """A text cut at single spaces into pieces of about ``most`` characters."""
    a = 0
    while len(text) - a > most and (b := text.find(" ", a + most)) >= 0:
        yield text[a:b]
        a = b + 1
    yield text[a:]


def _words(shared) -> Words:
    return worker_cache(f"token-words-{hash(shared.value)}", lambda: Words(shared.value))


def _sample(docs: DataFrame, shared, id_col: str, text_col: str) -> list[bytes]:
    """Serialized ids of about ``SAMPLE_DOCS`` documents by a hash of the id, ``SAMPLE_BYTES`` of each."""
    part = F.pmod(F.xxhash64(id_col), F.lit(1 << 30))
    few = docs.filter(part < int((1 << 30) * min(1, SAMPLE_DOCS / max(1, docs.count()))))
    few = few.select(F.substring(text_col, 1, SAMPLE_BYTES).alias("head")).limit(2 * SAMPLE_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(shared)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([words.encode(t or "")[:SAMPLE_BYTES] for t in batch.column("head").to_pylist()], pa.binary())], ["ids"])

    return [bytes(x) for x in few.mapInArrow(run, "ids binary").toArrow().column("ids").to_pylist()]


class Writer:
    """One file; ``close`` appends the index."""

    def __init__(self, folder: str, width: int, sha: bytes, kind: pa.DataType) -> None:
        files, base = open_folder(folder)
        self.name = f"{uuid.uuid4().hex}.tok"
        self.out, self.kind = files.open_output_stream(f"{base}/{self.name}", compression=None), kind
        self.index: list[list] = [[], [], [], []]
        self.at = 0
        self._put(MAGIC + bytes([width]) + sha)

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def add(self, doc: pa.Array, frame: bytes, n: int) -> None:
        for column, x in zip(self.index, (doc, self.at, len(frame), n)):
            column.append(x)
        self._put(frame)

    def close(self) -> tuple[pa.RecordBatch, int]:
        """The index and the size of the file."""
        index = pa.RecordBatch.from_arrays([pa.concat_arrays(self.index[0]), *(pa.array(x, pa.int64()) for x in self.index[1:])], [n for n, _ in INDEX])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, index.schema) as w:
            w.write_batch(index)
        import zstandard

        packed = zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())
        self._put(packed + struct.pack("<Q", len(packed)) + MAGIC)
        self.out.close()
        return index, self.at


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", level: int = 3,
          file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode every text, append ``end_id``, and write the ids below ``folder`` in ascending id order.

    Returns the staged index ``(part, seq, file, id_col, offset, size, n_tokens)``, a row per document."""
    import zstandard

    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    raw = train_dictionary([s for s in _sample(docs, shared, id_col, text_col) if s], DICTIONARY_BYTES)
    words = docs.sparkSession.sparkContext.broadcast(raw)
    sha = hashlib.sha256(raw).digest()
    files, base = open_folder(folder)
    files.create_dir(base)
    with files.open_output_stream(f"{base}/{sha.hex()}.dict", compression=None) as f:
        f.write(raw)
    kind = dict(docs.dtypes)[id_col]
    arrow = to_arrow_type(docs.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, seq, out = _words(shared), TaskContext.get().partitionId(), 0, None
        end = known.pack([end_id])
        pack = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(words.value)) if words.value else zstandard.ZstdCompressor(level=level)

        def closed() -> Iterator[pa.RecordBatch]:
            index, _ = out.close()
            for a in range(0, index.num_rows, 4096):
                rows = index.slice(a, 4096)
                n = rows.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array([out.name] * n), *rows.columns],
                                                 ["part", "seq", "file", id_col, "offset", "size", "n_tokens"])

        for batch in batches:
            for rows in slices(batch, text_col, 1 << 20):
                for i, ids in enumerate(known.encode(t or "") for t in rows.column(text_col).to_pylist()):
                    if out is None:
                        out = Writer(folder, known.width, sha, arrow)
                    out.add(rows.column(id_col).slice(i, 1), pack.compress(ids + end), len(ids) // known.width + 1)
                    if out.at >= file_bytes or len(out.index[0]) >= FILE_DOCS:
                        yield from closed()
                        seq, out = seq + 1, None
        if out is not None:
            yield from closed()

    tie = F.xxhash64(text_col)
    ordered = docs.select(id_col, text_col, tie.alias("_tie")).repartitionByRange(id_col, "_tie").sortWithinPartitions(id_col, "_tie").drop("_tie")
    return stage(ordered.mapInArrow(frugal(run), f"part int, seq int, file string, `{id_col}` {kind}, offset long, size long, n_tokens long"), "tokens-index")


def file_list(index: DataFrame) -> DataFrame:
    """``(file, start)``: the files with the number of ids in all files before each.  The window runs over one row a file."""
    totals = index.groupBy("part", "seq", "file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))


class Reader:
    """One file: its index, and the ids of any of its documents."""

    def __init__(self, folder: str, name: str) -> None:
        import zstandard

        files, base = open_folder(folder)
        self.file = files.open_input_file(f"{base}/{name}")
        head = self.file.read_at(len(MAGIC) + 33, 0)
        foot = self.file.read_at(8 + len(MAGIC), self.file.size() - 8 - len(MAGIC))
        if head[:len(MAGIC)] != MAGIC or foot[8:] != MAGIC:
            raise ValueError(f"{name} is no whole file of tokens")
        self.width, sha = head[len(MAGIC)], head[len(MAGIC) + 1:]
        with files.open_input_file(f"{base}/{sha.hex()}.dict") as f:
            raw = f.read()
        if hashlib.sha256(raw).digest() != sha:
            raise ValueError(f"{name}: not the dictionary that it was written with")
        self.frames = zstandard.ZstdDecompressor(dict_data=_dictionary(raw)) if raw else zstandard.ZstdDecompressor()
        (size,) = struct.unpack("<Q", foot[:8])
        packed = self.file.read_at(size, self.file.size() - 8 - len(MAGIC) - size)
        self.index = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(packed)).read_all()

    def ids(self, offset: int, size: int) -> np.ndarray:
        return np.frombuffer(self.frames.decompress(self.file.read_at(size, offset)), f"<u{self.width}").astype("<u4")

    def close(self) -> None:
        self.file.close()


def read(folder: str, listed: DataFrame, id_col: str, kind: str, ids: bool = False) -> DataFrame:
    """``(id_col, start, n_tokens, ids_crc32[, ids])`` of every document of the listed files, from the files alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                f = Reader(folder, name)
                for part in f.index.to_batches(max_chunksize=1024):
                    crc, found, flat = [], [], []
                    for offset, size, n in zip(*(part.column(c).to_pylist() for c in ("offset", "size", "n_tokens"))):
                        got = f.ids(offset, size)
                        if len(got) != n:
                            raise ValueError(f"{name}: a document of {n} ids holds {len(got)}")
                        crc.append(zlib.crc32(got))
                        found.append(start)
                        start += n
                        if ids:
                            flat.append(got.astype(np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id"), pa.array(found, pa.int64()), part.column("n_tokens"), pa.array(crc, pa.int64()), *([pa.array(flat, pa.list_(pa.int64()))] if ids else [])],
                        [id_col, "start", "n_tokens", "ids_crc32", *(["ids"] if ids else [])])
                f.close()

    n = max(1, listed.count())
    return listed.repartition(n, "file").mapInArrow(
        frugal(run), f"`{id_col}` {kind}, start long, n_tokens long, ids_crc32 long{', ids array<long>' if ids else ''}")


def fetch(folder: str, index: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id_col, ids)`` of the wanted documents: only their frames are read, by the offset index."""
    kind = dict(index.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for batch in batches:
            flat = []
            for file, offset, size in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "size"))):
                if file != name:
                    if f is not None:
                        f.close()
                    name, f = file, Reader(folder, file)
                flat.append(f.ids(offset, size).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(flat, pa.list_(pa.int64()))], [id_col, "ids"])
        if f is not None:
            f.close()

    some = index.join(wanted.select(id_col).distinct(), id_col).repartition("file").sortWithinPartitions("file", "offset")
    return some.select(id_col, "file", "offset", "size").mapInArrow(run, f"`{id_col}` {kind}, ids array<long>")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id") -> DataFrame:
    """Write the documents, read the files back and return the digest columns of each document."""
    folder = new_folder(spark, "tokens")
    index = write(docs, folder, tokenizer_path, end_id, id_col)
    return read(folder, stage(file_list(index), "tokens-files"), id_col, dict(docs.dtypes)[id_col])
