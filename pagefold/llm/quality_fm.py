"""Quality classifier: a factorisation machine over hashed words, structure and size (operator 4).

score = sigmoid(b + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]); the
bracket is the sum of all pairwise products <v_i, v_j> x_i x_j, so scoring is linear in the
number of features of a text.  Features: hashed words of the whole text (L2 norm 1), structure
statistics of the whole text and its size, each cut into bins at quantiles of the training rows.

The model is fitted on the driver from a bounded sample of labelled rows (``MOST_ROWS``); scoring
is a map over all texts without a shuffle.  Language, source, id and labels are never features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.llm.common import frugal, slices
from pagefold.llm.text_features import N_STRUCTURE, hash_cache, held_out, in_batches, labelled_sample, structure, word_hash

#: Labelled rows to fit on, at most; hashed words; factors; bins of each statistic.
MOST_ROWS, WORDS, FACTORS, BINS = 8_000, 1 << 16, 8, 12
EPOCHS, BATCH, RATE, L2 = 8, 64, 0.08, 1e-5


def _words(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Per text: hashed words, their weights (norm 1); and the structure matrix."""
    known = hash_cache("quality", lambda w: [word_hash(w, WORDS)])
    idx, val, dense = [], [], np.zeros((len(texts), N_STRUCTURE), np.float32)
    for k, t in enumerate(texts):
        words = t.split()
        dense[k] = structure(t, words)
        i, n = np.unique(np.frombuffer(b"".join(map(known.__getitem__, words)), "<i4"), return_counts=True)
        x = np.log1p(n.astype(np.float32))
        idx.append(i)
        val.append(x / max(1e-6, float(np.sqrt((x * x).sum()))))
    return idx, val, dense


def _assemble(idx, val, dense, edges) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, values and the start of each text's run; every text has its bins, so no run is empty."""
    bins = np.stack([np.searchsorted(edges[s], dense[:, s]) + WORDS + s * BINS for s in range(dense.shape[1])], 1)
    flat = np.concatenate([np.concatenate((i, b)) for i, b in zip(idx, bins)])
    x = np.concatenate([np.concatenate((v, np.full(bins.shape[1], 0.25, np.float32))) for v in val])
    sizes = np.array([len(i) + bins.shape[1] for i in idx])
    return flat, x, np.concatenate(([0], np.cumsum(sizes)[:-1]))


def _margin(model: dict, flat, x, starts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = model["v"][flat] * x[:, None]
    sums = np.add.reduceat(v, starts)
    pairs = 0.5 * (sums * sums - np.add.reduceat(v * v, starts)).sum(1)
    return model["b"] + np.add.reduceat(model["w"][flat] * x, starts) + pairs, sums, v


def fit(idx, val, dense, y, seed: int = 7) -> dict:
    """AdaGrad on the logistic loss, in small batches; one class alone gives its smoothed share as a constant."""
    y = np.asarray(y, np.float32)
    model = {"edges": [np.zeros(0)] * N_STRUCTURE, "w": np.zeros(WORDS + N_STRUCTURE * BINS, np.float32),
             "v": np.zeros((WORDS + N_STRUCTURE * BINS, FACTORS), np.float32),
             "b": float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))}
    if len(y) == 0 or y.min() == y.max():
        return model
    rng = np.random.default_rng(seed)
    model["edges"] = [np.quantile(dense[:, s], np.linspace(0, 1, BINS + 1)[1:-1]) for s in range(N_STRUCTURE)]
    model["v"] = rng.normal(0, 0.05, model["v"].shape).astype(np.float32)
    seen_w, seen_v, seen_b = np.full(model["w"].shape, 1e-4, np.float32), np.full(model["v"].shape, 1e-4, np.float32), 1e-4
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for a in range(0, len(y), BATCH):
            part = order[a:a + BATCH]
            flat, x, starts = _assemble([idx[i] for i in part], [val[i] for i in part], dense[part], model["edges"])
            z, sums, v = _margin(model, flat, x, starts)
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]
            rows = np.repeat(np.arange(len(part)), np.diff(np.append(starts, len(flat))))
            gx = (g[rows] * x).astype(np.float32)
            uniq, inverse = np.unique(flat, return_inverse=True)
            gw = np.bincount(inverse, gx, len(uniq)) / len(part) + L2 * model["w"][uniq]
            each = gx[:, None] * (sums[rows] - v)
            gv = np.stack([np.bincount(inverse, each[:, f], len(uniq)) for f in range(FACTORS)], 1) / len(part) + L2 * model["v"][uniq]
            seen_w[uniq] += gw * gw
            seen_v[uniq] += gv * gv
            seen_b += float(g.mean()) ** 2
            model["w"][uniq] -= RATE * gw / np.sqrt(seen_w[uniq])
            model["v"][uniq] -= RATE * gv / np.sqrt(seen_v[uniq])
            model["b"] -= RATE * float(g.mean()) / np.sqrt(seen_b)
    return model


def train(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_remainder: int = 1, most: int = MOST_ROWS) -> dict:
    """Fit on the texts of a bounded sample of the labelled rows outside the held-out fold."""
    sample, _, _ = labelled_sample(labels, "quality", modulus, held_remainder, most)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def work(state, part: pa.RecordBatch, whole: list[str]) -> pa.RecordBatch:
        idx, val, dense = _words(whole)
        return pa.RecordBatch.from_arrays(
            [part.column("label"), pa.array([i.tobytes() for i in idx], pa.binary()),
             pa.array([v.tobytes() for v in val], pa.binary()), pa.array([d.tobytes() for d in dense], pa.binary())],
            ["label", "idx", "val", "dense"])

    rows = in_batches(texts, "doc_id", "text", "label int, idx binary, val binary, dense binary",
                      [F.col("label").cast("int").alias("label")], work).toArrow().sort_by([("label", "ascending"), ("idx", "ascending")])
    of = lambda c, t: [np.frombuffer(x, t) for x in rows[c].to_pylist()]
    dense = np.array(of("dense", "<f4")).reshape(-1, N_STRUCTURE)
    return fit(of("idx", "<i4"), of("val", "<f4"), dense, rows["label"].to_numpy())


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, score)`` of every whole text: the model's belief that its label is 1.

    Null and empty texts have no words and are scored by their bins alone; repeated rows are each
    scored; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(state, part: pa.RecordBatch, whole: list[str]) -> pa.RecordBatch:
        z, _, _ = _margin(shared.value, *_assemble(*_words(whole), shared.value["edges"]))
        return pa.RecordBatch.from_arrays([part.column(id_col), pa.array((1 / (1 + np.exp(-z.astype(np.float64)))), pa.float64())],
                                          [id_col, "score"])

    kind = dict(docs.dtypes)[id_col]
    return in_batches(docs, id_col, text_col, f"`{id_col}` {kind}, score double", [], work)


def accepted(docs: DataFrame, model: dict, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they were, whose whole text scores ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                z, _, _ = _margin(shared.value, *_assemble(*_words([t or "" for t in part.column(text_col).to_pylist()]), shared.value["edges"]))
                yield part.filter(pa.array(1 / (1 + np.exp(-z.astype(np.float64))) >= least))

    return docs.mapInArrow(frugal(run), docs.schema)


def predict(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_remainder: int = 1) -> DataFrame:
    """Per document: held_out, score, predicted (1 from a score of 0.5)."""
    scored = score(docs, train(docs, labels, modulus, held_remainder))
    return scored.select("doc_id", held_out("doc_id", modulus, held_remainder).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
