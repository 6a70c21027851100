"""Toxicity by non-negative positive-unlabelled learning (operator 10).

Confirmed toxic texts (P) and texts of which nothing is assumed (U) train linear classifiers on
the estimator  pi R_P(+) + max(0, R_U(-) - pi R_P(-)):  the prior pi corrects the risk of
treating U as negative, and once the bracket turns negative the step goes the other way, so that
the model can't win by fitting P's share of U.  Features are the words of the whole text and
their beginnings (present or not); those that P doesn't hold more often than U get no weight, so
a long clean text doesn't gather a score from chance.  The score is the mean of ``MODELS`` runs.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.llm.common import stage
from pagefold.llm.text_features import hash_cache, held_out, in_batches, labelled_sample, word_hash

#: Toxic texts and unlabelled texts to fit on, at most; hashed features; classifiers.
MOST_TOXIC, MOST_UNLABELLED, FEATURES, MODELS = 4_000, 8_000, 1 << 20, 3
#: A feature counts when it is in so many toxic texts and so many times as frequent there as in U.
LEAST_TEXTS, LEAST_LIFT = 5, 3.0
#: Bytes of features that the fit takes in all, about: of more, a share of the texts is taken.
MOST_BYTES = 256 << 20
STEPS, BATCH, RATE, L2 = 2_500, 256, 0.1, 1e-5
WORD = re.compile(r"\w+")


def _numbers(word: str) -> list[int]:
    """A word and its beginnings of 3 to 6 characters, whatever the case and the marks around it."""
    out = []
    for w in WORD.findall(word.lower()):
        out.append(word_hash(w, FEATURES))
        out += [word_hash(w[:n], FEATURES, n) for n in (3, 4, 5, 6) if len(w) > n]
    return out


def features(texts: list[str]) -> list[np.ndarray]:
    known = hash_cache("toxicity", _numbers)
    return [np.unique(np.frombuffer(b"".join(map(known.__getitem__, set(t.split()))), "<i4")) for t in texts]


def fit(toxic: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, models: int = MODELS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (models x FEATURES, last one the intercept); without toxic texts every score is 0."""
    weights = np.zeros((models, FEATURES + 1), np.float32)
    weights[:, -1] = -50.0
    if not toxic or not unlabelled or not 0 < prior < 1:
        return weights
    in_p = np.bincount(np.concatenate(toxic), minlength=FEATURES)
    in_u = np.bincount(np.concatenate(unlabelled), minlength=FEATURES)
    lift = (in_p / len(toxic)) / ((in_u + 1) / len(unlabelled))
    kept = np.flatnonzero((in_p >= LEAST_TEXTS) & (lift >= LEAST_LIFT))
    number = np.full(FEATURES, -1, np.int64)
    number[kept] = np.arange(len(kept))

    def rows(texts):  # one flat array of kept features, where each text's begin, and how many they are
        own = [number[t][number[t] >= 0].astype(np.int32) for t in texts]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        return np.concatenate(own), np.cumsum(sizes) - sizes, sizes

    def take(csr, some):  # the features of some texts, and the text of each
        flat, begins, sizes = csr
        n = sizes[some]
        ends = np.cumsum(n)
        return flat[np.arange(ends[-1]) + np.repeat(begins[some] - ends + n, n)], np.repeat(np.arange(len(some)), n)

    p, u = rows(toxic), rows(unlabelled)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for m in range(models):
        rng = np.random.default_rng(100 + m)
        w, b = np.zeros(len(kept)), float(np.log(prior / (1 - prior)))
        seen_w, seen_b = np.full(w.shape, 1e-3), 1e-3
        order = rng.permutation(len(unlabelled))
        for step in range(STEPS):
            a = step * BATCH % len(order)
            if step and a < BATCH:
                order = rng.permutation(len(order))
            some_u, some_p = order[a:a + BATCH], rng.integers(0, len(toxic), BATCH)
            (xu, of_u), (xp, of_p) = take(u, some_u), take(p, some_p)
            sp, su = sigmoid(np.bincount(of_p, w[xp], len(some_p)) + b), sigmoid(np.bincount(of_u, w[xu], len(some_u)) + b)
            # sigmoid loss: bounded, as the estimator asks; d/dz of sigmoid is s (1 - s)
            negative = su.mean() - prior * sp.mean()
            dp, du = sp * (1 - sp) / len(sp), su * (1 - su) / len(su)
            if negative >= 0:
                gp, gu = -2 * prior * dp, du
            else:
                gp, gu = prior * dp, -du
            g = np.bincount(xp, gp[of_p], len(w)) + np.bincount(xu, gu[of_u], len(w)) + L2 * w
            gb = float(gp.sum() + gu.sum())
            seen_w += g * g
            seen_b += gb * gb
            w -= RATE * g / np.sqrt(seen_w)
            b -= RATE * gb / np.sqrt(seen_b)
        weights[m, kept], weights[m, -1] = w, b
    return weights


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_remainder: int = 0, label: str = "toxic") -> np.ndarray:
    """Fit on bounded samples: of the rows confirmed toxic outside the held-out fold, and of all texts
    outside it whatever their label (the unlabelled side).  The prior is the labelled rows' share."""
    rows, n0, n1 = labelled_sample(labels, label, modulus, held_remainder, 1 << 62)
    part = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20))
    toxic = rows.filter("label = 1").filter(part < int((1 << 20) * min(1, MOST_TOXIC / max(1, n1)))).select("doc_id")
    total = docs.count()
    other = docs.select("doc_id", "text").filter(~held_out("doc_id", modulus, held_remainder)).filter(
        F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < int((1 << 20) * min(1, MOST_UNLABELLED / max(1, total))))
    texts = (docs.select("doc_id", "text").join(F.broadcast(toxic), "doc_id").withColumn("known", F.lit(True))
             .unionAll(other.withColumn("known", F.lit(False))))

    def work(state, part: pa.RecordBatch, whole: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column("known"), pa.array([x.tobytes() for x in features(whole)], pa.binary())],
                                      ["known", "idx"])

    found = stage(in_batches(texts, "doc_id", "text", "known boolean, idx binary", ["known"], work), "toxicity-sample")
    size = found.agg(F.sum(F.octet_length("idx"))).first()[0] or 0
    if size > MOST_BYTES:  # very long texts: a share of the sampled texts, chosen by a hash of their features
        found = found.filter(F.pmod(F.xxhash64("idx", F.lit(7)), F.lit(1 << 20)) < int((1 << 20) * MOST_BYTES / size))
    found = found.toArrow().sort_by([("known", "ascending"), ("idx", "ascending")])
    known, idx = found["known"].to_pylist(), [np.frombuffer(x, "<i4") for x in found["idx"].to_pylist()]
    return fit([x for x, k in zip(idx, known) if k], [x for x, k in zip(idx, known) if not k], n1 / max(1, n0 + n1))


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, score)`` of every whole text: the mean belief that it is toxic.

    Null and empty texts have no features and get the intercept's score; repeated rows are each
    scored; other columns are ignored.
    """
    kept = np.flatnonzero((weights[:, :-1] != 0).any(0))
    shared = docs.sparkSession.sparkContext.broadcast(
        (kept.astype(np.int32), np.concatenate((np.zeros((len(weights), 1), np.float32), weights[:, kept]), 1), weights[:, -1]))

    def work(state, part: pa.RecordBatch, whole: list[str]) -> pa.RecordBatch:
        if "table" not in state:
            state["table"] = np.zeros(FEATURES, np.int32)
            state["table"][shared.value[0]] = np.arange(1, len(shared.value[0]) + 1)
        _, w, b = shared.value
        out = []
        for x in features(whole):
            z = w[:, state["table"][x]].sum(1) + b
            out.append(float((1 / (1 + np.exp(-np.clip(z.astype(np.float64), -60, 60)))).mean()))
        return pa.RecordBatch.from_arrays([part.column(id_col), pa.array(out, pa.float64())], [id_col, "score"])

    kind = dict(docs.dtypes)[id_col]
    return in_batches(docs, id_col, text_col, f"`{id_col}` {kind}, score double", [], work)


def predict(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_remainder: int = 0) -> DataFrame:
    """Per document: held_out, score, predicted (1 from a score of 0.5)."""
    scored = score(docs, train(docs, labels, modulus, held_remainder))
    return scored.select("doc_id", held_out("doc_id", modulus, held_remainder).alias("held_out"), "score",
                     F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
