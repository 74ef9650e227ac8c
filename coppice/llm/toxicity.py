"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of itself and its character n-grams (3 to 5, with word ends marked), hashed into buckets that
each have an embedding; a text is the average over all its words' bags. As the softmax of two classes sees only
the difference of its rows, a trained bucket comes down to one number, a word to a sum of these, and a text to
a ratio of two sums over all its words. Unseen misspellings and forms share most n-grams with known ones.

Training takes at most `per_class` labelled documents of each class (a documented bound; smaller tables are
used whole); the bias is shifted back to the classes' true shares. A text without words gets the score that the
shares alone give. Null text counts as empty; a null doc_id is scored like any other and is not held out;
repeated rows are scored each; without labels of both classes the score is the share of label 1 (0.0 without
labels); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS, SHORT, LONG = 1 << 17, 3, 5
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() or c == 39 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of letters, digits, apostrophes and non-ASCII characters, A-Z in lower case."""
    return (text or "").encode("utf-8", "replace").translate(_PLAIN).split()


def grams(word: bytes) -> np.ndarray:
    """Buckets of a word: itself and its character n-grams."""
    w = "<" + word.decode("utf-8", "replace") + ">"
    parts = [w] + [w[i : i + n] for n in range(SHORT, LONG + 1) for i in range(len(w) - n + 1)]
    return np.fromiter((zlib.crc32(p.encode()) % BUCKETS for p in parts), np.int64, len(parts))


class Model:
    """weights: each bucket's share of the margin; bias: log odds of label 1 without any words."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.known = weights, bias, {}

    def _word(self, w: bytes) -> tuple[float, int]:
        g = grams(w)
        return float(self.weights[g].sum(dtype=np.float64)), len(g)

    def margins(self, texts: list[str | None]) -> np.ndarray:
        known, out = self.known, np.full(len(texts), self.bias)
        for t, text in enumerate(texts):
            found = words(text)
            if not found:
                continue
            got = list(map(known.get, found))
            missing = [i for i, v in enumerate(got) if v is None]
            if missing:
                if len(known) > 300_000:
                    known.clear()
                for i in missing:
                    got[i] = known[found[i]] = self._word(found[i])
            total = np.array(got)
            out[t] += total[:, 0].sum() / total[:, 1].sum()
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(texts), -60, 60)))


def fit(bags: list[tuple[list[bytes], list[int]]], labels: np.ndarray, prior: float, dim: int = 4, rounds: int = 40, rate: float = 0.1, decay: float = 1e-6, min_texts: int = 1, seed: int = 7) -> Model:
    """Joint training of embeddings and softmax by Adam on mini-batches of (words, counts) bags."""
    rng = np.random.default_rng(seed)
    index: dict[bytes, int] = {}
    docs = [(np.array([index.setdefault(w, len(index)) for w in ws]), np.array(cs, np.float32)) for ws, cs in bags]
    spelled = [grams(w) for w in index]
    full = np.array([len(g) for g in spelled])
    totals = np.array([(full[ids] * cs).sum() for ids, cs in docs])
    # buckets that fewer training texts have, and all that none has, keep the weight 0
    held = np.zeros(BUCKETS, np.int64)
    for ids, _ in docs:
        held[np.unique(np.concatenate([spelled[i] for i in ids]))] += 1
    live = held >= min_texts
    spelled = [g[live[g]] for g in spelled]
    sizes = np.array([len(g) for g in spelled])
    docs = [(ids[sizes[ids] > 0], cs[sizes[ids] > 0]) for ids, cs in docs]
    flat, starts = np.concatenate(spelled), np.concatenate([[0], np.cumsum(sizes)])
    e = (rng.normal(0, 0.02, (BUCKETS, dim)) * live[:, None]).astype(np.float32)
    w = rng.normal(0, 0.5, (dim, 2)).astype(np.float32)
    b = np.zeros(2, np.float32)
    scale = 60.0  # the averages are small: a few words in a hundred decide
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in (("e", e), ("w", w), ("b", b))}
    weight = np.where(labels == 1, 0.5 / max((labels == 1).mean(), 1e-9), 0.5 / max((labels == 0).mean(), 1e-9)).astype(np.float32)
    step = 0

    batches = max(1, -(-len(docs) // 64))
    place = np.zeros(max(BUCKETS, len(index)), np.int64)

    def unique(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values in order and where each of x is among them, without sorting."""
        there = np.zeros(size, bool)
        there[x] = True
        found = np.flatnonzero(there)
        place[found] = np.arange(len(found))
        return found, place[x]

    def adam(name, value, grad, rows=None):
        m, v = state[name]
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.99 * v[at] + 0.01 * grad * grad
        value[at] -= rate * (1 - (step - 1) / (rounds * batches)) * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.99**step)) + 1e-6)

    for _ in range(rounds):
        for part in np.array_split(rng.permutation(len(docs)), batches):
            step += 1
            ids = np.concatenate([docs[i][0] for i in part])
            cnt = np.concatenate([docs[i][1] for i in part])
            row = np.repeat(np.arange(len(part)), [len(docs[i][0]) for i in part])
            if not len(ids):
                continue
            uniq, inv = unique(ids, len(index))
            lens = sizes[uniq]
            own = np.repeat(starts[uniq] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
            g = flat[own]
            v = np.add.reduceat(e[g], np.cumsum(lens) - lens, axis=0)
            share = (cnt * scale / totals[part][row]).astype(np.float32)
            h = np.stack([np.bincount(row, share * v[inv, k], len(part)) for k in range(dim)], axis=1).astype(np.float32)
            z = h @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            d = (p - np.eye(2, dtype=np.float32)[labels[part]]) * weight[part][:, None] / len(part)
            dh = d @ w.T
            dv = np.stack([np.bincount(inv, share * dh[row, k], len(uniq)) for k in range(dim)], axis=1)
            rows, back = unique(g, BUCKETS)
            spread = np.repeat(dv, lens, axis=0)
            de = np.stack([np.bincount(back, spread[:, k], len(rows)) for k in range(dim)], axis=1).astype(np.float32)
            adam("e", e, de + decay * e[rows], rows)
            adam("w", w, h.T @ d + 1e-4 * w)
            adam("b", b, d.sum(axis=0))
    shift = np.log(prior / (1 - prior))  # the loss weighs both classes alike
    return Model((scale * (e @ (w[:, 1] - w[:, 0]))).astype(np.float32), float(b[1] - b[0] + shift))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2500, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from labels (doc_id, toxic) and the documents that they name."""
    sample, sizes = common.labelled_sample(docs, labels, "toxic", per_class, [0, 1], id_col, text_col)
    common.tune(docs.sparkSession)

    def bags(batches):
        for b in batches:
            ws, cs = [], []
            for t in b.column(1).to_pylist():
                u, c = np.unique(np.array(words(t), object), return_counts=True) if words(t) else ([], [])
                ws.append(list(u))
                cs.append(list(c))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ws, pa.list_(pa.binary())), pa.array(cs, pa.list_(pa.int32()))], names=["label", "words", "counts"])

    got = sample.select("label", "text", "doc_id").orderBy("doc_id").select("label", "text").mapInArrow(bags, "label int, words array<binary>, counts array<int>").toArrow()
    rows = [(x["label"], x["words"], x["counts"]) for x in got.to_pylist() if x["words"]]
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if len({r[0] for r in rows}) < 2:
        share = n1 / (n0 + n1) if n0 + n1 else 0.0
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))) if 0 < share < 1 else 60.0 if share else -60.0)
    return fit([(r[1], r[2]) for r in rows], np.array([r[0] for r in rows]), n1 / (n0 + n1))


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted for every row; the model (half a MB) travels by broadcast."""
    common.tune(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def apply(batches):
        m = Model(*sent.value)
        for b in batches:
            s = m.scores(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(apply, "doc_id long, score double, predicted int")


def held_out(doc_id) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_toxicity_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    model = train(docs, common.read_table(spark, sf_dir, "labels").where(~held_out("doc_id")))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
