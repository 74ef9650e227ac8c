"""Quality: ordinal cumulative-link (proportional odds) regression on graded ratings over hashed text.

A text becomes hashed features of all its words: the words, their shapes (runs of letters, capitals, digits and
of each other sign), words that repeat the one before, and five-word runs that the text had before; values
are square roots of shares, so a text's length doesn't matter. One weight vector serves all grades; P(grade <= k) is
sigmoid(threshold_k - x.w) with ordered thresholds. Results are the expected grade and the probability of a
grade of at least `good`.

Training takes at most `per_class` labelled documents of each grade (a documented bound; smaller tables are
used whole) and weighs grades alike. Null and empty texts have no features and get what the thresholds alone
give; null ids are scored like any other; repeated rows are scored each; without labels of two grades every
text gets the only grade known (or the best) and is kept; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common, shingles

SIZE = 1 << 14
_RUNS = [(re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]{2,}"), b"AA"), (re.compile(rb"[0-9]+"), b"0"), (re.compile(rb"(.)\1+"), rb"\1\1")]
_slots: dict[bytes, int] = {}


def _slot(word: bytes) -> int:
    """Two hashed features in one number: the word's and its shape's."""
    shape = word
    for pattern, to in _RUNS:
        shape = pattern.sub(to, shape)
    return zlib.crc32(b"w" + word.lower()) % SIZE << 32 | zlib.crc32(b"s" + shape[:12]) % SIZE


def forget() -> None:
    """Drops the remembered slots; tasks are sent this function by its name, and with it the module's own table."""
    _slots.clear()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text."""
    found = (text or "").encode("utf-8", "replace").split()
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    got = list(map(_slots.get, found))
    missing = [i for i, v in enumerate(got) if v is None]
    if missing:
        if len(_slots) > 400_000:
            _slots.clear()
        for i in missing:
            got[i] = _slots[found[i]] = _slot(found[i])
    both = np.array(got, np.int64)
    word, shape = both >> 32, both & 0xFFFFFFFF
    n = len(found)
    counts = np.bincount(np.concatenate([word, shape]), minlength=SIZE)
    slots = np.flatnonzero(counts)
    values = np.sqrt(counts[slots] / n)
    again = int((both[1:] == both[:-1]).sum())
    runs = shingles.windows(both.astype(np.uint64), 5)
    seen = len(runs) - len(np.unique(runs))
    # each share also by its size class, so that a little of it may weigh unlike much of it
    extra = [(f"again{min(9, int(10 * again / n))}", (again / n) ** 0.5), (f"runs{min(9, int(10 * seen / n))}", (seen / n) ** 0.5), ("again", (again / n) ** 0.5), ("runs", (seen / n) ** 0.5)]
    more = [(zlib.crc32(k.encode()) % SIZE, v) for k, v in extra if v > 0]
    return np.concatenate([slots, np.array([k for k, _ in more], np.int64)]), np.concatenate([values, [v for _, v in more]]).astype(np.float32)


class Model:
    """weights, ordered thresholds and the grades they part."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, grades: list[int]):
        self.weights, self.thresholds, self.grades = weights, thresholds, grades

    def tails(self, texts: list[str | None]) -> np.ndarray:
        """P(grade >= grades[k]) for k = 1, 2, ... of each text."""
        z = np.array([float(self.weights[f] @ v) for f, v in map(features, texts)])
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -60, 60)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], ratings: np.ndarray, rounds: int = 300, rate: float = 0.1, decay: float = 1e-4) -> Model:
    """Maximum likelihood by Adam; thresholds are a first one and positive steps, so they stay ordered."""
    grades = sorted(set(ratings.tolist()))
    y = np.searchsorted(grades, ratings)
    k = len(grades) - 1
    ids = np.concatenate([f for f, _ in rows])
    vals = np.concatenate([v for _, v in rows]).astype(np.float64)
    row = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    weight = 1 / (np.bincount(y)[y] * len(grades))
    params = np.zeros(SIZE + k)
    params[SIZE:] = 0.0
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        w, first, steps = params[:SIZE], params[SIZE], np.exp(params[SIZE + 1 :])
        cut = np.concatenate([[-np.inf], first + np.concatenate([[0], np.cumsum(steps)]), [np.inf]])
        z = np.bincount(row, vals * w[ids], len(rows))
        hi, lo = 1 / (1 + np.exp(np.clip(z - cut[y + 1], -60, 60))), 1 / (1 + np.exp(np.clip(z - cut[y], -60, 60)))
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / p * weight, lo * (1 - lo) / p * weight  # of log likelihood by the two cuts
        grad = np.empty_like(params)
        grad[:SIZE] = np.bincount(ids, vals * (dhi - dlo)[row], SIZE) + decay * w
        by_cut = np.bincount(y, -dhi, k + 1)[:k] + np.bincount(y, dlo, k + 1)[1:]
        grad[SIZE] = by_cut.sum()
        grad[SIZE + 1 :] = steps * np.cumsum(by_cut[::-1])[::-1][1:]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        params -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    steps = np.exp(params[SIZE + 1 :])
    return Model(params[:SIZE].copy(), params[SIZE] + np.concatenate([[0], np.cumsum(steps)]), grades)


def train(docs: DataFrame, labels: DataFrame, rating: str = "quality", per_class: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from graded ratings (doc_id, rating) and the documents that they name; a rating has at most 20 grades."""
    grades = sorted(r[0] for r in labels.where(f"{rating} IS NOT NULL").selectExpr(f"cast({rating} AS int)").distinct().limit(21).collect())
    if len(grades) > 20:
        raise ValueError("more than 20 grades")
    if len(grades) < 2:
        return Model(np.zeros(SIZE), np.full(len(grades) - 1 if grades else 0, -60.0), grades or [1])
    sample, _ = common.labelled_sample(docs, labels, rating, per_class, grades, id_col, text_col)
    common.tune(docs.sparkSession)

    def bags(batches):
        common.take_turn("quality", forget)
        for b in batches:
            got = [features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f for f, _ in got], pa.list_(pa.int32())), pa.array([v for _, v in got], pa.list_(pa.float32()))], names=["label", "slots", "vals"])

    got = sample.select("label", "text", "doc_id").orderBy("doc_id").select("label", "text").mapInArrow(bags, "label int, slots array<int>, vals array<float>").toArrow()
    slots, vals = got.column("slots").combine_chunks(), got.column("vals").combine_chunks()
    rows = [(np.asarray(s.values), np.asarray(v.values)) for s, v in zip(slots, vals, strict=True)]
    ratings = np.array(got.column("label").to_pylist())
    if len(set(ratings.tolist())) < 2:
        return Model(np.zeros(SIZE), np.full(0, -60.0), grades[-1:])
    return fit(rows, ratings)


def score(docs: DataFrame, model: Model, good: int = 1, least: float = 0.5, extra: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade, tail_probability (of a grade >= good), kept (tail_probability >= least) for every row,
    and the columns named in `extra`. The model (128 KB) travels by broadcast."""
    common.tune(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds, model.grades))
    extra = extra or []

    def apply(batches):
        common.take_turn("quality", forget)
        m = Model(*sent.value)
        steps = np.diff(np.array(m.grades, np.float64))
        at = next((k for k, g in enumerate(m.grades) if g >= good), len(m.grades))
        for b in batches:
            t = m.tails(b.column(1).to_pylist())
            grade = m.grades[0] + t @ steps
            tail = np.ones(len(t)) if at == 0 else t[:, at - 1] if at < len(m.grades) else np.zeros(len(t))
            out = [b.column(0), pa.array(grade, pa.float64()), pa.array(tail, pa.float64()), pa.array(tail >= least)]
            yield pa.RecordBatch.from_arrays(out + [b.column(k + 2) for k in range(len(extra))], names=["doc_id", "expected_grade", "tail_probability", "kept", *extra])

    src = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("graded"), *[docs[c] for c in extra])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[2:])
    return src.mapInArrow(apply, "doc_id long, expected_grade double, tail_probability double, kept boolean" + (", " + kinds if kinds else ""))


def op9_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    return score(docs, train(docs, common.read_table(spark, sf_dir, "labels")))
