"""Best-fit packing by exact-complement hashing, planned on the histogram of piece lengths.

Documents become pieces of at most `seq_len` ids. How many pieces there are of each length is a table of at
most seq_len rows, so the plan is made from it alone, whatever the number of documents: for the longest
length left, its gap is looked up in hash tables of single lengths, of pair sums and (through them) of triple
sums; a combination that fills the gap exactly is consumed as often as availability allows; where none
exists, the longest length that fits is added and the smaller gap is looked up again (best fit). Pieces then
take their places by their rank within their length.

Null text is an empty document (its end id only); a null doc_id stays null; repeated rows are packed each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bpe, common

PLAN = "length int, lo long, hi long, per int, seq long, at int"


class Sums:
    """Hash tables of the sums of two and of three lengths, over lengths that run out but never come back.

    pairs[s] lists the longer lengths of the pairs with sum s, triples[s] the longest ones of the triples; both fall, and
    a mark in each passes what has run out once and for all, so that a look-up needs no search.
    """

    def __init__(self, lengths: list[int], seq_len: int, left: dict[int, int]):
        self.left = left
        self.pairs: dict[int, list[int]] = {}
        self.triples: dict[int, list[int]] = {}
        self.at2: Counter = Counter()
        self.at3: Counter = Counter()
        falling = np.array(sorted(lengths, reverse=True), np.int64)
        there = np.zeros(seq_len + 1, bool)
        there[falling] = True
        for s in range(2, seq_len + 1):
            a = falling[(2 * falling >= s) & (falling < s)]
            if len(a := a[there[s - a]]):
                self.pairs[s] = a.tolist()
        has_pair = np.zeros(seq_len + 1, bool)
        has_pair[np.array(list(self.pairs), np.int64)] = True
        for s in range(3, seq_len + 1):
            a = falling[(3 * falling >= s) & (falling < s - 1)]
            if len(a := a[has_pair[s - a]]):
                self.triples[s] = a.tolist()

    def pair(self, s: int, used: Counter, most: int | None = None) -> tuple[int, int] | None:
        """The pair of available lengths with sum s whose longer one is longest; `used`: what the block being built has taken."""
        found, left = self.pairs.get(s), self.left
        if not found:
            return None
        k = self.at2[s]
        while k < len(found) and (not left.get(found[k]) or not left.get(s - found[k])):
            k += 1
        self.at2[s] = k
        for a in found[k:] if k else found:
            b = s - a
            if most is not None and a > most:
                continue
            if left.get(a, 0) - used[a] > 0 and left.get(b, 0) - used[b] - (a == b) > 0:
                return a, b
        return None

    def triple(self, s: int, used: Counter) -> tuple[int, int, int] | None:
        found, left = self.triples.get(s), self.left
        if not found:
            return None
        k = self.at3[s]
        while k < len(found) and (not left.get(found[k]) or not self._ever(s - found[k])):
            k += 1
        self.at3[s] = k
        for a in found[k:] if k else found:
            if left.get(a, 0) - used[a] > 0:
                used[a] += 1
                rest = self.pair(s - a, used, a)
                used[a] -= 1
                if rest:
                    return a, *rest
        return None

    def _ever(self, s: int) -> bool:
        """Whether any pair with this sum is left at all."""
        found = self.pairs.get(s)
        if not found:
            return False
        k, left = self.at2[s], self.left
        while k < len(found) and (not left.get(found[k]) or not left.get(s - found[k])):
            k += 1
        self.at2[s] = k
        return k < len(found)

    def fill(self, gap: int, used: Counter) -> tuple[int, ...] | None:
        """Lengths that fill a gap exactly: one, else two, else three."""
        if self.left.get(gap, 0) - used[gap] > 0:
            return (gap,)
        return self.pair(gap, used) or self.triple(gap, used)


def plan(counts: dict[int, int], seq_len: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, lo, hi, per, seq, at): pieces of `length` with ranks lo..hi-1 go, `per` to a sequence, to
    sequences seq, seq+1, ... from offset `at` on.

    Every block of equal sequences uses up at least one length, so there are at most seq_len blocks, each of
    at most about sqrt(2 * seq_len) different lengths.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    sums = Sums(list(left), seq_len, left)
    falling = sorted(left, reverse=True)
    placed: Counter = Counter()
    rows, seq = [], 0
    while left:
        top = max(left)
        used, gap = Counter({top: 1}), seq_len - top
        while gap:
            take = sums.fill(gap, used)
            if take is None:  # no exact complement: best fit, and the smaller gap is looked up again
                take = next(((n,) for n in falling if n <= gap and left.get(n, 0) - used[n] > 0), None)
                if take is None:
                    break
            for n in take:
                used[n] += 1
                gap -= n
        times = min(left[n] // k for n, k in used.items() if k)
        at = 0
        for n, k in used.items():
            if not k:
                continue
            rows.append((n, placed[n], placed[n] + k * times, k, seq, at))
            at += n * k
            placed[n] += k * times
            left[n] -= k * times
            if not left[n]:
                del left[n]
                falling.remove(n)
        seq += times
    return rows


def pieces(docs: DataFrame, tokenizer: str, end_id: int, seq_len: int, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, task, nth (rank of the piece among those of its length and task) and,
    if asked for, ids (little-endian uint32)."""
    common.tune(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))

    def encode(batches):
        enc, end, seen, task = bpe.encoder(tokenizer), np.array([end_id], "<u4").tobytes(), Counter(), TaskContext.get().partitionId()
        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = enc.encode(t) + end
                for k, i in enumerate(range(0, len(ids), 4 * seq_len)):
                    part = ids[i : i + 4 * seq_len]
                    n = len(part) // 4
                    rows.append((d, k, i // 4, n, zlib.crc32(part), task, seen[n], part if keep_ids else None))
                    seen[n] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", "ids"])

    return src.mapInArrow(encode, "doc_id long, piece int, start long, length int, ids_crc32 long, task int, nth long, ids binary")


def pack(cut: DataFrame, seq_len: int) -> DataFrame:
    """Adds sequence_id and offset to what pieces() gave. `cut` must be a written table (its task and nth are read twice)."""
    spark = cut.sparkSession
    sizes = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    sizes = common.staged(sizes, "lengths")
    counts = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("n")).collect()}  # at most seq_len rows
    rows = plan(counts, seq_len)
    places = spark.createDataFrame(rows, PLAN) if rows else common.empty(spark, PLAN)
    base = sizes.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).drop("n")
    ranked = cut.join(base, ["task", "length"]).withColumn("rank", F.col("base") + F.col("nth")).drop("base")
    # the plan's size depends on seq_len alone (see plan), so it may be broadcast at any input size
    out = ranked.join(F.broadcast(places), (ranked["length"] == places["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).drop(places["length"])
    k = F.col("rank") - F.col("lo")
    return (
        out.withColumn("sequence_id", F.col("seq") + F.expr("(rank - lo) div per"))
        .withColumn("offset", F.col("at") + (k % F.col("per")) * F.col("length"))
        .select("doc_id", F.col("piece").cast("int"), "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"), "ids")
    )


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (array<int>) of each packed sequence; needs pieces(keep_ids=True)."""

    def join(pdf):
        import pandas as pd

        pdf = pdf.sort_values("offset")
        ids = np.frombuffer(b"".join(pdf["ids"]), "<u4").astype(np.int32)
        return pd.DataFrame({"sequence_id": [pdf["sequence_id"].iloc[0]], "ids": [ids]})

    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInPandas(join, "sequence_id long, ids array<int>")


def best_fit_packing(docs: DataFrame, tokenizer: str, end_id: int = 0, seq_len: int = 2048, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (tokens before it in its sequence), ids."""
    return pack(common.staged(pieces(docs, tokenizer, end_id, seq_len, keep_ids), "pieces"), seq_len)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_packing(common.read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")
