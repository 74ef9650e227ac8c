"""Near-duplicate documents by b-bit MinHash.

1. Each text gets, from its distinct five-word shingles, 32 band keys (six minima each) and a packed signature:
   the shingles are dealt into 1024 bins by one permutation and of every bin's minimum four low bits are kept
   (0: empty bin). Equal word sequences are collapsed first.
2. Star round: in each band bucket every text is paired with the bucket's smallest id, which is linear in the
   bucket. Pairs whose estimated similarity (bit counts of the signatures, corrected for chance collisions) is
   not far below the threshold are confirmed on the full shingle sets. Confirmed links give components.
3. Rest round: only buckets that still hold several components are looked at again; there, texts of different
   components are compared by signature in blocks of bounded size, each pair in the first band that they share,
   and what passes is confirmed on full sets as well. No pair within a component is ever formed, and no candidate
   is dropped: a pair at the threshold misses all bands with a probability of 3e-7, and falls under the
   estimate's margin (five standard errors) with one of 3e-7.

Texts without words have no shingles and link with nothing. Rows with a null doc_id take no part: their
component is null and they are kept. Rows that repeat a doc_id share its component. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, shingles

BANDS, ROWS, BINS, BITS = 32, 6, 1024, 4
BLOCK = 512
_A = np.random.default_rng(20240501).integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)


def band_keys(found: np.ndarray) -> np.ndarray:
    """32 fingerprints of six minima each of a non-empty shingle set."""
    h = (found >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 1024):
        low = np.minimum(low, (h[i : i + 1024, None] * _A).min(axis=0))
    return shingles.windows_of_rows(low.reshape(BANDS, ROWS).astype(np.uint64))


def signature(found: np.ndarray) -> np.ndarray:
    """1024 four-bit codes, two to a byte: low bits of each bin's minimum, 0 where the bin is empty."""
    h = (found * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (found >> np.uint64(31))
    bins = (h >> np.uint64(54)).astype(np.int64)
    low = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(low, bins, h & np.uint64((1 << 54) - 1))
    codes = np.where(low == np.iinfo(np.uint64).max, 0, 1 + low % np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return codes[0::2] | (codes[1::2] << np.uint8(4))


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of signatures row by row (uint8, broadcast over leading axes)."""
    same, either = a ^ b, a | b
    nibbles = lambda x: np.bitwise_count(((x | x >> 1) | (x | x >> 1) >> 2) & np.uint64(0x1111111111111111)).sum(axis=-1, dtype=np.int64)
    filled = nibbles(either)
    match = (filled - nibbles(same)) / np.maximum(filled, 1)
    chance = 1 / ((1 << BITS) - 1)
    return (match - chance) / (1 - chance)


def _words64(sigs) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint64).reshape(-1, BINS * BITS // 64)


def margin(threshold: float) -> float:
    """Five standard errors of the estimate below the threshold."""
    return threshold - 5 * (threshold * (1 - threshold) / BINS) ** 0.5 - 0.01


def fingerprints(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    common.tune(docs.sparkSession)

    def build(batches):
        common.take_turn("words", shingles.forget)
        for b in batches:
            ids, hi, lo, n, bands, sigs = b.column(0), [], [], [], [], []
            for t in b.column(1).to_pylist():
                found = shingles.words(t)
                key = xxhash.xxh3_128_intdigest(b" ".join(found))
                hi.append((key >> 64) - (1 << 63))
                lo.append((key & (1 << 64) - 1) - (1 << 63))
                s = np.unique(shingles.windows(shingles.word_hashes(found), shingle))
                n.append(len(s))
                bands.append(band_keys(s).view(np.int64) if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([ids, pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(n, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=["doc_id", "hi", "lo", "n_shingles", "bands", "sig"])

    src = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return src.mapInArrow(build, "doc_id long, hi long, lo long, n_shingles long, bands array<long>, sig binary")


def likely(pairs: DataFrame, sigs: DataFrame, floor: float) -> DataFrame:
    """Pairs (a, b) whose signatures' estimate reaches the floor."""
    both = pairs.join(sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb")), "b")

    def test(batches):
        for x in batches:
            if x.num_rows:
                ok = estimate(_words64(x.column(2).to_pylist()), _words64(x.column(3).to_pylist())) >= floor
                yield x.select([0, 1]).filter(pa.array(ok))

    return both.select("a", "b", "sa", "sb").mapInArrow(test, "a long, b long")


def confirm(pairs: DataFrame, docs: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """Pairs whose full shingle sets have den * intersection >= num * union."""
    left = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")

    def test(batches):
        common.take_turn("words", shingles.forget)
        kept: dict[int, np.ndarray] = {}

        def of(key, text):
            if key not in kept:
                if len(kept) >= 64:
                    kept.clear()
                kept[key] = shingles.shingle_set(text, shingle)
            return kept[key]

        for x in batches:
            ok = []
            for a, b, ta, tb in zip(*(x.column(k).to_pylist() for k in range(4)), strict=True):
                p, q = of(a, ta), of(b, tb)
                i = shingles.overlap(p, q)
                ok.append(i > 0 and den * i >= num * (len(p) + len(q) - i))
            yield x.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(test, "a long, b long")


def rest_pairs(open_rows: DataFrame, floor: float) -> DataFrame:
    """(a, b) of different components that share a bucket and whose estimate reaches the floor.

    open_rows: band, key, doc_id, comp, bands, sig. Buckets are cut into blocks of about BLOCK texts; a task gets two blocks.
    """
    sized = open_rows.groupBy("band", "key").agg(F.count("*").alias("m")).withColumn("blocks", F.expr(f"cast((m + {BLOCK - 1}) div {BLOCK} as int)"))
    rows = open_rows.join(sized.select("band", "key", "blocks"), ["band", "key"])
    rows = rows.withColumn("mine", F.expr("cast(pmod(xxhash64(doc_id), blocks) as int)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("band", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "doc_id", "comp", "bands", "sig")

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        band, i, j = int(key[0]), int(key[2]), int(key[3])
        mine, ids, comp = pdf["mine"].to_numpy(), pdf["doc_id"].to_numpy(), pdf["comp"].to_numpy()
        sigs, bands = _words64(pdf["sig"]), np.stack(pdf["bands"].to_numpy())
        left = np.flatnonzero(mine == i)
        out = []
        for n, x in enumerate(left):
            right = left[n + 1 :] if i == j else np.flatnonzero(mine == j)
            right = right[comp[right] != comp[x]]
            if len(right):
                right = right[~(bands[right, :band] == bands[x, :band]).any(axis=1)]
            if len(right):
                right = right[estimate(sigs[right], sigs[x]) >= floor]
                out += [(min(ids[x], ids[y]), max(ids[x], ids[y])) for y in right]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.groupBy("band", "key", "i", "j").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, num: int = 80, den: int = 100, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row per input row. Links: den * intersection >= num * union."""
    floor = margin(num / den)
    scratch = common.Scratch()
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints = common.staged(fingerprints(docs, shingle, "doc_id", "text"), "minhash")
    known = prints.where("doc_id IS NOT NULL AND n_shingles > 0")
    # written first: in a stage with its own aggregation a hot group's join couldn't be split
    firsts = scratch.staged(known.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep")), "firsts")
    copies = scratch.staged(known.select("doc_id", "hi", "lo").join(firsts, ["hi", "lo"]).select("doc_id", "rep", "hi", "lo"), "copies")
    # a repeated doc_id may hold several texts: each distinct text is linked under that id
    reps = known.join(copies.where("doc_id = rep").select("doc_id", "hi", "lo").distinct(), ["doc_id", "hi", "lo"], "left_semi")
    reps = scratch.staged(reps.dropDuplicates(["doc_id", "hi", "lo"]).select("doc_id", "bands", "sig"), "reps")
    texts = docs.join(reps.select("doc_id"), "doc_id", "left_semi")

    buckets = reps.select("doc_id", F.posexplode("bands").alias("band", "key"))
    tops = buckets.groupBy("band", "key").agg(F.min("doc_id").alias("lead"), F.count("*").alias("m")).where("m > 1")
    shared = scratch.staged(buckets.join(tops, ["band", "key"]).select("band", "key", "doc_id", "lead", "m"), "buckets")
    stars = shared.where("doc_id <> lead").select(F.col("doc_id").alias("a"), F.col("lead").alias("b")).distinct()
    links = scratch.staged(confirm(scratch.staged(likely(stars, reps, floor), "likely"), texts, shingle, num, den).distinct(), "links")
    comp = scratch.staged(common.components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "components")

    # only buckets of three or more texts can hold pairs that no star has tested
    labelled = shared.where("m > 2").join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id"))
    mixed = labelled.where("doc_id <> lead").groupBy("band", "key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1")
    held = labelled.where("doc_id <> lead").join(mixed.select("band", "key"), ["band", "key"], "left_semi").select("band", "key", "doc_id", "comp")
    more = rest_pairs(held.join(reps, "doc_id").select("band", "key", "doc_id", "comp", "bands", "sig"), floor)
    more = scratch.staged(confirm(scratch.staged(more, "rest"), texts, shingle, num, den).distinct(), "links")

    # copies follow their first text; only ids that are repeated with several texts tie these together
    several = copies.groupBy("doc_id").agg(F.min("rep").alias("r0"), F.max("rep").alias("r1")).where("r0 <> r1")
    bridges = copies.join(several.select("doc_id"), "doc_id", "left_semi").where("doc_id <> rep").select("doc_id", "rep")
    final = scratch.staged(common.components(links.union(more).union(bridges).toDF("src", "dst")).select(F.col("id").alias("rep"), "component"), "components")
    placed = copies.join(final, "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    placed = common.staged(placed.groupBy("doc_id").agg(F.min("component").alias("component")), "placed")
    scratch.drop()
    out = prints.select("doc_id", "n_shingles").join(placed, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
u AS (SELECT doc_id, unnest(sh) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, t.b FROM reach r JOIN sym t ON r.b = t.a)
SELECT n.doc_id, n.n AS n_shingles, m.component_id, n.doc_id = m.component_id AS kept
FROM n JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) m ON n.doc_id = m.a
"""


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read_table(spark, sf_dir, "documents"), num=85)
