"""Near-duplicate vectors by spherical-cap filters from random product codes.

A random rotation cuts each unit vector into `blocks` parts; each part has a random code of `words` Gaussian vectors,
and a filter direction is one code word of every part joined, so there are words ** blocks directions that are
never listed. A vector's filters are all directions whose inner product with it exceeds the cap's height (a normal
quantile, in any number of dimensions); they are list-decoded block by block, dropping partial sums that the best remaining words can't lift over it. The
height comes from the number of distinct vectors, so that two unrelated vectors share a filter ever more rarely
as the table grows, and the code's size from the number of filters wanted for each vector. Codes of more blocks clump, so
the number of rotations follows from the measured chance that a pair at the threshold shares a filter in one rotation:
such a pair is missed with a probability of at most `miss`, whatever the table's size and the vectors' length.

Equal vectors are collapsed first. Inside a filter every vector is tried against the filter's smallest id only (a
star), and vectors within half the link angle of such a leader form a tight group, all of whose pairs are links by
the triangle inequality. Filters are then joined on groups, not vectors: a pair of groups is all links, or none, by
its leaders' angle and the groups' radii, or else its members are verified one by one. So a large group of
copies costs no pairs. Cosines are in double precision.

Vectors that are null, zero or hold null or non-finite components link with nothing, as do vectors of another
length than theirs; rows with a null vec_id take no part and are kept. Rows that repeat a vec_id are counted as
vectors of their own. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from math import acos, ceil, log, pi, sqrt
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SLACK = 1e-9  # on angles and cosines where bounds decide instead of products


@lru_cache(256)
def codes(dim: int, blocks: int, words: int, seed: int, turned: bool = True) -> tuple[np.ndarray | None, list[np.ndarray], list[slice]]:
    """Rotation, each block's Gaussian code words (rows) and the blocks: projections on whole directions are standard normal.
    turned: with a rotation; vectors of random directions need none."""
    rng = np.random.default_rng(seed)
    rotation = None
    if turned:
        q, r = np.linalg.qr(rng.normal(size=(dim, dim)))
        rotation = q * np.sign(np.diag(r))
    cuts = [slice(dim * k // blocks, dim * (k + 1) // blocks) for k in range(blocks)]
    return rotation, [rng.normal(size=(words, c.stop - c.start)) for c in cuts], cuts


def shape(n: int, dim: int, per_vector: float) -> tuple[int, int, float]:
    """(blocks, words, height) for n distinct vectors: a cap holds about one of them, a vector has about per_vector filters."""
    share = min(0.02, max(1.0 / max(n, 1), 1e-12))
    count = per_vector / share
    blocks = next(k for k in (2, 3, 4, 6) if count ** (1 / k) <= 2048 or k == 6)
    blocks = min(blocks, dim)
    return blocks, max(2, ceil(count ** (1 / blocks))), -NormalDist().inv_cdf(share)


def filters(unit: np.ndarray, blocks: int, words: int, height: float, seed: int, turned: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of all directions whose inner product with a row exceeds the height."""
    rotation, code, cuts = codes(unit.shape[1], blocks, words, seed, turned)
    x = unit @ rotation if turned else unit
    dots = [x[:, c] @ w.T for c, w in zip(cuts, code, strict=True)]
    after = np.stack([d.max(axis=1) for d in dots])[::-1].cumsum(axis=0)[::-1]  # the most that blocks k.. can add
    row, part, key = np.arange(len(x)), np.zeros(len(x)), np.zeros(len(x), np.int64)
    for k, d in enumerate(dots[:-1]):
        total = part[:, None] + d[row]
        i, j = np.nonzero(total + after[k + 1][row][:, None] > height)
        row, part, key = row[i], total[i, j], key[i] * words + j
    # the last block's words in falling order: those that lift a partial sum over the height are a prefix
    order = np.argsort(-dots[-1], axis=1)
    falling = np.take_along_axis(dots[-1], order, axis=1)
    wide = 4.0 * (1 + np.abs(falling).max(initial=0.0) + abs(height) + np.abs(part).max(initial=0.0))  # sets rows apart
    line = (wide * np.arange(len(x))[:, None] - falling).ravel()
    n = np.searchsorted(line, wide * row - (height - part)) - row * words
    r = np.repeat(row, n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return r, np.repeat(key, n) * words + order[r, nth]


def chance(dim: int, blocks: int, words: int, height: float, cosine: float, seed: int, trials: int = 20, pairs: int = 100) -> float:
    """Chance that two vectors at this cosine share a filter in one rotation: measured on random pairs, less three standard errors."""
    rng, met = np.random.default_rng(seed), 0
    for t in range(trials):
        x, y = (rng.normal(size=(pairs, dim)) for _ in range(2))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        if dim == 1:
            y = x
        else:
            y -= np.einsum("ij,ij->i", x, y)[:, None] * x
            y = cosine * x + sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
        row, key = filters(np.concatenate([x, y]), blocks, words, height, seed + 1 + t, turned=False)
        a, b = (set(zip((row[side] % pairs).tolist(), key[side].tolist(), strict=True)) for side in (row < pairs, row >= pairs))
        met += len({r for r, _ in a & b})
        codes.cache_clear()
    p = met / (trials * pairs)
    return max(p - 3 * sqrt(p * (1 - p) / (trials * pairs)), 1e-3)


def turns(p: float, least: int, miss: float) -> int:
    """Rotations after which a pair that each one finds with chance p is missed with at most this probability."""
    return max(least, ceil(log(miss) / log(1 - p))) if p < 1 else least


def sketch(unit: np.ndarray, seed: int) -> np.ndarray:
    """128 signs of random projections, as two int64 a row."""
    w = np.random.default_rng(seed).normal(size=(unit.shape[1], 128))
    return np.packbits(unit @ w > 0, axis=1).view(np.int64)


def _within(angle) -> Column:
    """Whether sketches (s1, s2) and (t1, t2) differ in no more bits than vectors at this angle may: six standard errors."""
    p = angle / F.lit(pi)
    return F.bit_count(F.col("s1").bitwiseXOR(F.col("t1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("t2"))) <= 128 * p + 6 * F.sqrt(128 * p * (1 - F.least(p, F.lit(0.5))))


def _unit(batch) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in batch])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cosines(pairs: DataFrame, vectors: DataFrame, most: str = "vec") -> DataFrame:
    """pairs(a, b, ...) with cos, their vectors' cosine."""
    va = vectors.select(F.col("id").alias("a"), F.col("vec").alias("va"))
    vb = vectors.select(F.col("id").alias("b"), F.col("vec").alias("vb"))
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    both = pairs.join(va, "a").join(vb, "b").select("a", "b", *rest, "va", "vb")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in both.schema.fields[:-2])

    def product(batches):
        for x in batches:
            if x.num_rows:
                va, vb = x.column("va").to_pylist(), x.column("vb").to_pylist()  # a pair's vectors are of one length, a batch's may be of many
                lengths, c = np.array([len(v) for v in va]), np.empty(x.num_rows)
                for d in np.unique(lengths):
                    at = np.flatnonzero(lengths == d)
                    c[at] = np.einsum("ij,ij->i", _unit([va[i] for i in at]), _unit([vb[i] for i in at]))
                yield pa.RecordBatch.from_arrays([*x.columns[:-2], pa.array(c)], names=[*x.schema.names[:-2], "cos"])

    return both.mapInArrow(product, f"{kinds}, cos double")


def near_vectors(table: DataFrame, cosine: float = 0.95, per_vector: float = 11.0, rotations: int = 8, miss: float = 1e-4, seed: int = 11, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: a row per input row. `rotations` is the least number of them."""
    common.tune(table.sparkSession, 2000)
    scratch = common.Scratch()
    theta = acos(cosine)
    src = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    ok = F.col("vec_id").isNotNull() & (F.size("vec") > 0) & ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("vec", lambda v: v != 0)
    src = src.withColumn("ok", F.coalesce(ok, F.lit(False)))
    good = src.where("ok").select("vec_id", "vec", F.sha1(F.concat_ws(",", F.col("vec").cast("array<string>"))).alias("h"))
    # written first, so that the join of a very common vector may be split
    same = scratch.staged(good.groupBy("h").agg(F.min("vec_id").alias("id"), F.count("*").alias("m")), "vec-same")
    member = common.staged(good.select("vec_id", "h").join(same, "h").select("vec_id", "id", "m", "h"), "vec-copies")
    owners = member.where("vec_id = id").select("vec_id", "h", "id", "m").distinct()
    vectors = good.select("vec_id", "vec", "h").join(owners.select("vec_id", "h"), ["vec_id", "h"], "left_semi").dropDuplicates(["h"])
    # an id that is repeated with other vectors stands for several: h tells these apart from here on
    vectors = scratch.staged(vectors.select(F.xxhash64("h").alias("id"), F.col("vec_id").alias("name"), "vec", F.size("vec").alias("dim")).join(owners.select(F.xxhash64("h").alias("id"), "m"), "id"), "vectors")
    member = member.withColumn("own", F.xxhash64("h"))

    def measure(batches):
        for b in batches:
            for d, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                plan = shape(n, d, per_vector)
                k = turns(chance(d, *plan, cosine, seed + 1_000_000), rotations, miss)
                yield pa.RecordBatch.from_pylist([{"dim": d, "blocks": plan[0], "words": plan[1], "height": plan[2], "turns": k}], pa.schema(kinds))

    kinds = [("dim", pa.int32()), ("blocks", pa.int32()), ("words", pa.int64()), ("height", pa.float64()), ("turns", pa.int32())]
    sizes = vectors.groupBy("dim").agg(F.count("*").alias("n")).where("n > 1")
    plans = scratch.staged(sizes.repartition("dim").mapInArrow(measure, "dim int, blocks int, words long, height double, turns int"), "codes")

    def decode(batches):
        for b in batches:
            dims = np.asarray(b.column(2))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                blocks, words, height, turns = (b.column(k)[int(at[0])].as_py() for k in range(3, 7))
                unit, ids = _unit([b.column(1)[int(i)].as_py() for i in at]), np.asarray(b.column(0))[at]
                signs = sketch(unit, seed)
                for k in range(turns):
                    row, key = filters(unit, blocks, words, height, seed + k)
                    cols = [ids[row], np.full(len(row), d, np.int32), np.full(len(row), k, np.int32), key, signs[row, 0], signs[row, 1]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["id", "dim", "code", "key", "s1", "s2"])

    planned = vectors.join(plans, "dim").select("id", "vec", "dim", "blocks", "words", "height", "turns").sortWithinPartitions("dim")  # one code after the other
    caps = scratch.staged(planned.mapInArrow(decode, "id long, dim int, code int, key long, s1 long, s2 long"), "caps")
    cell = ["dim", "code", "key"]

    # tight groups: star edges to each filter's smallest id, within half the link angle
    leads = caps.groupBy(*cell).agg(F.min(F.struct(F.col("id").alias("b"), F.col("s1").alias("t1"), F.col("s2").alias("t2"))).alias("l"), F.count("*").alias("c")).where("c > 1").select(*cell, "l.*")
    stars = caps.join(leads, cell).where((F.col("id") != F.col("b")) & _within(F.lit(theta / 2))).select(F.col("id").alias("a"), "b").distinct()
    near = scratch.staged(_cosines(stars, vectors).where(F.col("cos") >= float(np.cos(theta / 2 - SLACK))), "tight")
    # a leader must not follow another: an id is assigned only if its smallest leader has none itself
    first = near.groupBy("a").agg(F.min("b").alias("lead"), F.min_by("cos", "b").alias("cos"))
    follows = first.join(first.select(F.col("a").alias("lead")), "lead", "left_anti").select(F.col("a").alias("id"), "lead", "cos")
    grouped = vectors.select("id", "name", "m").join(follows, "id", "left")
    grouped = grouped.select("id", "name", "m", F.coalesce("lead", "id").alias("g"), F.coalesce(F.acos(F.least(F.col("cos"), F.lit(1.0))), F.lit(0.0)).alias("r"))
    grouped = scratch.staged(grouped, "groups")
    ball = scratch.staged(grouped.groupBy("g").agg(F.sum("m").alias("size"), F.max("r").alias("radius"), F.count("*").alias("texts")), "balls")

    # pairs of groups that share a filter
    signs = grouped.where("id = g").select("g").join(caps.select(F.col("id").alias("g"), "s1", "s2").dropDuplicates(["g"]), "g").join(ball.select("g", "radius"), "g")
    cells = caps.join(grouped.select("id", "g"), "id").select(*cell, "g").distinct().join(signs, "g")
    x, y = cells.select(*cell, F.col("g").alias("a"), "s1", "s2", F.col("radius").alias("r1")), cells.select(*cell, F.col("g").alias("b"), F.col("s1").alias("t1"), F.col("s2").alias("t2"), F.col("radius").alias("r2"))
    met = x.join(y, cell).where((F.col("a") < F.col("b")) & _within(F.lit(theta) + F.col("r1") + F.col("r2"))).select("a", "b").distinct()
    met = _cosines(met, vectors)
    ra, rb = ball.select(F.col("g").alias("a"), F.col("radius").alias("ra")), ball.select(F.col("g").alias("b"), F.col("radius").alias("rb"))
    met = met.join(ra, "a").join(rb, "b").withColumn("ang", F.acos(F.greatest(F.least(F.col("cos"), F.lit(1.0)), F.lit(-1.0))))
    met = met.where(F.col("ang") - F.col("ra") - F.col("rb") <= theta + SLACK)
    single = (F.col("ra") == 0) & (F.col("rb") == 0)
    met = scratch.staged(met.withColumn("sure", F.when(single, F.col("cos") >= cosine).otherwise(F.col("ang") + F.col("ra") + F.col("rb") <= theta - SLACK)).where(~single | F.col("sure")), "met")
    sure = met.where("sure").select("a", "b")
    # the others: every member of one against the other's leader first, then member by member
    ga = grouped.select(F.col("g").alias("a"), F.col("id").alias("ia"))
    gb = grouped.select(F.col("g").alias("b"), F.col("id").alias("ib"))
    unsure = met.where("NOT sure").select(F.col("a").alias("ga"), F.col("b").alias("gb"), "rb")
    toward = unsure.join(ga.withColumnRenamed("a", "ga"), "ga").select(F.col("ia").alias("a"), F.col("gb").alias("b"), "rb")
    toward = _cosines(toward, vectors).where(F.acos(F.greatest(F.least(F.col("cos"), F.lit(1.0)), F.lit(-1.0))) - F.col("rb") <= theta + SLACK)
    cross = toward.select(F.col("a").alias("ia"), "b").join(gb, "b").select(F.col("ia").alias("a"), F.col("ib").alias("b"))
    cross = scratch.staged(_cosines(cross, vectors).where(F.col("cos") >= cosine).select("a", "b"), "cross")

    # links of an owner: its copies, its group, its sure neighbour groups, its verified neighbours
    gs = sure.union(sure.select("b", "a")).toDF("g", "o").join(ball.select(F.col("g").alias("o"), "size"), "o").groupBy("g").agg(F.sum("size").alias("by_group"))
    both = cross.union(cross.select("b", "a")).toDF("id", "o")
    ones = both.join(grouped.select(F.col("id").alias("o"), "m"), "o").groupBy("id").agg(F.sum("m").alias("by_one"))
    own = grouped.join(ball.select("g", "size"), "g").join(gs, "g", "left").join(ones, "id", "left")
    own = own.select("id", "name", "g", (F.col("size") - 1 + F.coalesce("by_group", F.lit(0)) + F.coalesce("by_one", F.lit(0))).alias("n_links"))

    names = member.select(F.col("own").alias("id"), "vec_id")
    low = names.groupBy("id").agg(F.min("vec_id").alias("low"))
    labels = grouped.select("id", "g").join(low, "id").groupBy("g").agg(F.min("low").alias("low"))
    at = grouped.select("id", "g")
    edges = sure.union(cross.join(at.withColumnRenamed("id", "a").withColumnRenamed("g", "g1"), "a").join(at.withColumnRenamed("id", "b").withColumnRenamed("g", "g2"), "b").select("g1", "g2")).toDF("src", "dst")
    comp = common.components(edges).select(F.col("id").alias("g"), "component")
    whole = labels.join(comp, "g", "left").select("g", "low", F.coalesce("component", "g").alias("c"))
    lows = whole.groupBy("c").agg(F.min("low").alias("component_id"))
    per = common.staged(own.join(whole.select("g", "c"), "g").join(lows, "c").select("id", "n_links", "component_id"), "classes")
    scratch.drop()
    done = names.join(per, "id").select("vec_id", "n_links", "component_id")
    lone = src.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.union(lone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
k AS (SELECT * FROM v WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM k a JOIN k b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, t.b FROM reach r JOIN e t ON r.b = t.a)
SELECT v.vec_id, coalesce(d.n, 0) AS n_links, m.component_id, v.vec_id = m.component_id AS kept
FROM v JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) m ON v.vec_id = m.a LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY a) d ON d.a = v.vec_id
"""


def op6_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(common.read_table(spark, sf_dir, "embeddings"))
