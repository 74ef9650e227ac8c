"""Shared plumbing: worker caches, shared-folder staging, raw file sink, distributed ranks, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

_own_dir: str | None = None
_caches: dict[str, Callable[[], object]] = {}


def tune(spark: SparkSession, batch_rows: int = 256) -> None:
    """Small Arrow batches, so that a batch of very long texts stays a few tens of MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))


def take_turn(name: str, clear: Callable[[], object]) -> None:
    """Called by a task that is about to fill the Python worker's cache `name`, which clear() empties. All others are emptied: Spark
    uses its workers again, so the caches of one operator would stay beside those of the next until the executor ends."""
    others = [k for k in _caches if k != name]
    for k in others:
        _caches.pop(k)()
    _caches[name] = clear
    if others:
        gc.collect()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps what is free otherwise
            trim(0)


def spare_driver(spark: SparkSession) -> None:
    """Called by a stage of many jobs before its first one. Spark writes each broadcast, be it of a kilobyte, into a new array of
    spark.broadcast.blockSize, by default 4 MB; there is one for each stage and each scan, and in a small heap arrays of that size are
    humongous: they start collections of their own, and the heap grows. Unless the user has set a size, blocks are 256 KB from here on."""
    spark.sparkContext._jsc.sc().conf().setIfMissing("spark.broadcast.blockSize", "256k")


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A fresh path below spark.checkpoint.dir. Where that is unset, a local master gets a temporary folder; on a cluster
    that is an error, as machines don't share their own folders."""
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        _own_dir = _own_dir or tempfile.mkdtemp(prefix="coppice-")
        base = f"file://{_own_dir}"
    return f"{base.rstrip('/')}/coppice/{tag}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder made by shared_dir()."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def staged(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: lineage is cut and nothing is computed twice."""
    spark = df.sparkSession
    path = shared_dir(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._coppice_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes the folders of frames made by staged() that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_coppice_path", None):
            remove(df.sparkSession, path)


class Scratch:
    """Written tables of one operator, deleted together when its last one is written."""

    def __init__(self):
        self.made: list[DataFrame] = []

    def staged(self, df: DataFrame, tag: str) -> DataFrame:
        self.made.append(staged(df, tag))
        return self.made[-1]

    def drop(self) -> None:
        release(*self.made)
        self.made.clear()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_files(df: DataFrame, path: str, column: str = "file") -> None:
    """Each row's bytes become exactly one file by Spark's own writer, on any file system. They must end in a zero byte.

    The text writer copies bytes as they are and ends a row with a separator: here with the file's own last byte.
    """
    body = F.col(column)
    ends = F.assert_true(F.substring(body, -1, 1) == F.lit(b"\0"), "a file that doesn't end in a zero byte")
    rows = df.select(body, ends.alias("ends")).where("ends IS NULL").select(F.expr(f"substring(`{column}`, 1, octet_length(`{column}`) - 1)").cast("string").alias("value"))
    rows.write.option("maxRecordsPerFile", 1).option("lineSep", "\0").text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The files of write_files() as rows (content binary)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def blocked_rank(df: DataFrame, keys: list[str], order: list[Column], name: str, buckets: int = 64) -> DataFrame:
    """Adds `name`: a gapless rank from 0 within `keys` without bringing a key's rows into one task.

    Rows of a key are split into hash buckets of `order`; a bucket's rank base is the number of rows in the
    key's lower buckets. Ranks follow the buckets, then `order`; rows equal in `order` get different ranks. Keys are
    never null.
    """
    b, base = f"{name}_bucket", f"{name}_base"
    split = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    w = (Window.partitionBy(*keys) if keys else Window).orderBy(b)  # a row per bucket and key
    sizes = split.groupBy(*keys, b).agg(F.count("*").alias("n"))
    sizes = sizes.withColumn(base, F.sum("n").over(w) - F.col("n")).drop("n")
    ranked = split.withColumn(name, F.row_number().over(Window.partitionBy(*keys, b).orderBy(*order)).cast("long") - 1)
    return ranked.join(sizes, [*keys, b]).select(*df.columns, (F.col(name) + F.col(base)).alias(name))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(src, dst) long edges -> (id, component): the smallest id reachable, for every id on an edge.

    Alternating large-star and small-star rounds; each is a grouped minimum and an equi-join, so a node with
    very many neighbours is an ordinary skewed join key. Every round is a written table; nothing is collected
    but two numbers a round.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct()
    cur = staged(e, "cc")
    state = None
    for _ in range(max_rounds):
        both = cur.union(cur.select("v", "u"))
        low = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc")  # apart, so that a hub's join may be split
        large = staged(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "cc")
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "cc")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = staged(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
        release(cur, low, large, least)
        cur = nxt
        got = cur.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if got == state:
            break
        state = got
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return cur.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).union(roots)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(schema))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, classes: list[int], id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, label, text) of at most `per_class` labelled documents of each class, chosen by a hash of the id, and
    how many labelled ids each class has. Of repeated labels the largest counts, of repeated documents the smallest text."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    sizes = {r[0]: r[1] for r in known.groupBy("label").agg(F.count("*")).collect()}
    picked = None
    for c in classes:
        one = known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = one if picked is None else picked.union(one)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # at most per_class rows a class: bounded by the parameter
    out = src.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return out, sizes
