"""Token-ID output: Arrow stream files whose batches hold fixed-size lists of ids and of mask bits.

One file is one Arrow IPC stream. A row is a sequence of `seq_len` ids (uint16 where the vocabulary allows,
else uint32), a mask of as many bits (true: a real token) and `docs`, the documents that begin in it: their
number in the file's order, id, place and length. All batches but the last have `batch_rows` rows, so that
sequence i is row i % batch_rows of batch i // batch_rows, and its ids are a slice of the file's own buffer.
Documents run on from sequence to sequence; only a file's last sequence is padded. Schema metadata holds
`part` and `chunk`, by which files sort in document order.

Null text is an empty document; a null doc_id sorts first; repeated rows are each written; an empty table
gives no files and an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bpe, common

DOCS = pa.list_(pa.struct([("doc", pa.int64()), ("doc_id", pa.int64()), ("offset", pa.int32()), ("length", pa.int64())]))


def _schema(seq_len: int, wide: bool, batch_rows: int, part: int, chunk: int) -> pa.Schema:
    ids = pa.list_(pa.field("item", pa.uint32() if wide else pa.uint16(), nullable=False), seq_len)
    mask = pa.list_(pa.field("item", pa.bool_(), nullable=False), seq_len)
    meta = {"seq_len": seq_len, "batch_rows": batch_rows, "part": part, "chunk": chunk}
    return pa.schema([("ids", ids), ("mask", mask), ("docs", DOCS)], metadata={"token_file": json.dumps(meta)})


def build(docs: list[tuple[int | None, bytes]], seq_len: int, wide: bool, batch_rows: int = 256, part: int = 0, chunk: int = 0) -> bytes:
    """The bytes of a file for (doc_id, ids as little-endian uint32) in order."""
    schema = _schema(seq_len, wide, batch_rows, part, chunk)
    flat = np.frombuffer(b"".join(x for _, x in docs), "<u4").astype("<u4" if wide else "<u2")
    lengths = np.array([len(x) // 4 for _, x in docs], np.int64)
    starts = np.cumsum(lengths) - lengths
    rows = -(-len(flat) // seq_len)
    ids = np.zeros(rows * seq_len, flat.dtype)
    ids[: len(flat)] = flat
    mask = np.zeros(rows * seq_len, bool)
    mask[: len(flat)] = True
    held = np.searchsorted(starts, np.arange(rows + 1) * seq_len).astype(np.int32)
    held[-1] = len(docs)
    index = pa.StructArray.from_arrays([pa.array(np.arange(len(docs))), pa.array([d for d, _ in docs], pa.int64()), pa.array((starts % seq_len).astype(np.int32)), pa.array(lengths)], fields=list(DOCS.value_type))
    columns = [
        pa.FixedSizeListArray.from_arrays(pa.array(ids), type=schema.field("ids").type),
        pa.FixedSizeListArray.from_arrays(pa.array(mask), type=schema.field("mask").type),
        pa.ListArray.from_arrays(pa.array(held), index).cast(DOCS),
    ]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as w:
        for i in range(0, rows, batch_rows):
            w.write_batch(pa.RecordBatch.from_arrays([c.slice(i, batch_rows) for c in columns], schema=schema))
    return sink.getvalue().to_pybytes()


class TokenFile:
    """Random access to a file's sequences over a buffer (of bytes or of a memory map), without copies of ids."""

    def __init__(self, buffer):
        with pa.ipc.open_stream(pa.py_buffer(buffer)) as r:
            self.meta = json.loads(r.schema.metadata[b"token_file"])
            self.batches = list(r)
        self.seq_len, self.batch_rows = self.meta["seq_len"], self.meta["batch_rows"]

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def _row(self, name: str, i: int) -> pa.Array:
        col = self.batches[i // self.batch_rows].column(name)
        at = (col.offset + i % self.batch_rows) * self.seq_len
        return col.values.slice(at, self.seq_len)

    def sequence(self, i: int) -> np.ndarray:
        return self._row("ids", i).to_numpy(zero_copy_only=True)

    def mask(self, i: int) -> pa.BooleanArray:
        return self._row("mask", i)

    def index(self) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        """Numbers, ids, starts in the file and lengths of all documents in order."""
        out = []
        for b, batch in enumerate(self.batches):
            docs = batch.column("docs")
            row = np.repeat(np.arange(len(docs)), np.diff(np.asarray(docs.offsets)))
            d = docs.flatten()
            at = (b * self.batch_rows + row) * self.seq_len + np.asarray(d.field("offset"))
            out.append((np.asarray(d.field("doc")), d.field("doc_id"), at, np.asarray(d.field("length"))))
        n, ids, at, length = zip(*out, strict=True)
        return np.concatenate(n), pa.concat_arrays(ids), np.concatenate(at), np.concatenate(length)

    def documents(self):
        """(number, doc_id, start in the file, ids) of each document in order."""
        for n, d, at, length in zip(*(x.tolist() if isinstance(x, np.ndarray) else x.to_pylist() for x in self.index()), strict=True):
            yield n, d, at, self.span(at, length)

    def span(self, at: int, length: int) -> np.ndarray:
        """ids at..at+length; a view where they lie in one batch."""
        per, out = self.batch_rows * self.seq_len, []
        while length > 0:
            b, o = divmod(at, per)
            values = self.batches[b].column("ids").flatten().to_numpy(zero_copy_only=True)
            out.append(values[o : o + length])
            at, length = at + len(out[-1]), length - len(out[-1])
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, "<u2")


MAX_TASKS = 20_000  # of the writing exchange; larger inputs get larger tasks, each with files of the same size


def _numbers(values: list, kind: str) -> Column:
    """Many constants as one literal of the plan."""
    return F.expr(f"cast(split('{','.join(map(repr, values))}', ',') as array<{kind}>)")


def _between(key: Column, bounds: list[int], salt: Column) -> Column:
    """How many bounds lie below the key; for a key equal to bounds, a salted number up to those below or equal."""
    if not bounds:
        return F.lit(0)
    table = _numbers(bounds, "bigint")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])

    def count(test) -> Column:  # by binary search
        hit = lambda at, step: (at + step <= len(bounds)) & test(F.try_element_at(table, at + step))
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(hit(at, step), at + step).otherwise(at))

    below = count(lambda b: b < key)
    return below + F.when(F.array_contains(table, key), F.pmod(salt, (count(lambda b: b <= key) - below + 1).cast("long"))).otherwise(0).cast("int")


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, seq_len: int = 2048, text_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes documents in ascending id order, `end_id` after each, into files of about `text_bytes` of text.

    One exchange carries the texts, by ranges of ids; a task holds one file's ids at a time.
    """
    spark = docs.sparkSession
    common.tune(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # the planner's size of the input, from its files; it only sets how many tasks there are
    size_in_bytes = int(str(src._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size_in_bytes >= 1 << 60:  # the planner knows nothing
        size_in_bytes = int(src.agg(F.sum(F.octet_length("text").cast("double") + 16)).first()[0] or 0)
    parts = max(1, min(MAX_TASKS, size_in_bytes // text_bytes + 1))
    # bounds come from the ids alone, so the texts are read once; an id that several bounds share (or null, which
    # sorts first) is dealt over all their partitions by a hash of the text: any order among equal ids will do
    cuts = [k / parts for k in range(1, parts)]
    low = -(1 << 63)
    key = F.coalesce("doc_id", F.lit(low))
    bounds = src.agg(F.percentile_approx(key, _numbers(cuts, "double"), F.lit(min(1_000_000, 50 * parts))).alias("b")).first()["b"] if cuts else []
    part = _between(key, sorted(bounds or []), F.xxhash64("text"))
    ranged = src.repartitionById(parts, part).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def encode(batches):
        enc, end = bpe.encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        part, chunk, held, size = TaskContext.get().partitionId(), 0, [], 0
        wide = enc.wide or end_id > 0xFFFF

        def flush():
            return pa.RecordBatch.from_pydict({"file": pa.array([build(held, seq_len, wide, part=part, chunk=chunk)], pa.binary())})

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.append((d, enc.encode(t) + end))
                size += len(t)
                if size >= text_bytes:
                    yield flush()
                    chunk, held, size = chunk + 1, [], 0
        if held:
            yield flush()

    common.write_files(ranged.mapInArrow(encode, "file binary"), path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian uint32)."""

    def scan(batches):
        for b in batches:
            for content in b.column(0):
                f = TokenFile(content.as_buffer())
                n, ids, at, length = f.index()
                flat = np.concatenate([x.column("ids").flatten().to_numpy(zero_copy_only=True) for x in f.batches]).astype("<u4", copy=False)
                sums = [zlib.crc32(flat[i : i + k]) for i, k in zip(at.tolist(), length.tolist(), strict=True)]
                part, chunk = (np.full(len(n), f.meta[k], np.int64) for k in ("part", "chunk"))
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(chunk), pa.array(n), ids, pa.array(at), pa.array(length), pa.array(sums, pa.int64())], names=["part", "chunk", "doc", "doc_id", "at", "n_tokens", "ids_crc32"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    rows = common.staged(common.read_files(spark, path).mapInArrow(scan, "part long, chunk long, doc long, doc_id long, at long, n_tokens long, ids_crc32 long"), "tokens")
    common.tune(spark)
    files = rows.groupBy("part", "chunk").agg(F.sum("n_tokens").alias("n"))  # one row a file
    parts = files.groupBy("part").agg(F.sum("n").alias("whole"))  # at most MAX_TASKS rows
    parts = parts.select("part", (F.sum("whole").over(Window.orderBy("part")) - F.col("whole")).alias("before"))
    files = files.withColumn("base", F.sum("n").over(Window.partitionBy("part").orderBy("chunk")) - F.col("n")).join(parts, "part")
    files = files.select("part", "chunk", (F.col("before") + F.col("base")).alias("base"))
    return rows.join(files, ["part", "chunk"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = common.shared_dir(spark, "tokenfiles")
    write(common.read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read(spark, path)
