"""A corpus pipeline: quality, near duplicates, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return
the columns of docs. run() applies them to documents and writes each result to the shared folder.

Every stage takes any docs with doc_id and text, and keeps all other columns as they are, whatever their names (they
travel under names of the stage's own). An empty table gives an empty result. What each does with nulls, empty and very
long texts, ties and repeated rows is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.llm import common, decontam, neardup, packing, quality, secrets


def _renamed(docs: DataFrame) -> tuple[DataFrame, str, str, list]:
    """docs under names that clash with nothing, the id's and the text's new names, and the way back."""
    new = [f"doc_{k}_" for k in range(len(docs.columns))]
    at = dict(zip(docs.columns, new, strict=True))
    return docs.toDF(*new), at["doc_id"], at["text"], [F.col(n).alias(c) for c, n in at.items()]


def _numbered(own: DataFrame, key: str, text: str) -> DataFrame:
    """own with row_, a number for every row: its doc_id, but numbers above all ids for rows without one and for all but one of the
    rows that share one. Only such rows are written; texts are told apart by their hash."""
    several = common.staged(own.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows_")).where("rows_ > 1").select(F.col(key).alias("again_")), "repeated")
    plain = own.where(F.col(key).isNotNull()).join(several, own[key] == several["again_"], "left_anti")
    odd = own.where(F.col(key).isNull()).union(own.join(several, own[key] == several["again_"], "left_semi"))
    odd = common.staged(odd.select("*", F.monotonically_increasing_id().alias("at_"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("hash_")), "odd")
    heads = common.staged(odd.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct("hash_", "at_")).alias("head_")).select(F.col("head_.at_").alias("first_")), "heads")
    first = odd.join(heads, odd["at_"] == heads["first_"], "left_semi").select(*own.columns, F.col(key).cast("long").alias("row_"))
    rest = common.blocked_rank(odd.join(heads, odd["at_"] == heads["first_"], "left_anti"), [], [F.col("hash_"), F.col("at_")], "nth_")
    top = own.agg(F.max(F.col(key).cast("long"))).first()[0]
    rest = common.staged(rest.select(*own.columns, (F.col("nth_") + max(0, 0 if top is None else top + 1)).alias("row_")), "rest")
    return plain.select("*", F.col(key).cast("long").alias("row_")).union(first).union(rest)


def grade(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier keeps; trained on the labelled ones among them.

    Null and empty texts have no features and are kept or not as the thresholds alone say; a long text is graded by all its words. Rows
    with a null doc_id and repeated rows are graded each by its own text; equal texts get equal grades. Of several
    labels of one doc_id the largest counts, labels with a null doc_id or grade don't; without labels of two grades
    documents are all kept, or all go if the only grade is a bad one. A probability of exactly a half is kept.
    """
    common.spare_driver(spark)
    model = quality.train(docs, common.read_table(spark, sf_dir, "labels"))
    own, key, text, back = _renamed(docs)
    return quality.score(own, model, extra=own.columns, id_col=key, text_col=text).where("kept").select(*back)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id.

    Null and empty texts, and texts without words, are like nothing and all stay. Long texts are compared whole. Rows
    with a null doc_id, and all but one of the rows that share a doc_id, take part under numbers above all ids: so a
    copy goes even if it has no id or a known one, another text under a known id stays, and an id wins over a row without.
    """
    common.spare_driver(spark)
    own, key, text, back = _renamed(docs)
    rows = _numbered(own, key, text)
    gone = neardup.near_duplicates(rows, id_col="row_", text_col=text).where("NOT kept").select(F.col("doc_id").alias("gone_"))
    return rows.join(gone, rows["row_"] == gone["gone_"], "left_anti").select(*back)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item.

    Null and empty texts leak nothing; items that are null or have no words are skipped; long texts are searched whole.
    Rows with a null doc_id and rows that share one are judged each by its own text; repeated rows go or stay together.
    """
    common.spare_driver(spark)
    own, key, text, back = _renamed(docs)
    rows = _numbered(own, key, text)
    found = decontam.leaks(rows, common.read_table(spark, sf_dir, "benchmark"), id_col="row_", text_col=text)
    found = found.select(F.col("doc_id").alias("leak_")).distinct()
    return rows.join(found, rows["row_"] == found["leak_"], "left_anti").select(*back)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced; n_chars, if there is one, follows the text where it has changed.

    Every row stays. Null and empty texts stay as they are; long texts are scanned whole; rows with a null doc_id, without a source
    and repeated rows are redacted each. A score of exactly a half is a secret.
    """
    common.spare_driver(spark)
    own, _, text, back = _renamed(docs)
    at = dict(zip(docs.columns, own.columns, strict=True))
    got = secrets.scan(own, text_col=text, path_col=at.get("source"))
    hit = F.exists("findings", lambda x: x["is_secret"])
    if "n_chars" in at:
        got = got.withColumn(at["n_chars"], F.when(hit, F.length("redacted").cast("long")).otherwise(F.col(at["n_chars"])))
    return got.withColumn(text, F.col("redacted")).select(*back)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that are left: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is a piece of its end id alone; long texts are cut into pieces of a sequence's length; a null doc_id
    stays null; repeated rows are packed each. Other columns are not in the result.
    """
    import public_tokenizers

    common.spare_driver(spark)
    return packing.best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")


STAGES = [("quality", grade), ("near_duplicates", deduplicate), ("decontamination", decontaminate), ("secrets", redact), ("packing", pack)]

# The stages hold trained models, so SQL can't express them; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents of a folder that pass all stages."""
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
