"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator and stage."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from coppice.llm import caps, common, decontam, neardup, packing, quality, secrets, sharding, tokenfile, toxicity, warc

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
CLASH = ["kept", "score", "shard", "start", "findings", "redacted", "uid", "hub", "sha", "tie", "rank", "label", "gone", "leak", "top", "page", "length", "id", "h", "comp", "graded", "bands", "piece", "hi", "_parts"]
SECRET = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"
ITEM = "The quick answer to this question about seven rivers is found in the old blue book"
ROWS = [
    (None, None, None), (None, "a b c", "s"), (1, "", "s"), (2, None, None), (3, " \t\n", "s"), (4, "one two", "s"), (4, "one two", "s"),
    (5, "word " * 30_000, "s"), (6, f'my token = "{SECRET}" here and more words', "a.env"), (7, f"x {ITEM} y", "s"), (8, "b" * 60_000, "s"),
    (9, "﷐ odd ﷑ signs \x00\x01 12 12 12 " + "é" * 50, "s"), (10, "same text of six words here", "s"), (11, "same text of six words here", "s"), (11, "another text under one id here now", "s"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long")).withColumn("lang", F.lit("en"))
    return df.select(*df.columns, *[F.lit(k).alias(c) for k, c in enumerate(CLASH)]).cache()


@pytest.fixture(scope="module")
def none(spark, docs):
    return spark.createDataFrame([], docs.schema)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 0), (4, 1, 1), (4, 1, 0), (5, 0, 1), (6, 1, 0), (10, 1, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "one two"), (None, "never seen words at all in this")], "item_id long, text string")


def test_token_files(spark, docs, none):
    for df, n in ((docs, len(ROWS)), (none, 0)):
        path = common.shared_dir(spark, "t")
        tokenfile.write(df, path, BYTE, 2, text_bytes=2000)
        got = sorted(tokenfile.read(spark, path).collect(), key=lambda r: r["start"])
        assert len(got) == n
        at = 0
        for r in got:
            assert r["start"] == at and r["n_tokens"] >= 1
            at += r["n_tokens"]
        ids = [r["doc_id"] for r in got]
        assert ids == sorted(ids, key=lambda x: -1 if x is None else x)


def test_packing(docs, none):
    got = packing.best_fit_packing(docs, WORD, seq_len=64, keep_ids=True)
    rows = got.collect()
    assert {(r["doc_id"]) for r in rows} == {r[0] for r in ROWS}
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 64
    assert sorted(len(r["ids"]) for r in packing.sequences(got).collect()) == sorted(sum(n for _, n in v) for v in by.values())
    assert packing.best_fit_packing(none, WORD).count() == 0


def test_near_duplicates(docs, none):
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    comp = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None}
    assert comp[10] == comp[11] == 10 and comp[4] == 4 and comp[1] == 1 and comp[3] == 3
    assert all(r["kept"] and r["component_id"] is None for r in got if r["doc_id"] is None)
    assert {r["doc_id"]: r["n_shingles"] for r in got}[5] == 1
    assert neardup.near_duplicates(none).count() == 0


def test_decontamination(docs, none, bench):
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()}
    assert (7, 1) in got and (4, 4) in got and not {d for d, i in got} - {4, 7}
    assert decontam.leaks(none, bench).count() == 0 and decontam.leaks(docs, bench.limit(0)).count() == 0
    assert len(decontam.leaks(docs.union(docs), bench.union(bench)).collect()) == 2 * len(decontam.leaks(docs, bench).collect())


def test_secrets(docs, none):
    got = secrets.scan(docs)
    assert got.columns == [*docs.columns, "findings_", "redacted_"] and got.select(*docs.columns).exceptAll(docs).count() == 0
    assert got.schema["findings"] == docs.schema["findings"]
    got = {r["doc_id"]: r for r in secrets.scan(docs.drop("findings", "redacted", "_parts")).collect()}
    assert SECRET not in got[6]["redacted"] and "[SECRET]" in got[6]["redacted"] and got[6]["text"][got[6]["findings"][0]["start"] :].startswith(SECRET)
    assert got[2]["redacted"] is None and got[2]["findings"] == [] and got[9]["redacted"] == ROWS[11][1]
    assert secrets.scan(none.drop("findings", "redacted")).count() == 0


def test_shards(docs, none):
    got = sharding.balanced_shards(docs, shards=4).collect()
    sizes = [sum(r["shard"] == s for r in got) for s in range(4)]
    assert len(got) == len(ROWS) and max(sizes) - min(sizes) <= 1
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    assert sharding.balanced_shards(none).count() == 0


def test_toxicity(docs, none, labels):
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    empty = toxicity.train(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(docs, empty).collect()} == {toxicity.Model(empty.weights, -60.0).scores([""])[0]}
    assert toxicity.score(none, model).count() == 0 and toxicity.train(none, labels) is not None


def test_quality(docs, none, labels):
    model = quality.train(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r["tail_probability"] <= 1 for r in got)
    assert all(r["kept"] for r in quality.score(docs, quality.train(docs, labels.limit(0))).collect())
    assert all(r["kept"] for r in quality.score(docs, quality.train(docs, labels.where("quality = 1"))).collect())
    assert not any(r["kept"] for r in quality.score(docs, quality.train(docs, labels.where("quality = 0"))).collect())
    assert quality.score(none, model).count() == 0 and quality.train(none, labels) is not None


def test_vectors(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    nan, inf = float("nan"), float("inf")
    rows = [(1, v), (2, v), (2, v), (3, [2 * x for x in v]), (4, None), (5, []), (6, [0.0] * 4), (7, [1.0, None, 2.0, 3.0]), (8, [nan, 1.0, 1.0, 1.0]), (9, [inf, 1.0, 1.0, 1.0]), (None, v), (10, [1.0, 2.0]), (11, [1.0, 2.0]), (12, [-x for x in v]), (13, [5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *[F.lit(0).alias(c) for c in CLASH])
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in caps.near_vectors(df).collect()}
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[3] == (3, 1, False)
    assert all(got[k] == (0, k, True) for k in (4, 5, 6, 7, 8, 9, 12, 13)) and got[None] == (0, None, True)
    assert got[10] == (1, 10, True) and got[11] == (1, 10, False)
    assert caps.near_vectors(df.limit(0)).count() == 0


def test_warc(spark):
    rows = [(1, "http://a b\r\nx", "<p>é</p>" * 9000), (2, None, None), (3, "u", ""), (None, "u", "<p>é</p>" * 9000), (4, "u", "WARC/1.1\r\n\r\n0\r\n\r\n"), (5, "u", "same"), (6, "u", "same"), (6, "u", "same"), (None, "u", "lone")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit(0).alias(c) for c in CLASH])
    path = common.shared_dir(spark, "warc")
    warc.write(df, path, segment_bytes=500, chunk_bytes=77, archive_bytes=3000)
    got = warc.reassemble(common.staged(warc.scan(spark, path), "r")).collect()
    assert len(got) == len(rows)
    kinds = sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in got)
    assert kinds == sorted([("1", "response", "None"), ("2", "revisit", "3"), ("3", "response", "None"), ("None", "revisit", "1"), ("4", "response", "None"), ("5", "revisit", "6"), ("6", "response", "None"), ("6", "response", "None"), ("None", "response", "None")])
    want = {r[0]: (r[2] or "").encode() for r in rows if r[0] is not None}
    for r in got:
        if r["page_id"] is not None:
            assert (r["payload_bytes"], r["payload_digest"]) == (len(want[r["page_id"]]), warc.digest(want[r["page_id"]]))
    assert {bytes(r["payload"]) for r in got if r["payload"] is not None} >= {want[1]}
    path = common.shared_dir(spark, "warc")
    warc.write(df.limit(0), path)
    assert warc.reassemble(common.staged(warc.scan(spark, path), "r")).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, none, labels, bench, tmp_path, name, stage):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for df in (docs, none):
        out = stage(spark, df, str(tmp_path))
        if name != "packing":
            assert out.columns == df.columns
            assert out.count() <= df.count()
        else:
            assert out.count() >= df.count()


def test_stages_judge_each_row_by_its_own_text(spark, bench, tmp_path):
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    one, two, leak = "the first text has enough words to be compared", "a second text that is nothing like it at all", f"see {ITEM} there"
    rows = [(5, one), (5, two), (5, one), (None, one), (None, two), (None, "a lone text without any number of its own"), (None, leak), (6, one), (7, leak), (7, "harmless words under a known id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stages = dict(corpus_pipeline.STAGES)
    got = [tuple(r) for r in stages["near_duplicates"](spark, docs, str(tmp_path)).collect()]
    assert sorted(t for _, t in got) == sorted({t for _, t in rows})
    assert {d for d, t in got if t in (one, two)} <= {5, 6} and (7, leak) in got and (None, leak) not in got
    got = [tuple(r) for r in stages["decontamination"](spark, docs, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(str(r) for r in rows if r[1] != leak)
