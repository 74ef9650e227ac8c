"""The queries of this package and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import caps, decontam, neardup, packing, quality, secrets, sharding, tokenfile, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": tokenfile.op1_token_files,
    "op2_minhash_near_dedup": neardup.op2_minhash_near_dedup,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_template_decontamination": decontam.op4_template_decontamination,
    "op5_balanced_shards": sharding.op5_balanced_shards,
    "op6_spherical_caps": caps.op6_spherical_caps,
    "op7_toxicity_subwords": toxicity.op7_toxicity_subwords,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_ordinal_quality": quality.op9_ordinal_quality,
    "op10_warc_segments": warc.op10_warc_segments,
}

SQL: dict[str, str] = {"op2_minhash_near_dedup": neardup.SQL, "op6_spherical_caps": caps.SQL, "op10_warc_segments": warc.SQL}
