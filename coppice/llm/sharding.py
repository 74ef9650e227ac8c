"""Sharding by balanced label propagation.

Linked documents (members of a hub; here: equal texts) move to the shard that most of their neighbours are in, as
far as capacity allows; row counts of any two shards end at most one apart (law `rows`).

- All linked documents start in a shard by a hash. Every hub tallies its members' shards; as all members of a hub are
  neighbours of one another, its tally stays the same until it moves.
- In each round every hub that hasn't moved yet wishes for the shard that has most of its members among those with room
  for all of it (or, if none of these has, for any that has). Wishes are granted, larger hubs first, while the shard's quota lasts (a
  running sum over classes of size and hash buckets); a granted hub holds its room whatever else stands there, as all that
  stands there moves as well. So moves are exchanges, and need no empty shards.
- A hub that no shard has room for is cut into parts of the largest room there is, each of which is a hub of its
  own from then on. Rounds end when every hub has moved; each grants at least the first wish for every shard wished for.
- Documents without links fill what is left of the quotas.

All of it is grouped counts, equi-joins and ranks in buckets; the driver sees one row for each shard. Null text counts as
empty text; rows with a null doc_id and repeated rows are placed like any other (equal texts belong together); an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common


def _by_ranges(rank: Column, sizes: Iterable[tuple[int, int]]) -> Column:
    """The shard of a rank, where shards take ranks in turn: (shard, how many)."""
    out, end = None, 0
    for shard, n in sizes:
        if n > 0:
            end += n
            out = F.when(rank < end, shard) if out is None else out.when(rank < end, shard)
    return (out if out is not None else F.lit(None)).cast("int")


def quotas(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def cut(members: DataFrame, large: DataFrame, room: int, first: int, buckets: int) -> DataFrame:
    """(uid, hub, part, start): members of the large hubs (hub, part) in parts of `room`, numbered from `first` on."""
    some = members.join(large.select("hub", "part"), ["hub", "part"])
    ranked = common.blocked_rank(some, ["hub", "part"], [F.col("uid")], "rank", buckets)
    return ranked.select("uid", "hub", (F.expr(f"rank div {room}") + first).alias("part"), "start")


def propagate(members: DataFrame, quota: list[int], buckets: int = 256) -> tuple[DataFrame, list[int]]:
    """Label propagation under quotas. members: (uid, hub, part, start), a written table with part 0; quotas hold all of it.

    Returns (uid, shard) and what is left of each quota.
    """
    spark, shards, room = members.sparkSession, len(quota), list(quota)
    made, generations, placements, first = [], [members], [], 1

    def keep(df: DataFrame, tag: str) -> DataFrame:
        made.append(common.staged(df, tag))
        return made[-1]

    def tally(df: DataFrame) -> DataFrame:
        return keep(df.groupBy("hub", "part", "start").agg(F.count("*").alias("c")), "tally")

    votes = [tally(members)]
    waiting = keep(votes[0].groupBy("hub", "part").agg(F.sum("c").alias("m")), "waiting")
    turn = 0
    while waiting.limit(1).count():
        most = max(room)
        if (large := waiting.where(F.col("m") > most)).limit(1).count():
            # one generation cuts parts of one hub one after the other, so that their new numbers can't meet
            one = large.groupBy("hub").agg(F.min("part").alias("part"))
            parts = keep(cut(_union(generations), one, most, first, buckets), "cut")
            first = parts.agg(F.max("part")).first()[0] + 1
            generations.append(parts)
            votes.append(tally(parts))
            rest = waiting.join(one, ["hub", "part"], "left_anti")
            waiting = keep(rest.union(votes[-1].groupBy("hub", "part").agg(F.sum("c").alias("m"))), "waiting")
            continue
        rooms = F.array(*map(F.lit, room))
        by_room = sorted(range(shards), key=lambda s: -room[s])
        fits = F.size(F.filter(rooms, lambda r: r >= F.col("m")))
        any_shard = F.element_at(F.array(*map(F.lit, by_room)), (F.pmod(F.xxhash64("hub", "part", F.lit(turn)), fits.cast("long")) + 1).cast("int"))
        tie = F.xxhash64("hub", "part", "start", F.lit(turn))
        voted = _union(votes).join(waiting, ["hub", "part"]).where(F.element_at(rooms, F.col("start") + 1) >= F.col("m"))
        voted = voted.groupBy("hub", "part").agg(F.max(F.struct("c", tie.alias("tie"), "start")).alias("w")).select("hub", "part", F.col("w.start").alias("voted"))
        wish = waiting.join(voted, ["hub", "part"], "left").select("hub", "part", "m", F.coalesce("voted", any_shard).alias("shard"))
        turn_of = (64 - F.floor(F.log2("m"))) * buckets + F.pmod(F.xxhash64("part", "hub", F.lit(turn)), F.lit(buckets))
        wish = keep(wish.withColumn("bucket", turn_of), "wishes")
        sums = wish.groupBy("shard", "bucket").agg(F.sum("m").alias("n"))  # at most shards * buckets * classes rows
        sums = sums.withColumn("base", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).drop("n")
        run = F.sum("m").over(Window.partitionBy("shard", "bucket").orderBy("hub", "part").rowsBetween(Window.unboundedPreceding, 0))
        granted = wish.withColumn("run", run).join(sums, ["shard", "bucket"]).where(F.col("base") + F.col("run") <= F.element_at(rooms, F.col("shard") + 1))
        placements.append(keep(granted.select("hub", "part", F.col("shard").cast("int").alias("shard"), "m"), "granted"))
        for row in placements[-1].groupBy("shard").agg(F.sum("m").alias("n")).collect():  # at most a row for each shard
            room[row["shard"]] -= row["n"]
        waiting = keep(waiting.join(placements[-1].select("hub", "part"), ["hub", "part"], "left_anti"), "waiting")
        turn += 1
    if not placements:
        return common.empty(spark, "uid long, shard int"), room
    # a hub that was cut has no place itself, only its last parts have
    whole = keep(_union(placements).select("hub", "part", "shard"), "places")
    placed = common.staged(_union(generations).join(whole, ["hub", "part"]).select("uid", "shard"), "placed")
    common.release(*made)
    return placed, room


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, frames)


def balanced_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: a row per input row."""
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), body.alias("body"))
    # sha1 decides which texts are equal; its number stands for it as hub
    rows = rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", (F.octet_length("body") + 16).cast("long").alias("size"), F.crc32("body").alias("text_crc32"), F.sha1("body").alias("sha"))
    rows = common.staged(rows, "shard-rows")
    total = rows.count()
    buckets = max(256, total // 1_000_000)  # of ranks: only how many tasks share them
    groups = common.staged(rows.groupBy("sha").agg(F.count("*").alias("m"), F.min("uid").alias("hub")).where("m > 1"), "hubs")
    start = F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int")
    linked = common.staged(rows.join(groups, "sha").select("uid", "hub", F.lit(0).cast("long").alias("part"), start.alias("start")), "linked")
    placed, free = propagate(linked, quotas(total, shards), buckets)
    lone = rows.join(groups.select("sha"), "sha", "left_anti").select("uid")
    lone = common.blocked_rank(lone, [], [F.col("uid")], "rank", buckets)
    every = placed.union(lone.select("uid", _by_ranges(F.col("rank"), enumerate(free)).alias("shard")))
    every = common.staged(every, "shards")
    common.release(groups, linked, placed)
    slots = common.blocked_rank(every, ["shard"], [F.col("uid")], "slot", buckets)
    return rows.join(slots, "uid").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(common.read_table(spark, sf_dir, "documents"))
