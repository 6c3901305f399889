"""Mixing sources to target weights: blocks apportioned by highest quotients, then seeded selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumentab.llm.words import WORD, count_words


def apportion(parties: DataFrame, group: list[str], votes: str, seats: str, order: str) -> DataFrame:
    """``parties`` with ``quota``: integer seats by highest quotients ``votes / (2k + 1)``.

    Within a group, ``seats`` seats go one by one to the party with the highest quotient, k
    being the seats it has; equal quotients go by ``order``. The result is found without
    counting seats one by one: with n parties the price of a seat makes the rounded shares sum
    to ``seats``, so each party's share of ``seats - n/2`` and of ``seats + n/2`` bounds its
    quota; only the quotients between the bounds, about three per party, are ranked.
    Parties without votes get none; a group without votes gets none.
    """
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    wide = (
        parties.withColumn("_all", F.sum(votes).over(w).cast("double"))
        .withColumn("_half", F.count(F.lit(1)).over(w) / 2.0)
        .withColumn("_low", F.when(F.col("_all") > 0, F.greatest(F.lit(0.0), F.floor(F.col(votes) / F.col("_all") * F.greatest(F.lit(0.0), F.col(seats) - F.col("_half")) - 0.501))).otherwise(0.0).cast("bigint"))
        .withColumn("_high", F.when(F.col(votes) > 0, F.ceil(F.col(votes) / F.col("_all") * (F.col(seats) + F.col("_half")) + 0.501)).otherwise(0).cast("bigint"))
    )
    wide = wide.withColumn("_left", F.col(seats) - F.sum("_low").over(w))
    ladder = F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low"), F.col("_high") - 1)).otherwise(F.array().cast("array<bigint>"))
    keys = [*group, order]
    steps = wide.select(*keys, "_left", votes, F.explode(ladder).alias("_k")).withColumn("_q", F.col(votes) / (2 * F.col("_k") + 1))
    rank = F.row_number().over((Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(F.desc("_q"), F.asc_nulls_last(order), "_k"))
    won = steps.withColumn("_rank", rank).filter("_rank <= _left").groupBy(*keys).agg(F.count(F.lit(1)).alias("_won"))
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    kept = [F.col(f"p.{c}") for c in parties.columns]
    return wide.alias("p").join(won.alias("w"), condition, "left").select(*kept, (F.col("p._low") + F.coalesce("w._won", F.lit(0))).alias("quota"))


def source_targets(sizes: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """``source, source_size, n_docs, target`` from one row per source.

    Sources by code point, nulls last, take the weights in turn. They share ``share`` of all
    words; a target stops at ``most`` times its source's size and what is over goes to the
    others by weight. Filling in order of cap per weight needs no rounds: a source is capped
    when all before it at their caps and the rest at its level cost no more than the total.
    The windows run over one row per source.
    """
    all_sources = Window.partitionBy(F.lit(0))
    place = F.row_number().over(all_sources.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    level = all_sources.orderBy("_ratio", F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    capped = (F.col("_caps") + F.col("_ratio") * F.greatest(F.col("_weights") - F.col("_upto"), F.lit(0.0))) <= F.col("_total")
    t = (
        sizes.withColumn("_w", weight)
        .withColumn("_cap", F.col("source_size") * float(most))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_total", F.sum("source_size").over(all_sources) * float(share))
        .withColumn("_caps", F.sum("_cap").over(level))
        .withColumn("_upto", F.sum("_w").over(level))
        .withColumn("_weights", F.sum("_w").over(all_sources))
        .withColumn("_capped", capped)
        .withColumn("_rest", F.col("_total") - F.sum(F.when(F.col("_capped"), F.col("_cap")).otherwise(0.0)).over(all_sources))
        .withColumn("_open", F.sum(F.when(~F.col("_capped"), F.col("_w")).otherwise(0.0)).over(all_sources))
    )
    target = F.when(F.col("_capped"), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_rest") * F.col("_w") / F.col("_open")))
    return t.select("source", "source_size", "n_docs", target.alias("target"))


def _overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.greatest(F.lit(0), F.least(b, d) - F.greatest(a, c)).cast("bigint")


def draw(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] = (), weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, block_words: int = 64, shard_docs: int = 4096, seed: int = 17, salts: int = 32) -> DataFrame:
    """``doc_id, size, source, source_size, target, taken, pieces`` and the columns in ``keep``.

    The words of a source are dealt to shards of about ``shard_docs`` documents by a hash of id
    and text, so a source with a third of all rows becomes many shards. A block has ``block_words``
    words, or fewer where the smallest target is below 32 such blocks: then a 32nd of it, at least
    one word, so that every source comes within about a block of its target. Blocks go to sources by Sainte-Lague quotients of their targets, and a source's blocks go to its
    shards by the quotients of their sizes. In a shard the documents stand in seeded order on a
    ring that repeats them ``most`` = 2 times; the shard's quota is the run of blocks from a
    seeded block on. So no document is taken more than twice, few documents are cut, and a rerun
    gives the same words. ``pieces`` lists the word ranges ``from, to`` that are taken.

    Defined cases: null text has size 0 and is never taken; a null source is a source of its
    own, the last; documents without words get 0; an empty table gives no rows; repeated rows
    are drawn as rows of their own; equal seeded places go by id, then size, then text; rows
    equal in all three may change places, which changes no text of the mix.
    """
    if most != 2.0:
        raise ValueError("the ring repeats a shard twice; most has to be 2.0")
    size = count_words(F.col(text_col))
    own = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), own.alias("own"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    targets = source_targets(per_source, list(weights), share, most)
    everything = Window.partitionBy(F.lit(0))
    smallest = F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything)
    targets = targets.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block_words), F.coalesce(F.floor(smallest / 32), F.lit(1)))).cast("bigint"))
    targets = targets.withColumn("blocks", F.round(F.sum("target").over(everything) / F.col("block")).cast("bigint"))
    quotas = apportion(targets, [], "target", "blocks", "source").withColumnRenamed("quota", "source_quota")
    quotas = quotas.withColumn("shards", F.ceil(F.col("n_docs") / shard_docs)).drop("blocks")

    # a source with very many rows meets its quota in ``salts`` tasks
    salted = quotas.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.col("own"), F.lit(salts)).cast("int")
    joined = sized.withColumn("salt", salt).alias("d").join(salted.alias("q"), F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d.salt") == F.col("q.salt")))
    shard = F.pmod(F.xxhash64("own"), F.col("shards"))
    dealt = joined.select("d.*", "q.source_size", "q.target", "q.source_quota", "q.block", shard.alias("shard")).drop("salt")
    keys = ["source", "shard"]
    per_shard = dealt.groupBy(*keys, "source_quota", "block").agg(F.sum("size").alias("words"))
    per_shard = apportion(per_shard, ["source"], "words", "source_quota", "shard").select(*keys, "words", "quota")

    ring = F.col("words") * 2
    start = F.floor(F.pmod(F.xxhash64(F.lit(seed + 1), F.col("source"), F.col("shard")), F.greatest(F.lit(1), F.ceil(ring / F.col("block"))))) * F.col("block")
    length = F.least(F.col("quota") * F.col("block"), ring)
    line = Window.partitionBy("d.source", "d.shard").orderBy(F.xxhash64(F.lit(seed + 2), F.col("own")), "doc_id", "size", "own").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.shard") == F.col("s.shard"))
    placed = (
        dealt.alias("d").join(per_shard.alias("s"), same)
        .select("d.*", "s.words", "s.quota", (F.sum("size").over(line) - F.col("size")).alias("at"))
        .withColumn("start", start).withColumn("end", F.col("start") + length)
    )
    lap = lambda k: (F.col("at") + F.col("words") * k, F.col("at") + F.col("words") * k + F.col("size"))
    ranges = []
    for k in (0, 1):
        a, b = lap(k)
        for lo, hi in ((F.col("start"), F.least("end", ring)), (F.lit(0), F.col("end") - ring)):
            n = _overlap(a, b, lo, hi)
            first = F.greatest(a, lo) - a
            ranges.append(F.struct(first.cast("bigint").alias("from"), (first + n).cast("bigint").alias("to")))
    pieces = F.filter(F.array(*ranges), lambda p: p["to"] > p["from"])
    taken = F.aggregate(F.col("pieces"), F.lit(0).cast("bigint"), lambda n, p: n + p["to"] - p["from"])
    return placed.withColumn("pieces", pieces).withColumn("taken", taken).select(
        F.col("doc_id").alias(id_col), "size", "source", "source_size", "target", "taken", "pieces", *[F.col(f"_keep_{c}").alias(f"_keep_{c}") for c in keep]
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: columns of ``documents``, one row per taken piece, cut texts by their words.

    A piece that is the whole document keeps the text as it is; a part is its words joined by
    one space, and ``n_chars`` follows it.
    """
    drawn = draw(docs, keep=["text", "lang", "n_chars"], **options)
    rows = drawn.withColumn("piece", F.explode("pieces"))
    whole = (F.col("piece.from") == 0) & (F.col("piece.to") == F.col("size"))
    words = F.regexp_extract_all(F.col("_keep_text"), F.lit(f"({WORD})"), 1)
    part = F.array_join(F.slice(words, (F.col("piece.from") + 1).cast("int"), (F.col("piece.to") - F.col("piece.from")).cast("int")), " ")
    rows = rows.withColumn("text", F.when(whole, F.col("_keep_text")).otherwise(part)).withColumn("whole", whole)
    n_chars = F.when(F.col("whole"), F.col("_keep_n_chars")).otherwise(F.length("text")).cast("bigint")
    return rows.select("doc_id", "text", F.col("_keep_lang").alias("lang"), "source", n_chars.alias("n_chars"))
