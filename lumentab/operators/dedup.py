"""Exact and near-duplicate search, groups and their reports."""

from __future__ import annotations

from collections import Counter
from itertools import combinations
from math import comb
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumentab.operators.graph import components
from lumentab.operators.ranking import row_numbers, running_sums
from lumentab.operators.splits import group_owners, grouped_split
from lumentab.session import cut_lineage

REASON = "same bytes under several classes"
ACTION = "leave out of every split"


# ---- exact duplicates -------------------------------------------------------------------


def duplicate_groups(items: DataFrame, digest: str = "digest", label: str = "label") -> DataFrame:
    """Digests held by two or more items, with their sorted class list."""
    groups = items.groupBy(digest).agg(F.count("*").alias("items"), F.sort_array(F.collect_set(label)).alias("classes"))
    return groups.filter("items >= 2").withColumn("cross_class", F.size("classes") > 1)


def duplicate_summary(items: DataFrame, digest: str = "digest", label: str = "label") -> DataFrame:
    groups = items.groupBy(digest).agg(F.count("*").alias("n"), (F.min(label) != F.max(label)).alias("cross"))
    dup = F.col("n") >= 2
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    return groups.agg(
        F.sum("n").alias("total_items"), F.count("*").alias("unique_digests"), count(dup).alias("duplicate_groups"),
        F.sum(F.when(dup, F.col("n")).otherwise(0)).alias("duplicate_items"),
        F.sum(F.when(dup, F.col("n") - 1).otherwise(0)).alias("removable_copies"),
        count(dup & ~F.col("cross")).alias("same_class_groups"), count(dup & F.col("cross")).alias("cross_class_groups"),
    )


def conflict_members(items: DataFrame, digest: str = "digest", label: str = "label", numbered: bool = False) -> DataFrame:
    """Members of cross-class groups; ``numbered`` adds the group's place by digest among all duplicate groups."""
    groups = items.groupBy(digest).agg(F.count("*").alias("n"), (F.min(label) != F.max(label)).alias("cross")).filter("n >= 2")
    if not numbered:
        return items.join(groups.filter("cross").select(digest), digest, "left_semi")
    numbered = row_numbers(groups, [digest], "group_number").filter("cross")
    return items.join(numbered.select(digest, "group_number"), digest)


def exclusions(conflicts: DataFrame, key: str) -> DataFrame:
    return conflicts.select(key, "label", "digest", F.lit(REASON).alias("reason"), F.lit(ACTION).alias("action"))


# ---- near duplicates --------------------------------------------------------------------


def block_masks(radius: int, picks: int = 1, bits: list[int] | None = None) -> list[int]:
    """Bit masks such that two 64-bit numbers within ``radius`` agree on at least one.

    The bits are dealt in turn to radius + picks blocks; at most ``radius`` blocks can
    differ, so some ``picks`` blocks agree. Dealing in turn spreads runs of constant bits
    (plain image regions) over all blocks; ``bits`` may give another order, most balanced
    first. More picks give longer keys (fewer candidates) and more copies of each row.
    """
    blocks = radius + picks
    parts = [0] * blocks
    for place, bit in enumerate(bits or range(64)):
        parts[place % blocks] |= 1 << bit
    return [sum(c) for c in combinations(parts, picks)]


def balanced_bits(rows: DataFrame, *columns: str) -> tuple[int, list[list[int]]]:
    """Number of rows, and per column the bits of a hash from most to least balanced (64 counts each reach the driver)."""
    ones = rows.agg(F.count("*"), *[F.sum(F.shiftright(F.col(c), i).bitwiseAND(F.lit(1))) for c in columns for i in range(64)]).first()
    n = ones[0] or 1
    return ones[0], [sorted(range(64), key=lambda i: (abs((ones[64 * k + i + 1] or 0) / n - 0.5), i)) for k in range(len(columns))]


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask).cast("bigint")


def _first_agreeing(diff: Column, masks: list[int]) -> Column:
    """Index of the first mask on which the two numbers agree."""
    out = F.when(diff.bitwiseAND(_signed(masks[0])) == 0, F.lit(0))
    for i, m in enumerate(masks[1:], start=1):
        out = out.when(diff.bitwiseAND(_signed(m)) == 0, F.lit(i))
    return out


def _masked(masks: list[tuple[int, int, int]]) -> Column:
    """Array of join keys, one per (band, mask of phash, mask of dhash)."""
    table = F.array(*[F.struct(F.lit(b).alias("band"), _signed(p).alias("p"), _signed(d).alias("d")) for b, p, d in masks])
    return F.transform(table, lambda m: F.struct(
        m["band"].alias("band"), F.col("phash").bitwiseAND(m["p"]).alias("pk"), F.col("dhash").bitwiseAND(m["d"]).alias("dk")))


def _sample(codes: DataFrame, n: int, size: int) -> DataFrame:
    """About ``size`` of ``n`` codes, the same at every run."""
    return codes.filter(F.pmod(F.xxhash64("phash", "dhash"), F.lit(1 << 20)) < max(1, min(1 << 20, (size << 20) // max(n, 1))))


#: A copy of a row that is shuffled and sorted costs about as much as comparing so many pairs.
COPY = 50
#: Codes on which the collisions of a key are measured, and masks tried per choice of blocks.
MEASURED, TRIED = 16384, 3
#: Blocks of phash that cut a crowded bucket further.
FINE = 3


def _bands(limits: tuple[int, int], picks: tuple[int, int], bits: list) -> tuple[list[int], list[int]]:
    return block_masks(limits[0], picks[0], bits[0]), block_masks(limits[1], picks[1], bits[1])


def key_choice(codes: DataFrame, limits: tuple[int, int], bits: list, hot: int, n: int, copy: float = COPY, most_keys: int = 1024) -> tuple[int, int]:
    """How many agreeing blocks of phash and of dhash make a join key.

    Longer keys mean fewer candidates and more copies of a code. On a bounded sample of
    codes the chance that two codes share a key is measured for every choice of blocks;
    times the number of codes it gives the candidates of a code and key. The choice with the
    least copies plus candidates wins, so keys grow with the corpus and the candidates of a
    code do not. Buckets that would be cut further (``hot``) count as the copies that takes.
    """
    fine = comb(limits[0] + FINE, FINE)
    options = [(p, d) for p in range(5) for d in range(5 - p) if p + d and comb(limits[0] + p, p) * comb(limits[1] + d, d) <= most_keys]
    tried, keys = [], {}
    for o, picks in enumerate(options):
        pm, dm = _bands(limits, picks, bits)
        pairs = [(p, d) for p in pm for d in dm]
        some = pairs[:: -(-len(pairs) // TRIED)]
        keys[picks] = len(pairs), len(some)
        tried += [(o * TRIED + i, p, d) for i, (p, d) in enumerate(some)]
    held = _sample(codes, n, MEASURED).select(F.explode(_masked(tried)).alias("key")).groupBy("key").agg(F.count("*").alias("held"))
    # bucket sizes of a bounded sample: at most a few hundred different ones per mask
    sizes = held.groupBy("key.band", "held").agg(F.count("*").alias("buckets")).collect()
    meet, crowd = Counter(), Counter()
    m = sum(r["held"] * r["buckets"] for r in sizes) / max(len(tried), 1)
    for r in sizes:
        rows, picks = r["held"] * r["buckets"], options[r["band"] // TRIED]
        if r["held"] * n >= hot * m:
            crowd[picks] += rows / m
        else:
            meet[picks] += rows * (r["held"] - 1) / max(m * (m - 1), 1)

    def cost(picks):
        number, some = keys[picks]
        return number * (copy + meet[picks] / some * n + crowd[picks] / some * fine * copy)

    return min(options, key=cost)


def hash_codes(hashes: DataFrame) -> DataFrame:
    """One row per distinct (phash, dhash): first image id, image count, count per class.

    Copies collapse here, before any pairing, so a group of identical images costs one row.
    """
    per_class = hashes.groupBy("phash", "dhash", "class_index").agg(F.count("*").alias("n"), F.min("image_id").alias("first_id"))
    return per_class.groupBy("phash", "dhash").agg(
        F.min("first_id").alias("code_id"), F.sum("n").alias("n"),
        F.map_from_entries(F.collect_list(F.struct("class_index", "n"))).alias("classes"),
    )


class CodeKeys(NamedTuple):
    """Codes with their join keys: ``rows``, the columns to join ``on``, the masks behind them."""

    rows: DataFrame
    on: list[str]
    phash: list[int]
    dhash: list[int]
    fine: list[int]


def code_keys(codes: DataFrame, phash_limit: int, dhash_limit: int, picks: int | tuple[int, int] | None = None, hot: int | None = None, copy: float = COPY) -> CodeKeys:
    """A row per code and key, so that codes within both limits share a key.

    A key is some blocks of phash and dhash, ``picks`` of each, by default as many as suit
    the codes (``key_choice``). Keys held by about ``hot`` codes or more (estimated on a
    hashed 1/16 of the codes) get further phash blocks appended, cut along the bits that vary
    most inside those buckets; by default those where comparing all pairs costs more than
    the copies.
    """
    limits = (phash_limit, dhash_limit)
    hot = hot or int(comb(phash_limit + FINE, FINE) * copy)
    bits = [None, None]
    if picks is None:
        n, bits = balanced_bits(codes, "phash", "dhash")
        picks = key_choice(codes, limits, bits, hot, n, copy)
    pm, dm = _bands(limits, (picks, picks) if isinstance(picks, int) else picks, bits)
    bands = _masked([(i * len(dm) + j, p, d) for i, p in enumerate(pm) for j, d in enumerate(dm)])
    key = ["band", "pk", "dk"]

    def keyed(rows: DataFrame) -> DataFrame:
        return rows.select("code_id", "phash", "dhash", F.explode(bands).alias("key")).select("code_id", "phash", "dhash", "key.*")

    sampled = keyed(codes.filter(F.pmod(F.xxhash64("phash", "dhash"), F.lit(16)) == 0))
    crowded = sampled.groupBy(*key).agg(F.count("*").alias("held")).filter(F.col("held") >= max(hot // 16, 2)).select(*key, F.lit(True).alias("hot"))
    ready = keyed(codes)
    crowded = cut_lineage(crowded)
    if crowded.isEmpty():
        return CodeKeys(ready, key, pm, dm, [])
    fine = block_masks(phash_limit, FINE, balanced_bits(sampled.join(crowded, key, "left_semi"), "phash")[1][0])
    plain = F.array(F.struct(F.lit(-1).alias("fine"), F.lit(0).cast("bigint").alias("fk")))
    split = F.array(*[F.struct(F.lit(i).alias("fine"), F.col("phash").bitwiseAND(_signed(m)).alias("fk")) for i, m in enumerate(fine)])
    marked = ready.join(crowded, key, "left").withColumn("f", F.explode(F.when(F.col("hot"), split).otherwise(plain)))
    return CodeKeys(marked.select("*", "f.*").drop("f", "hot"), [*key, "fine", "fk"], pm, dm, fine)


def near_code_pairs(codes: DataFrame, phash_limit: int = 6, dhash_limit: int = 6, **keys) -> DataFrame:
    """Pairs of distinct codes within both Hamming limits, each found exactly once.

    A pair shares several keys; only the first shared one reports it, so no distinct is
    needed. A crowded key is cut by further blocks, which is complete by the same counting,
    so no bucket is paired out whole. ``codes`` is read several times: write it first.
    ``first`` and ``second`` name the codes; their first image ids are equal where an id
    occurs in both.
    """
    k = code_keys(codes, phash_limit, dhash_limit, **keys)
    side = lambda n: k.rows.select(*k.on, F.col("code_id").alias(f"{n}_id"), F.col("phash").alias(f"p_{n}"), F.col("dhash").alias(f"d_{n}"))
    place = lambda n: F.struct(f"{n}_id", F.col(f"p_{n}").alias("phash"), F.col(f"d_{n}").alias("dhash"))
    pdiff, ddiff = F.col("p_first").bitwiseXOR(F.col("p_second")), F.col("d_first").bitwiseXOR(F.col("d_second"))
    # merge join: the planner does not count the copies per row, so its size check is void here
    pairs = side("first").hint("merge").join(side("second"), k.on).filter(place("first") < place("second"))
    pairs = pairs.withColumns({"phash_distance": F.bit_count(pdiff), "dhash_distance": F.bit_count(ddiff)})
    near = pairs.filter((F.col("phash_distance") <= phash_limit) & (F.col("dhash_distance") <= dhash_limit))
    once = F.col("band") == _first_agreeing(pdiff, k.phash) * len(k.dhash) + _first_agreeing(ddiff, k.dhash)
    if k.fine:
        once = once & ((F.col("fine") == -1) | (F.col("fine") == _first_agreeing(pdiff, k.fine)))
    code = lambda n: F.struct(F.col(f"p_{n}").alias("phash"), F.col(f"d_{n}").alias("dhash")).alias(n)
    return near.filter(once).select("first_id", "second_id", code("first"), code("second"), "phash_distance", "dhash_distance")


def _code() -> Column:
    """A code in joins: its two hashes, since the first image id may stand in several codes."""
    return F.struct("phash", "dhash")


#: Columns of a compact pair row but its counts.
ROW = ["first_id", "second_id", "phash_distance", "dhash_distance", "first_n", "second_n"]


def _half(c: Column) -> Column:
    return F.shiftright(c * (c - 1), 1)


def repeated_ids(hashes: DataFrame) -> DataFrame | None:
    """Rows per image id, code and class of the ids that stand in several rows, None when there are none.

    Two rows of one id are one image, not a pair.
    """
    several = hashes.groupBy("image_id").agg(F.count("*").alias("_rows")).filter("_rows > 1").select("image_id")
    held = hashes.join(several, "image_id", "left_semi").groupBy("image_id", _code().alias("code"), "class_index").agg(F.count("*").alias("m"))
    held = cut_lineage(held)
    return None if held.isEmpty() else held


def copied_codes(codes: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """One row per code held by several images: the pairs inside it, at distance 0."""
    n = F.col("n")
    copied = codes.filter("n > 1").select(
        F.col("code_id").alias("first_id"), F.col("code_id").alias("second_id"), _code().alias("first"), _code().alias("second"),
        F.lit(0).alias("phash_distance"), F.lit(0).alias("dhash_distance"),
        n.alias("first_n"), n.alias("second_n"), _half(n).alias("pairs"),
        F.aggregate(F.map_values("classes"), F.lit(0).cast("bigint"), lambda acc, c: acc + _half(c)).alias("same_class_pairs"),
    )
    if repeated is None:
        return copied
    per_id = repeated.groupBy("image_id", "code").agg(_half(F.sum("m")).alias("a"), F.sum(_half(F.col("m"))).alias("s"))
    own = per_id.groupBy(F.col("code").alias("first")).agg(F.sum("a").alias("_pairs"), F.sum("s").alias("_same"))
    return _less(copied.join(own, "first", "left"), copied.columns)


def _less(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Pair counts without the pairs of an id with itself; rows that stand for no other pair go."""
    rest = lambda c, d: (F.col(c) - F.coalesce(d, F.lit(0))).alias(c)
    counts = {"pairs": rest("pairs", "_pairs"), "same_class_pairs": rest("same_class_pairs", "_same")}
    return pairs.select(*[counts.get(c, c) for c in columns]).filter("pairs > 0")


def _shared(repeated: DataFrame, phash_limit: int, dhash_limit: int) -> DataFrame:
    """Per pair of near codes the pairs of rows that have one id; its size follows the codes per id."""
    side = lambda n: repeated.select("image_id", F.col("code").alias(n), F.col("class_index").alias(f"c_{n}"), F.col("m").alias(f"m_{n}"))
    far = lambda h: F.bit_count(F.col(f"first.{h}").bitwiseXOR(F.col(f"second.{h}")))
    met = side("first").join(side("second"), "image_id").filter((F.col("first") != F.col("second")) & (far("phash") <= phash_limit) & (far("dhash") <= dhash_limit))
    n = F.col("m_first") * F.col("m_second")
    return met.groupBy("first", "second").agg(F.sum(n).alias("_pairs"), F.sum(F.when(F.col("c_first") == F.col("c_second"), n).otherwise(0)).alias("_same"))


def _turned(tied: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of codes with one first id, once per direction: ``first`` is the code of the pair's smaller image.

    Smaller images of the first code are counted before each image of the second by running
    sums, so no code is paired out.
    """
    key = ["first", "second"]
    held = members.groupBy("code", "image_id", "class_index").agg(F.count("*").alias("m"))
    # images of the second code come before those of the first with the same id
    at = lambda n, side: tied.select(*key, F.col(n).alias("code")).join(held, "code").select(*key, "image_id", "class_index", F.lit(side).alias("side"), "m")
    rows = cut_lineage(at("first", 1).unionByName(at("second", 0)))
    order, firsts = ["image_id", "side", "class_index"], {"before": F.when(F.col("side") == 1, F.col("m")).otherwise(F.lit(0).cast("bigint"))}
    up = lambda keys, name: running_sums(rows, order, firsts, keys).filter("side = 0").groupBy(*key).agg(F.sum(F.col("m") * F.col("before")).alias(name))
    counted = tied.join(up(key, "_up"), key).join(up([*key, "class_index"], "_up_same"), key, "left").withColumn("_up_same", F.coalesce("_up_same", F.lit(0)))
    swap = {"first": "second", "second": "first", "first_n": "second_n", "second_n": "first_n"}
    forth = counted.select(*[c for c in tied.columns if "pairs" not in c], F.col("_up").alias("pairs"), F.col("_up_same").alias("same_class_pairs"))
    back = counted.select(*[F.col(swap.get(c, c)).alias(c) for c in tied.columns if "pairs" not in c],
                          (F.col("pairs") - F.col("_up")).alias("pairs"), (F.col("same_class_pairs") - F.col("_up_same")).alias("same_class_pairs"))
    return forth.unionByName(back).filter("pairs > 0")


def _compact_pairs(codes: DataFrame, repeated: DataFrame | None, phash_limit: int = 6, dhash_limit: int = 6, **keys) -> DataFrame:
    """Pairs of codes, copied codes among them, with the image pairs that they stand for."""
    side = lambda p: codes.select(_code().alias(p), F.col("n").alias(f"{p}_n"), F.col("classes").alias(f"{p}_classes"))
    joined = near_code_pairs(codes, phash_limit, dhash_limit, **keys).join(side("first"), "first").join(side("second"), "second")
    same = F.aggregate(
        F.map_entries("first_classes"), F.lit(0).cast("bigint"),
        lambda acc, e: acc + e["value"] * F.coalesce(F.try_element_at("second_classes", e["key"]), F.lit(0)),
    )
    across = joined.select(
        "first_id", "second_id", "first", "second", "phash_distance", "dhash_distance", "first_n", "second_n",
        (F.col("first_n") * F.col("second_n")).alias("pairs"), same.alias("same_class_pairs"),
    )
    if repeated is not None:
        across = _less(across.join(_shared(repeated, phash_limit, dhash_limit), ["first", "second"], "left"), across.columns)
    return across.unionByName(copied_codes(codes, repeated))


def near_duplicates(hashes: DataFrame, **limits) -> DataFrame:
    """The pair list in compact form: one row per pair of codes and one per copied code.

    ``pairs`` and ``same_class_pairs`` count the image pairs a row stands for, so every
    total over image pairs is a sum here, and no group is ever paired out. An image id may
    stand in several rows, with several codes: these are no pairs. Codes are named by their
    first image; rows that agree in all but the counts are one.
    """
    hashes = cut_lineage(hashes)
    codes, repeated = cut_lineage(hash_codes(hashes)), repeated_ids(hashes)
    pairs = _compact_pairs(codes, repeated, **limits)
    if repeated is not None:
        pairs = cut_lineage(pairs)
        ties = (F.col("first_id") == F.col("second_id")) & (F.col("first") != F.col("second"))
        turned = _turned(pairs.filter(ties), hashes.select(_code().alias("code"), "image_id", "class_index"))
        pairs = pairs.filter(~ties).unionByName(turned).groupBy(*ROW).agg(F.sum("pairs").alias("pairs"), F.sum("same_class_pairs").alias("same_class_pairs"))
    return pairs.select(*ROW, "pairs", "same_class_pairs")


def near_summary(pairs: DataFrame, images: DataFrame) -> DataFrame:
    total = images.agg(F.count("*"))
    n = F.col("eligible_images")
    sums = pairs.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("candidate_pairs"), F.coalesce(F.sum("same_class_pairs"), F.lit(0)).alias("same_class_pairs"))
    return sums.withColumn("eligible_images", total.scalar()).select(
        "eligible_images", F.expr("eligible_images * (eligible_images - 1) div 2").alias("possible_pairs"),
        "candidate_pairs", "same_class_pairs", (F.col("candidate_pairs") - F.col("same_class_pairs")).alias("cross_class_pairs"),
    )


def _members(hashes: DataFrame) -> DataFrame:
    return hashes.select(_code().alias("code"), "image_id", "class_index")


def expand_pairs(pairs: DataFrame, members: DataFrame, product: int | None = None) -> DataFrame:
    """Image pairs of a compact pair list. Its size is the number of pairs asked for:
    filter ``pairs`` or ``members`` first when large copy groups are possible. ``product``
    keeps pairs whose members' ranks ``r`` have at most that product."""
    rank = F.lit(1) if product is None else F.col("r")
    a = members.select(F.col("code").alias("first"), F.col("image_id").alias("i1"), F.col("class_index").alias("c1"), rank.alias("r1"))
    b = members.select(F.col("code").alias("second"), F.col("image_id").alias("i2"), F.col("class_index").alias("c2"), rank.alias("r2"))
    j = pairs.select("first", "second", "phash_distance", "dhash_distance").join(a, "first").join(b, "second")
    j = j.filter(F.when(F.col("first") == F.col("second"), F.col("i1") < F.col("i2")).otherwise(F.col("i1") != F.col("i2")))
    if product is not None:
        j = j.filter(F.col("r1") * F.col("r2") <= product)
    flip = F.col("i1") > F.col("i2")
    pick = lambda x, y: F.when(flip, F.col(y)).otherwise(F.col(x))
    return j.select(
        pick("i1", "i2").alias("first_image"), pick("c1", "c2").alias("first_class"), pick("i2", "i1").alias("second_image"), pick("c2", "c1").alias("second_class"),
        "phash_distance", "dhash_distance", (F.col("c1") == F.col("c2")).alias("same_class"),
    )


def image_pairs(hashes: DataFrame, **limits) -> DataFrame:
    """The full pair list of a corpus whose copy groups are small."""
    hashes = cut_lineage(hashes)
    return expand_pairs(_compact_pairs(cut_lineage(hash_codes(hashes)), repeated_ids(hashes), **limits), _members(hashes))


def _smallest_pair(a: Column, b: Column, same: bool) -> Column:
    """Smallest (first, second) image pair of two codes by their class maps; each entry holds a class's first images.

    Of two lists the smallest ordered pair is that of their first images; where both begin
    with one image, as inside one code and class, it is that image and the next of either.
    """
    entry = lambda x, y: F.struct(F.least(x, y).alias("first_image"), F.greatest(x, y).alias("second_image"))
    inner = lambda e: F.transform(
        F.filter(b, lambda o: (o["class_index"] == e["class_index"]) if same else (o["class_index"] != e["class_index"])),
        lambda o: entry(e["ids"][0], F.when(o["ids"][0] != e["ids"][0], o["ids"][0]).otherwise(F.least(F.get(e["ids"], 1), F.get(o["ids"], 1)))),
    )
    return F.array_min(F.filter(F.flatten(F.transform(a, inner)), lambda p: p["first_image"] != p["second_image"]))


def closest_pairs(hashes: DataFrame, k: int, phash_limit: int = 6, dhash_limit: int = 6, **keys) -> DataFrame:
    """First k image pairs by (same class, total distance, phash distance, ids).

    Best first: equal codes, then codes at a total distance of 2, then all within the limits;
    it stops as soon as k pairs of different classes are sure, since nothing farther can come
    before them. Every code pair has at least one image pair, its smallest, so only the k code
    pairs with the smallest first pairs are needed; no level is expanded, however many pairs
    tie in it. Of these, the pair of the i-th and j-th image of two classes has at least
    i * j / 2 pairs before it, so few images of each take part.
    """
    hashes = cut_lineage(hashes)
    codes, repeated = cut_lineage(hash_codes(hashes)), repeated_ids(hashes)
    total = F.col("phash_distance") + F.col("dhash_distance")
    for radius in (0, 2, phash_limit + dhash_limit):
        limits = {"phash_limit": min(radius, phash_limit), "dhash_limit": min(radius, dhash_limit)}
        pairs = copied_codes(codes, repeated) if radius == 0 else _compact_pairs(codes, repeated, **limits, **keys)
        pairs = cut_lineage(pairs.filter(total <= radius))
        if (pairs.agg(F.sum(F.col("pairs") - F.col("same_class_pairs"))).first()[0] or 0) >= k:
            break
    by_class = Window.partitionBy("code", "class_index").orderBy("image_id")
    members = _members(hashes)
    firsts = members.withColumn("r", F.dense_rank().over(by_class)).filter("r <= 2").groupBy("code", "class_index").agg(F.sort_array(F.collect_set("image_id")).alias("ids"))
    firsts = firsts.groupBy("code").agg(F.collect_list(F.struct("class_index", "ids")).alias("entries"))
    side = lambda p: firsts.select(F.col("code").alias(p), F.col("entries").alias(f"{p}_entries"))
    joined = pairs.join(side("first"), "first").join(side("second"), "second")
    kinds = [F.struct(F.lit(s).alias("same_class"), _smallest_pair(F.col("first_entries"), F.col("second_entries"), s).alias("pair")) for s in (False, True)]
    ranked = joined.withColumn("kind", F.explode(F.array(*kinds))).filter("kind.pair is not null")
    order = ["kind.same_class", total, "phash_distance", "kind.pair"]
    # the first k code pairs, a bounded table
    kept = cut_lineage(ranked.orderBy(*order).limit(k).select("first", "second", "phash_distance", "dhash_distance").distinct())
    wanted = kept.select(F.explode(F.array("first", "second")).alias("code")).distinct()
    few = members.join(F.broadcast(wanted), "code").withColumn("r", F.dense_rank().over(by_class)).filter(F.col("r") <= 2 * k)
    found = expand_pairs(kept, few, 2 * k)
    return found.orderBy("same_class", total, "phash_distance", "first_image", "second_image").limit(k)


def similarity_components(hashes: DataFrame, **limits) -> DataFrame:
    """``image_id, class_index, component`` over the near-duplicate relation.

    Hashes come from whole images, so they are written once here, and so is the result,
    which groups, splits and reports all read. An id that stands in several codes links them.
    """
    hashes = cut_lineage(hashes)
    codes, repeated = cut_lineage(hash_codes(hashes)), repeated_ids(hashes)
    nodes, edges = codes.select(F.col("code_id").alias("id")), near_code_pairs(codes, **limits).select(F.col("first_id").alias("u"), F.col("second_id").alias("v"))
    if repeated is not None:
        placed = repeated.select("image_id", "code").join(codes.select(_code().alias("code"), F.col("code_id").alias("u")), "code")
        lowest = placed.groupBy("image_id").agg(F.min("u").alias("v"))
        nodes, edges = nodes.distinct(), edges.unionByName(placed.join(lowest, "image_id").select("u", "v"))
    labels = components(nodes, edges)
    code_of = codes.select("phash", "dhash", F.col("code_id").alias("id")).join(labels, "id").select("phash", "dhash", "component")
    return cut_lineage(hashes.join(code_of, ["phash", "dhash"]).select("image_id", "class_index", "component"))


def similarity_groups(labelled: DataFrame) -> DataFrame:
    """Group ids by (size descending, first image), group size and whether it is a real group."""
    sizes = labelled.groupBy("component").agg(F.count("*").alias("group_size")).withColumn("_neg", -F.col("group_size"))
    numbered = row_numbers(sizes, ["_neg", "component"], "_n").select(
        "component", "group_size", F.format_string("group_%04d", F.col("_n")).alias("group_id")
    )
    return labelled.join(numbered, "component").select("image_id", "class_index", "group_id", "group_size", (F.col("group_size") > 1).alias("is_similarity_group"))


def split_manifest(hashes: DataFrame, seed: int = 42, **limits) -> DataFrame:
    """Hashes to the leak-free split manifest: pairs, components, groups, grouped split.

    The group table is written once, since the split plan and the manifest both read it.
    """
    groups = cut_lineage(similarity_groups(similarity_components(hashes, **limits)))
    placed = grouped_split(group_owners(groups), seed).select("group_id", "split")
    return groups.join(placed, "group_id").select("image_id", "class_index", "group_id", "group_size", "split")


def group_size_report(groups: DataFrame) -> DataFrame:
    """Per group size: groups, and how many of them hold more than one class."""
    per = groups.groupBy("group_id").agg(F.count("*").alias("group_size"), (F.min("class_index") != F.max("class_index")).alias("cross"))
    return per.groupBy("group_size").agg(F.count("*").alias("groups"), F.sum(F.col("cross").cast("bigint")).alias("cross_class_groups"))
