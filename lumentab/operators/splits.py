"""Dataset splits, sampling plans and their audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumentab.functions.numeric import let
from lumentab.operators.ranking import row_numbers
from lumentab.session import cut_lineage

SPLITS = ("train", "validation", "test")
PERCENT = (70, 15, 15)
BISECTION_STEPS = 62


def seeded_key(seed: int | str, *cols: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def _fill(deficits: Column, step: Column, n: Column) -> Column:
    """How many of ``n`` equal groups each split receives when every group goes to the
    largest remaining deficit (``deficits`` is an array in split order).

    Split k's t-th group is taken at level d_k - t*step, so the n groups are the n highest
    levels of three falling sequences. The lowest level taken is found by bisection; among
    equal levels the split with fewer assigned images goes first, which for equal deficits
    means the smaller target, then the split order.
    """
    order = sorted(range(len(SPLITS)), key=lambda k: (PERCENT[k], k))
    zero = F.lit(0).cast("bigint")

    def taken(d: Column, level: Column) -> Column:
        return F.when(d >= level, ((d - level - (d - level) % step) / step).cast("bigint") + 1).otherwise(zero)

    def search(ds: Column) -> Column:
        def halve(state: Column, _: Column) -> Column:
            middle = F.floor((state["lo"] + state["hi"]) / 2).cast("bigint")
            enough = F.aggregate(ds, zero, lambda acc, d: acc + taken(d, middle)) >= n
            open_ = state["hi"] - state["lo"] > 1
            return F.struct(
                F.when(open_ & enough, middle).otherwise(state["lo"]).alias("lo"),
                F.when(open_ & ~enough, middle).otherwise(state["hi"]).alias("hi"),
            )

        top = F.array_max(ds)
        start = F.struct((top - n * step).cast("bigint").alias("lo"), (top + 1).cast("bigint").alias("hi"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(BISECTION_STEPS)), start, halve, lambda s: s["lo"])

    def settle(ds: Column, level: Column, counts: Column) -> Column:
        excess = F.aggregate(counts, zero, lambda acc, c: acc + c) - n
        out: dict[int, Column] = {}
        for k in reversed(order):
            d = F.get(ds, F.lit(k))
            at_level = (d >= level) & ((d - level) % step == 0)
            drop = F.when(at_level & (excess > 0), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
            out[k] = F.get(counts, F.lit(k)) - drop
            excess = excess - drop
        return F.array(*[out[k] for k in range(len(SPLITS))])

    def with_level(ds: Column, level: Column) -> Column:
        return let(F.transform(ds, lambda d: taken(d, level)), lambda counts: settle(ds, level, counts))

    return let(deficits, lambda ds: let(search(ds), lambda level: with_level(ds, level)))


def grouped_split(groups: DataFrame, seed: int = 42) -> DataFrame:
    """Leak-free 70/15/15 split of ``class_index, group_id, group_size`` rows.

    Per class, groups go from large to small (seeded order among equals). The first three
    seed the splits, each later one goes to the split with the largest deficit. Only the
    distinct sizes of a class are folded in order; the groups of one size are placed by
    their rank, in parallel, however many a class has.
    """
    keyed = groups.withColumns({"_neg": -F.col("group_size"), "_tie": seeded_key(seed, "class_index", "group_id")})
    ranked = row_numbers(keyed, ["_neg", "_tie", "group_id"], "_r", ["class_index"])
    size = F.col("group_size").cast("bigint")
    seeds = [F.coalesce(F.sum(F.when(F.col("_r") == k + 1, size)), F.lit(0)).cast("bigint").alias(f"_s{k}") for k in range(3)]
    totals = ranked.groupBy("class_index").agg(F.sum(size).alias("_total"), *seeds)
    later = F.when(F.col("_r") > 3, 1)
    runs = ranked.groupBy("class_index", "group_size").agg(F.count(later).alias("n"), F.min(F.when(F.col("_r") > 3, F.col("_r"))).alias("first_rank")).filter("n > 0")
    lists = runs.groupBy("class_index").agg(F.sort_array(F.collect_list(F.struct((-F.col("group_size")).alias("neg"), "n", "first_rank"))).alias("runs"))
    plan = lists.join(totals, "class_index")

    def deficits(assigned: Column) -> Column:
        return F.array(*[F.col("_total") * PERCENT[k] - F.get(assigned, F.lit(k)) * 100 for k in range(3)])

    def walk(state: Column, run: Column) -> Column:
        width = -run["neg"].cast("bigint")
        counts = _fill(deficits(state["assigned"]), width * 100, run["n"])
        return let(
            counts,
            lambda c: F.struct(
                F.zip_with(state["assigned"], c, lambda a, x: a + x * width).alias("assigned"),
                F.concat(state["out"], F.array(F.struct(run["neg"].alias("neg"), run["first_rank"].alias("first_rank"), state["assigned"].alias("assigned")))).alias("out"),
            ),
        )

    empty = F.filter(F.transform("runs", lambda r: F.struct(r["neg"].alias("neg"), r["first_rank"].alias("first_rank"), F.array("_s0", "_s1", "_s2").alias("assigned"))), lambda _: F.lit(False))
    start = F.struct(F.array("_s0", "_s1", "_s2").alias("assigned"), empty.alias("out"))
    states = plan.select("class_index", "_total", F.explode(F.aggregate("runs", start, walk, lambda s: s["out"])).alias("o")).select(
        "class_index", "_total", (-F.col("o.neg")).alias("group_size"), F.col("o.first_rank").alias("first_rank"), F.col("o.assigned").alias("assigned")
    )
    # states has one row per class and distinct size
    placed = ranked.join(states, ["class_index", "group_size"], "left")
    position = F.col("_r") - F.col("first_rank")
    upto = lambda n: _fill(deficits(F.col("assigned")), size * 100, n)
    grown = F.zip_with(upto(position + 1), upto(position), lambda a, b: a - b)
    index = F.when(F.col("_r") <= 3, F.col("_r").cast("int") - 1).otherwise((F.array_position(grown, 1) - 1).cast("int"))
    names = F.array(*[F.lit(s) for s in SPLITS])
    return placed.select("class_index", "group_id", "group_size", F.get(names, index).alias("split"))


def group_owners(members: DataFrame) -> DataFrame:
    """One row per group: class of its first image, and the size."""
    return members.groupBy("group_id").agg(
        F.min(F.struct("image_id", "class_index"))["class_index"].alias("class_index"), F.count("*").alias("group_size")
    )


def split_violations(members: DataFrame) -> DataFrame:
    """Classes with fewer than three groups, and groups that lie in two classes."""
    few = members.groupBy("class_index").agg(F.count_distinct("group_id").alias("n")).filter("n < 3")
    two = members.groupBy("group_id").agg(F.count_distinct("class_index").alias("n")).filter("n > 1")
    return few.select(F.lit("class_with_few_groups").alias("violation"), F.col("class_index").cast("string").alias("key"), "n").unionByName(
        two.select(F.lit("group_in_two_classes").alias("violation"), F.col("group_id").alias("key"), "n")
    )


def split_summary(manifest: DataFrame) -> DataFrame:
    """Per class and split counts pivoted, with the overall line (class null)."""
    count = lambda s: F.count(F.when(F.col("split") == s, 1))
    sets = manifest.groupingSets([["class_index"], []], "class_index")
    return sets.agg(
        *[count(s).alias(s) for s in SPLITS], F.count("*").alias("total"),
        *[(count(s) / F.count("*")).alias(f"{s}_ratio") for s in SPLITS],
    )


def groups_per_split(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("split").agg(F.count("*").alias("images"), F.count_distinct("group_id").alias("groups"))


def leakage_audit(manifest: DataFrame, key: str) -> DataFrame:
    """Groups in several splits, classes that miss a split, repeated keys."""
    leak = manifest.groupBy("group_id").agg(F.count_distinct("split").alias("n")).filter("n > 1")
    miss = manifest.groupBy("class_index").agg(F.count_distinct("split").alias("n")).filter(F.col("n") < len(SPLITS))
    twice = manifest.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
    part = lambda df, name, col: df.select(F.lit(name).alias("finding"), F.col(col).cast("string").alias("key"), "n")
    return part(leak, "group_in_several_splits", "group_id").unionByName(part(miss, "class_misses_split", "class_index")).unionByName(part(twice, "repeated_key", key))


def stratified_validation(items: DataFrame, key: str, label: str, share: float) -> DataFrame:
    """The first max(1, floor(smallest class * share)) items of every class validate.

    Every item is also part of ``train_valid``. Rows are ranked in slices, so a class
    that holds a third of all rows is not sorted in one task.
    """
    smallest = items.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n"))
    ranked = row_numbers(items, [key], "_r", [label])
    per_class = F.greatest(F.lit(1), F.floor(smallest.scalar() * share))
    return ranked.select(key, label, F.when(F.col("_r") <= per_class, "valid").otherwise("train").alias("part"))


def fold_blocks(items: DataFrame, key: str, k: int) -> DataFrame:
    """Every row once, with the ``block`` of n // k consecutive rows that it validates; the remainder is left out."""
    if k < 2:
        raise ValueError("k must be at least 2")
    n = items.agg(F.count("*"))
    block = F.floor(n.scalar() / k)
    numbered = row_numbers(items, [key], "_r").withColumn("block", F.floor((F.col("_r") - 1) / block).cast("int")).filter(F.col("block") < k)
    return numbered.drop("_r")


def contiguous_folds(items: DataFrame, key: str, k: int) -> DataFrame:
    """k folds of n // k consecutive rows; the remainder is left out, as in plain slicing."""
    return fold_blocks(items, key, k).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn(
        "part", F.when(F.col("block") == F.col("fold"), "valid").otherwise("train")
    )


def permutation_split(items: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """Seeded shuffle; the first floor(n * share) items validate."""
    n = items.agg(F.count("*"))
    ranked = row_numbers(items.withColumn("_k", seeded_key(seed, key)), ["_k", key], "_r")
    return ranked.withColumn("part", F.when(F.col("_r") <= F.floor(n.scalar() * share), "valid").otherwise("train")).drop("_k", "_r")


def mini_batches(items: DataFrame, key: str, size: int, seed: int, drop_last: bool = False) -> DataFrame:
    """Shuffled batches; the short last one is kept unless ``drop_last``."""
    ranked = row_numbers(items.withColumn("_k", seeded_key(seed, key)), ["_k", key], "_r")
    out = ranked.withColumn("batch", F.floor((F.col("_r") - 1) / size)).drop("_k", "_r")
    if drop_last:
        n = items.agg(F.count("*"))
        out = out.filter(F.col("batch") < F.floor(n.scalar() / size))
    return out


def contract_checks(df: DataFrame, required: list[str], expected: int | None, unique: list[str], allowed: dict[str, list[str]]) -> DataFrame:
    """``check, violations`` rows; every check of the table runs in few aggregates."""
    spark = df.sparkSession
    missing = len([c for c in required if c not in df.columns])
    aggs = [F.count("*").alias("_n")]
    aggs += [F.sum((~F.col(c).isin(v) | F.col(c).isNull()).cast("bigint")).alias(f"allowed_{c}") for c, v in allowed.items()]
    line = df.agg(*aggs)
    rows = [("required_columns", F.lit(missing).cast("bigint"))]
    if expected is not None:
        rows.append(("expected_count", F.abs(F.col("_n") - expected)))
    rows += [(f"allowed_{c}", F.col(f"allowed_{c}")) for c in allowed]
    out = line.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), v.alias("violations")) for n, v in rows])).alias("r")).select("r.*")
    for c in unique:
        repeats = df.groupBy(c).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))
        out = out.unionByName(repeats.select(F.lit(f"unique_{c}").alias("check"), "violations"))
    return out


def adjacent_across_splits(manifest: DataFrame, max_gap: int, order: list[str]) -> DataFrame:
    """Consecutive images of a class whose numbers lie within ``max_gap`` but whose splits differ.

    The successor is found by rank, so a hot class is not walked in one task.
    """
    if max_gap < 0:
        raise ValueError("max_gap must not be negative")
    numbered = cut_lineage(row_numbers(manifest.filter(F.col(order[0]).isNotNull()), order, "_r", ["class_index"]))  # read twice
    left = numbered.select("class_index", (F.col("_r") + 1).alias("_r"), F.col("number").alias("n1"), F.col("stem").alias("first_path"), F.col("split").alias("first_split"))
    right = numbered.select("class_index", "_r", F.col("number").alias("n2"), F.col("stem").alias("second_path"), F.col("split").alias("second_split"))
    gap = F.col("n2") - F.col("n1")
    return left.join(right, ["class_index", "_r"]).filter((gap <= max_gap) & (F.col("first_split") != F.col("second_split"))).select(
        "class_index", "first_path", "first_split", "second_path", "second_split", gap.alias("number_gap")
    )


def balanced_sample(items: DataFrame, key: str, label: str, classes: int, per_class: int) -> DataFrame:
    """The first ``per_class`` items of the first ``classes`` classes met in key order."""
    met = items.groupBy(label).agg(F.min(key).alias("_first")).orderBy("_first", label).limit(classes)
    w = Window.partitionBy(label).orderBy(key)
    few = items.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_class).drop("_r")
    return few.join(F.broadcast(met.select(label)), label)


def seeded_sample(items: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    return items.orderBy(seeded_key(seed, key), key).limit(k)
