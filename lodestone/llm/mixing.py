"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.session import stage

WORD = r"[^\x20\x09-\x0D]+"
#: Units that one step of the tree reduces to one, on average.
FAN_IN = 32
DECIDED = "array<struct<doc_id: bigint, ordinal: int, size: bigint, extra: int>>"
UNIT = "struct<doc_id: bigint, ordinal: int, size: bigint, p: double>"


def uniform(*parts: Column | str | int) -> Column:
    """A draw in (0, 1) that only its parts decide, so that reruns and retries agree."""
    cols = [F.lit(p) if isinstance(p, int) else p for p in parts]
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def targets(sizes: DataFrame, weights: Sequence[float], total_share: float, most: float) -> DataFrame:
    """Target per source from ``(source, source_size)``: weights repeat in code-point order of source.

    The sources share ``total_share`` of all sizes by weight; none gets more than
    ``most`` times its size, and what is above goes to the others by weight again.
    That is water-filling: sources fill up in the order of limit over weight, and the
    level of the rest follows from the sums before them. The windows hold one row per
    source, never one per document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    listed = F.array(*[F.lit(float(w)) for w in weights])
    rows = (
        sizes.withColumn("_weight", F.get(listed, ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")))
        .withColumn("_limit", F.lit(float(most)) * F.col("source_size"))
        .withColumn("_ratio", F.col("_limit") / F.col("_weight"))
        .withColumn("_total", F.lit(float(total_share)) * F.sum("source_size").over(every))
        .withColumn("_rest", F.col("_total") - F.coalesce(F.sum("_limit").over(before), F.lit(0.0)))
        .withColumn("_open", F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
        .withColumn("_level", F.when(F.col("_rest") <= F.col("_ratio") * F.col("_open"), F.col("_rest") / F.col("_open")))
        # The first source that its share does not fill sets the level; later ones give less.
        .withColumn("_level", F.max("_level").over(every))
    )
    share = F.coalesce(F.least(F.col("_limit"), F.col("_level") * F.col("_weight")), F.col("_limit"))
    return rows.select("source", "source_size", share.alias("target"))


def _duel(acc: Column, unit: Column, seed: int, level: int) -> Column:
    """Two units exchange mass in words until one is whole or empty; the other stays.

    Mass goes to one side or the other with odds that leave both expectations as they
    were, and the sum of the masses never changes.
    """
    held = acc["held"]
    up = F.least(held["size"] * (1 - held["p"]), unit["size"] * unit["p"])  # from the new unit to the held one
    down = F.least(held["size"] * held["p"], unit["size"] * (1 - unit["p"]))
    rise = uniform(held["doc_id"], held["ordinal"], unit["doc_id"], unit["ordinal"], level, seed) * (up + down) < down
    moved = F.when(rise, up).otherwise(-down)
    held_p, unit_p = held["p"] + moved / held["size"], unit["p"] - moved / unit["size"]
    # Which of the two became integral is told by sizes, not by comparing rounded fractions.
    held_done = F.when(rise, held["size"] * (1 - held["p"]) <= unit["size"] * unit["p"]).otherwise(
        held["size"] * held["p"] <= unit["size"] * (1 - unit["p"])
    )

    def done(u: Column, whole: Column) -> Column:
        return F.array(F.struct(u["doc_id"].alias("doc_id"), u["ordinal"].alias("ordinal"), u["size"].alias("size"),
                                whole.cast("int").alias("extra")))

    def keep(u: Column, p: Column) -> Column:
        return F.struct(u["doc_id"].alias("doc_id"), u["ordinal"].alias("ordinal"), u["size"].alias("size"),
                        F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"))

    first = F.struct(acc["done"].alias("done"), keep(unit, unit["p"]).alias("held"))
    after = F.struct(
        F.concat(acc["done"], F.when(held_done, done(held, rise)).otherwise(done(unit, ~rise))).alias("done"),
        F.when(held_done, keep(unit, unit_p)).otherwise(keep(held, held_p)).alias("held"),
    )
    return F.when(held.isNull(), first).otherwise(after)


def _reduce(units: DataFrame, seed: int, level: int) -> DataFrame:
    """One step of the tree: blocks of about FAN_IN units of a source duel until one unit is left of each."""
    counts = units.groupBy(F.col("source").alias("_source")).agg(F.count("*").alias("_n"))
    blocks = F.ceil(F.col("_n") / FAN_IN)
    units = units.join(counts, units["source"].eqNullSafe(counts["_source"])).withColumn(
        "_block", F.pmod(F.xxhash64("doc_id", "ordinal", F.lit(seed), F.lit(level)), blocks)
    )
    # The largest first. Of two units the larger mostly stays open, so what a block leaves is one of its large ones.
    turn = F.xxhash64("doc_id", "ordinal", F.lit(seed + 1))
    unit = F.struct((-F.col("size")).alias("rank"), turn.alias("turn"), "doc_id", "ordinal", "size", "p")
    start = F.struct(F.array().cast(DECIDED).alias("done"), F.lit(None).cast(UNIT).alias("held"))
    return (
        units.groupBy("source", "_block")
        .agg(F.sort_array(F.collect_list(unit)).alias("units"))
        .select(
            "source",
            F.aggregate(
                "units",
                start,
                lambda acc, u: _duel(acc, u, seed, level),
            ).alias("r"),
        )
        .select("source", "r.done", "r.held")
    )


def mix(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), total_share: float = 1.5, most: int = 2,
    seed: int = 42, key: str = "doc_id", text: str = "text", source: str = "source", name: str | None = None,
) -> DataFrame:
    """How often each document enters the mix: ``doc_id, ordinal, source, size, source_size, target, copies, taken``.

    Every document of a source has the same fractional number of copies, target over
    source size. Its whole part is given; the fraction is rounded by pivotal duels in a
    tree: blocks of units reduce to one unit each, and those meet in the next step, so
    a source of any size, or one source holding a third of all rows, is spread over its
    blocks. The words taken from a source differ from its target by less than its
    largest document: only the last unit of a source is rounded alone, to the nearer side.

    Sizes count words ``[^\\x20\\x09-\\x0D]+`` of the whole text; null or empty text has
    size 0 and is taken 0 times over. Null is a source of its own, the last. Rows that
    repeat a key are told apart by ``ordinal``. Other columns are ignored; an empty
    table gives no rows. Draws come from hashes of the keys, so reruns agree. ``name``, a
    column that tells the rows of a key apart, goes along if given.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    names = ["name"] if name else []
    rows = docs.select(
        F.col(key).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), *(F.col(name).alias(n) for n in names)
    )
    # Counting words is the costly part; from here on only keys and numbers move.
    rows = stage(rows, "sizes")
    same = Window.partitionBy("doc_id").orderBy(F.col("source").asc_nulls_last(), "size", *names)
    rows = rows.withColumn("ordinal", F.row_number().over(same))
    totals = stage(
        targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows")).drop("_rows"),
                weights, total_share, most),
        "targets",
    )
    # One row per source: Spark broadcasts it while it is small and splits the join when it isn't.
    t = totals.select(F.col("source").alias("_source"), "source_size", "target")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = stage(
        rows.join(t, rows["source"].eqNullSafe(t["_source"]), "left").select(
            "doc_id", "ordinal", "source", "size", "source_size", "target",
            F.least(F.lit(most), F.floor(share)).cast("int").alias("base"), (share - F.floor(share)).alias("p"), *names,
        ),
        "units",
    )
    open_units = units.where("size > 0 and p > 0").select("source", "doc_id", "ordinal", "size", "p")
    decided: list[DataFrame] = []
    level = 0
    while (most_units := open_units.groupBy("source").count().agg(F.max("count")).first()[0] or 0) > 1:
        step = stage(_reduce(open_units, seed, level), "duels")
        decided.append(step.select("source", F.explode("done").alias("d")).select("source", "d.*"))
        open_units, level = step.select("source", "held.*"), level + 1
    if most_units:
        # The last unit of a source has nobody to exchange with.
        decided.append(
            open_units.select("source", "doc_id", "ordinal", "size", (F.col("p") >= 0.5).cast("int").alias("extra"))
        )
    whole = units.where("size = 0 or p = 0").select(
        "doc_id", "ordinal", "source", "size", F.lit(0).alias("extra")
    )
    for d in decided:
        whole = whole.unionByName(d.select("doc_id", "ordinal", "source", "size", "extra"))
    copies = (F.col("base") + F.col("extra")).cast("int")
    base = totals.select(
        F.col("source").alias("_source"), "source_size", "target",
        F.least(F.lit(most), F.floor(share)).cast("int").alias("base"),
    )
    mixed = whole.join(base, whole["source"].eqNullSafe(base["_source"]), "left").select(
        "doc_id", "ordinal", "source", "size", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"),
        F.coalesce("target", F.lit(0.0)).alias("target"), copies.alias("copies"), (F.col("size") * copies).alias("taken"),
    )
    if not name:
        return mixed
    named = units.select(F.col("doc_id").alias("_id"), F.col("ordinal").alias("_ordinal"), "name")
    at = mixed["doc_id"].eqNullSafe(named["_id"]) & (mixed["ordinal"] == named["_ordinal"])
    return mixed.join(named, at).drop("_id", "_ordinal")
