"""Top rows, custom orders, stacked summaries and repeatable samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from seqatlas.distribution import rank_rows
from seqatlas.session import cut_lineage


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], count: int, rank: str | None = None) -> DataFrame:
    """First ``count`` rows of each group; tasks pass on only their own best rows."""
    w = Window.partitionBy(*groups).orderBy(*order)
    name = rank or "_nth"
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= count)
    return out if rank else out.drop(name)


def top_component(summary: DataFrame, parts: Sequence[str], value: str = "percentage", count: int = 5) -> DataFrame:
    """Leading categories per corpus, their parts joined to one text; ties by that text."""
    named = summary.withColumn("component", F.concat_ws(" / ", *parts))
    best = top_per_group(named, ["dataset"], [F.col(value).desc(), F.col("component")], count)
    return best.select("dataset", "component", "count", "percentage")


def top_overall(df: DataFrame, order: Sequence[Column], count: int) -> DataFrame:
    return df.orderBy(*order).limit(count)


def corpus_order(dataset: str, order: Sequence[str]) -> Column:
    """Position of a corpus in a fixed order; others come last."""
    place = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        place = F.when(F.col(dataset) == name, F.lit(i)).otherwise(place)
    return place


def ranked(df: DataFrame, order: Sequence[str], metric: str, name: str, dataset: str = "dataset", descending: bool = True) -> DataFrame:
    """Rows by corpus order, then metric, then name: a distributed sort without ties."""
    by = F.col(metric).desc_nulls_last() if descending else F.col(metric).asc_nulls_last()
    return df.orderBy(corpus_order(dataset, order), by, F.col(name).asc())


def stack_summaries(tables: Mapping[str, DataFrame], tag: str = "analysis") -> DataFrame:
    """Summaries of several analyses under one another, each with its name."""
    out = None
    for name, df in tables.items():
        tagged = df.withColumn(tag, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def sample_per_group(df: DataFrame, groups: Sequence[str], identity: Sequence[str], count: int, seed: int = 42) -> DataFrame:
    """At most ``count`` rows of each group, the same ones in every run: order by a hash
    of the row identity and the seed."""
    order = [F.xxhash64(F.lit(seed), *identity), *[F.col(c) for c in identity]]
    return top_per_group(df, groups, order, count)


# --- pairs drawn without building all pairs ----------------------------------------


def pair_count(n: Column) -> Column:
    """Unordered pairs of n rows."""
    return F.when(n % 2 == 0, F.shiftright(n, 1) * (n - 1)).otherwise(F.shiftright(n - 1, 1) * n)


def pair_rows(number: Column) -> tuple[Column, Column]:
    """The rows (i, j) with i < j of pair ``number``, counted (0,1), (0,2), (1,2), (0,3), ..."""
    guess = F.floor((F.lit(1) + F.sqrt(F.lit(1.0) + F.lit(8.0) * number)) / 2).cast("long")
    # The square root of a large number may be off by one row.
    j = F.when(pair_count(guess) > number, guess - 1).when(pair_count(guess + 1) <= number, guess + 1).otherwise(guess)
    return (number - pair_count(j)).cast("long"), j.cast("long")


def _draw(seed: int, parts: Sequence[str], turn: Column) -> Column:
    """A number below 2**60 for each turn of a group, the same everywhere: the head of an MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts], turn.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def draw_pairs(df: DataFrame, ident: str, groups: Sequence[str], most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` unordered pairs of each group, the same ones in every run, with ``<ident>_a`` below
    ``<ident>_b`` and the pairs there are in ``num_pairs_all``.

    Pair numbers 0 .. n(n-1)/2 - 1 are cut into ``most`` runs of equal length (to within one), and a
    seeded hash draws one number from each: nothing repeats, every pair is as likely, and only
    drawn numbers are decoded to two rows and joined. A group with no more pairs keeps all.
    """
    if most < 1:
        raise ValueError("most must be at least 1")
    groups = list(groups)
    ranked = cut_lineage(rank_rows(df.select(*groups, ident), groups, [ident], into="_row"))
    sizes = ranked.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("num_pairs_all", pair_count(F.col("_n"))).filter(F.col("num_pairs_all") > 0)
    every = F.col("num_pairs_all")
    taken = F.least(every, F.lit(most).cast("long"))
    turns = sizes.select(*groups, "num_pairs_all", F.explode(F.sequence(F.lit(0).cast("long"), taken - 1)).alias("_k"))
    rest = every % most
    run = F.expr(f"num_pairs_all div {int(most)}")
    width = run + F.when(F.col("_k") < rest, 1).otherwise(0)
    first = F.col("_k") * run + F.least(F.col("_k"), rest)
    number = F.when(every <= most, F.col("_k")).otherwise(first + F.pmod(_draw(seed, groups, F.col("_k")), width))
    i, j = pair_rows(F.col("_number"))
    drawn = turns.withColumn("_number", number).withColumns({"_i": i, "_j": j})
    out = drawn
    for row, name in (("_i", "a"), ("_j", "b")):
        other = ranked.select(*[F.col(g).alias(f"{row}{g}") for g in groups], F.col("_row").alias(f"{row}_row"), F.col(ident).alias(f"{ident}_{name}"))
        on = F.col(row) == F.col(f"{row}_row")
        for g in groups:
            on = on & F.col(g).eqNullSafe(F.col(f"{row}{g}"))
        out = out.join(other, on)
    return out.select(*groups, f"{ident}_a", f"{ident}_b", "num_pairs_all")
