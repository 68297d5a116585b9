"""Aggregates of file metrics over a corpus, and what is done with them.

Long form everywhere: (metric, key, value).  Statistics are population statistics
over the files that have a key; nothing is filled in for the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import pearson_of, r4

#: Decimal places of the exact sums: figures have at most six.
_EXACT = "decimal(38, 6)"


def codebase(figures: DataFrame, by: list[str] = ()) -> DataFrame:
    """mean, std, min, max of each (metric, key), rounded to four places.  Sums are
    decimal, so that they don't depend on the order of the rows; a partial
    aggregate of four numbers for each key is all that is shuffled."""
    return finalize(state(figures, by), by)


def state(figures: DataFrame, by: list[str] = ()) -> DataFrame:
    """The partial aggregate: n, s (sum), q (sum of squares), lo, hi of each key."""
    v = F.col("value")
    return figures.groupBy(*by, "metric", "key").agg(
        F.count("*").alias("n"), F.sum(v.cast(_EXACT)).alias("s"), F.sum(v * v).alias("q"), F.min(v).alias("lo"), F.max(v).alias("hi")
    )


def merged(states: DataFrame, by: list[str] = ()) -> DataFrame:
    """Partial aggregates of parts of the files as one."""
    return states.groupBy(*by, "metric", "key").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def finalize(states: DataFrame, by: list[str] = ()) -> DataFrame:
    mean = F.col("s").cast("double") / F.col("n")
    std = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    return states.select(*by, "metric", "key", r4(mean).alias("mean"), r4(std).alias("std"), r4(F.col("lo")).alias("min"), r4(F.col("hi")).alias("max"))


def swapped(states: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """States with one file's figures `old` replaced by `new` (metric, key, value):
    the number of files stays, a missing side counts as 0, bounds only widen."""
    o = old.select("metric", "key", F.col("value").alias("_o"))
    w = new.select("metric", "key", F.col("value").alias("_w"))
    d = states.join(o, ["metric", "key"], "left").join(w, ["metric", "key"], "left")
    a, b = (F.coalesce(c, F.lit(0.0)) for c in ("_o", "_w"))
    return d.select(
        "metric", "key", "n", (F.col("s") - a.cast(_EXACT) + b.cast(_EXACT)).cast(_EXACT).alias("s"), (F.col("q") - a * a + b * b).alias("q"),
        F.least("lo", b).alias("lo"), F.greatest("hi", b).alias("hi"),
    )


def flat(aggregate: DataFrame, by: list[str] = ()) -> DataFrame:
    """(grp, key, value) with the keys mean_x, std_x, min_x, max_x."""
    parts = [F.struct(F.concat(F.lit(f"{k}_"), F.col("key")).alias("key"), F.col(k).alias("value")) for k in ("mean", "std", "min", "max")]
    return aggregate.select(*by, F.col("metric").alias("grp"), F.inline(F.array(*parts)))


def delta(base: DataFrame, head: DataFrame) -> DataFrame:
    """head less base for the (grp, key) that both have."""
    b = base.select("grp", "key", F.col("value").alias("base"))
    h = head.select("grp", "key", F.col("value").alias("head"))
    return b.join(h, ["grp", "key"]).select("grp", "key", "base", "head", r4(F.col("head") - F.col("base")).alias("delta"))


def combinations(figures: DataFrame) -> DataFrame:
    """All unordered pairs of a file's figures: sum, both differences, product, both
    quotients (0 for a zero divisor).  The pairs are made inside the file's row."""
    rows = figures.groupBy("path").agg(F.sort_array(F.collect_list(F.struct(F.concat_ws(".", "metric", "key").alias("k"), F.col("value").alias("v")))).alias("p"))
    rest = F.transform("p", lambda x, i: F.transform(F.slice("p", i + 2, F.size("p")), lambda y: F.struct(x["k"].alias("a"), y["k"].alias("b"), x["v"].alias("x"), y["v"].alias("y"))))
    d = rows.select("path", F.inline(F.flatten(rest)))
    x, y = F.col("x"), F.col("y")
    div = lambda a, b: r4(F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0)))
    return d.select("path", "a", "b", r4(x + y).alias("add"), r4(x - y).alias("sub_a_b"), r4(y - x).alias("sub_b_a"), r4(x * y).alias("mul"), div(x, y).alias("div_a_b"), div(y, x).alias("div_b_a"))


def correlations(series: DataFrame, all_groups: bool = False, least: float = 0.0, most: float = 1.0, hide_exact: bool = False) -> DataFrame:
    """Pearson correlation over the snapshots of every two series (snapshot, name,
    value) that vary; absent values are 0, a correlation of 0 is left out.  Names of
    groups that share a word (before the first dot) are not compared, unless
    `all_groups`.  The pairs are of names, never of rows: each snapshot holds its
    values as one array."""
    names = series.groupBy("name").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"))
    snapshots = series.select("snapshot").distinct()
    n = snapshots.count()
    names = names.where((F.col("lo") != F.col("hi")) | ((F.col("n") < n) & (F.col("lo") != 0))).select("name")
    grid = series.join(names, "name").groupBy("name").agg(
        F.map_from_entries(F.collect_list(F.struct("snapshot", "value"))).alias("at"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")
    )
    words = F.split(F.regexp_extract("name", r"^([^.]*)", 1), "[_,]")
    side = lambda k: grid.select(F.col("name").alias(f"{k}_name"), F.col("at").alias(f"{k}_at"), F.col("s").alias(f"{k}_s"), F.col("q").alias(f"{k}_q"), words.alias(f"{k}_w"))
    on = F.col("a_name") < F.col("b_name")
    pairs = side("a").join(side("b"), on if all_groups else on & ~F.arrays_overlap("a_w", "b_w"))
    both = F.aggregate(F.map_entries("a_at"), F.lit(0.0), lambda t, e: t + e["value"] * F.coalesce(F.element_at("b_at", e["key"]), F.lit(0.0)))
    c = r4(pearson_of(F.lit(float(n)), F.col("a_s"), F.col("b_s"), both, F.col("a_q"), F.col("b_q")))
    out = pairs.select(F.col("a_name").alias("a"), F.col("b_name").alias("b"), c.alias("correlation")).where("correlation <> 0")
    out = out.where(F.abs("correlation").between(least, most))
    return out.where(F.abs("correlation") < 1) if hide_exact else out


def strongest(correlations_: DataFrame, n: int = 20) -> DataFrame:
    """The n pairs with the largest absolute correlation; ties by name."""
    return correlations_.orderBy(F.desc(F.abs("correlation")), "a", "b").limit(n)


def power_law(points: DataFrame) -> DataFrame:
    """n, Pearson correlation, exponent and fit of y on x over rows (x, y) with both
    above 0; null under three rows."""
    d = points.where("x > 0 AND y > 0").select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.ln("x").alias("lx"), F.ln("y").alias("ly"))
    mul = lambda a, b: F.sum(F.col(a) * F.col(b))
    s = d.agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), mul("x", "y").alias("sxy"), mul("x", "x").alias("sxx"), mul("y", "y").alias("syy"),
              F.regr_slope("ly", "lx").alias("slope"), F.regr_r2("ly", "lx").alias("r2"))
    n: Column = F.col("n").cast("double")
    c = pearson_of(n, F.col("sx"), F.col("sy"), F.col("sxy"), F.col("sxx"), F.col("syy"))
    few = F.col("n") < 3
    return s.select("n", *(F.when(~few, r4(x)).alias(k) for k, x in (("correlation", c), ("exponent", F.col("slope")), ("r_squared", F.col("r2")))))
