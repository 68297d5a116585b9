"""Statistics of arrays inside a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def r4(x: Column) -> Column:
    """Four decimal places, halves of the scaled number away from zero; numbers that
    are too large to have such places stay as they are."""
    x = x.cast("double")
    size = F.when(F.abs(x) < 1e11, F.floor(F.abs(x) * 10000.0 + 0.5).cast("double") / 10000.0).otherwise(F.abs(x))
    return F.when(x < 0, -size).otherwise(size) + 0.0


def total(array: Column) -> Column:
    """Sum of an array of numbers, as a double."""
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x.cast("double"))


def counted(df: DataFrame, array: str, name: str) -> DataFrame:
    """Adds {name}_values, the distinct elements, and {name}, how often each occurs:
    run lengths of the sorted array, so nothing leaves the row."""
    s, e = f"_{name}_s", f"_{name}_e"
    df = df.withColumn(s, F.sort_array(array))
    n = F.size(s)
    ends = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & ((i == n) | (F.get(s, i - 1) != F.get(s, i))))
    df = df.withColumn(e, ends)
    counts = F.transform(e, lambda at, i: (at - F.when(i == 0, 0).otherwise(F.get(e, i - 1))).cast("long"))
    return df.withColumns({name: counts, f"{name}_values": F.transform(e, lambda at: F.get(s, at - 1))}).drop(s, e)


def shannon(counts: Column, n: Column) -> Column:
    """Shannon entropy in bits of the distribution counts / n; 0 for none."""
    return F.aggregate(counts, F.lit(0.0), lambda a, c: a - c / n.cast("double") * F.log2(c / n.cast("double"))) + 0.0


def pearson_of(n: Column, sx: Column, sy: Column, sxy: Column, sxx: Column, syy: Column) -> Column:
    """Correlation from sums; 0 where a side is constant."""
    den = F.sqrt(F.greatest((n * sxx - sx * sx) * (n * syy - sy * sy), F.lit(0.0)))
    return F.coalesce((n * sxy - sx * sy) / F.nullif(den, F.lit(0.0)), F.lit(0.0))


def deepest(signs: Column) -> Column:
    """Greatest depth of a list of +1 and -1, where depth stays at 0 or above."""
    step = lambda a, s: F.struct(F.greatest(a["d"] + s, F.lit(0)).alias("d"), F.greatest(a["m"], a["d"] + s).alias("m"))
    return F.aggregate(signs, F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")), step)["m"].cast("long")
