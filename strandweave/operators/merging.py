"""N-way merge of keyed tables with a presence rule for each input.

Rules: A must hold the key, N must not, E may, O at least one of the O inputs must, T at least two of the T inputs must. Inputs are united and grouped by
key once, whatever their number; the rules are conditions on which inputs a group has seen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RULES = "ANEOT"


def normal_key(column: Column | str, kind: str, order: tuple[str, ...] = ()) -> Column:
    """A key column in the form that its kind compares: s string, c string without letter case, n number, e place in `order` (null, and last, if not in it). Capitals sort descending."""
    c = F.col(column) if isinstance(column, str) else column
    match kind.lower():
        case "s":
            return c.cast("string")
        case "c":
            return F.lower(c.cast("string"))
        case "n":
            return c.try_cast("double")
        case "e":
            return F.nullif(F.array_position(F.array(*map(F.lit, order)), c.cast("string")), F.lit(0)).cast("int")
    raise ValueError(f"unknown kind of key: {kind}")


def chromosomes(most: int = 80) -> tuple[str, ...]:
    """The built-in order chr1 … chr80, chrX, chrY, chrM."""
    return (*(f"chr{i}" for i in range(1, most + 1)), "chrX", "chrY", "chrM")


def presence(seen: list[Column], rules: str) -> Column:
    """The condition that the rules set on whether each input holds a key."""
    if len(seen) != len(rules) or set(rules) - set(RULES):
        raise ValueError("one rule of A, N, E, O, T for each input")
    of = lambda r: [s for s, x in zip(seen, rules, strict=True) if x == r]
    ok = [*of("A"), *[~s for s in of("N")]]
    for r, least in (("O", 1), ("T", 2)):
        if some := of(r):
            ok.append(reduce(lambda a, b: a + b, [s.cast("int") for s in some]) >= least)
    return reduce(lambda a, b: a & b, ok, F.lit(True))


def merge_long(rows: DataFrame, keys: list[str], value: str, number: str, rules: str, default: str | int | None = None, marks: bool = False, paired: bool = False) -> DataFrame:
    """(keys, v1, v2, …): merge of the inputs 1, 2, … of one long table, told apart by `number`: one row for each key that the rules admit, with each input's value, or `default` where it doesn't hold the key.

    The table is read and shuffled once, however many inputs there are; rows of a number beyond the rules or null are left out. An input's rows of one key are one (the largest value), or, if
    paired, the first meets the first of other inputs, the second the second and so on, from the largest value down, and the rules hold for each row of the result by itself.
    Null keys meet one another. marks adds b1, b2, … with whether each input holds the key. Inputs without rows hold no key.
    """
    n = range(1, len(rules) + 1)
    t = rows.select(*keys, F.col(value).alias("_v"), F.col(number).alias("_i")).where(F.col("_i").between(1, len(rules)))
    by = [*keys]
    if paired:
        t = t.withColumn("_r", F.row_number().over(W.partitionBy("_i", *keys).orderBy(F.desc_nulls_last("_v"))))
        by.append("_r")
    g = t.groupBy(*by).agg(*[F.max(F.when(F.col("_i") == i, F.col("_v"))).alias(f"v{i}") for i in n], *[F.max(F.col("_i") == i).alias(f"b{i}") for i in n])
    g = g.where(presence([F.col(f"b{i}") for i in n], rules))
    value_of = lambda i: F.col(f"v{i}") if default is None else F.when(F.col(f"b{i}"), F.col(f"v{i}")).otherwise(F.lit(default))
    return g.select(*keys, *[value_of(i).alias(f"v{i}") for i in n], *([f"b{i}" for i in n] if marks else []))


def merge_tables(inputs: list[DataFrame], keys: list[str], value: str, rules: str, kinds: str | None = None, default: str | int | None = None, order: tuple[str, ...] = (), marks: bool = False, paired: bool = False) -> DataFrame:
    """merge_long() of separate inputs. kinds: a letter for each key, see normal_key. Inputs may have further columns, which are left out."""
    if len(inputs) != len(rules):
        raise ValueError("one rule of A, N, E, O, T for each input")
    kinds = kinds or "s" * len(keys)
    tagged = [t.select(*[normal_key(k, x, order).alias(k) for k, x in zip(keys, kinds, strict=True)], F.col(value).alias("_value"), F.lit(i + 1).alias("_number")) for i, t in enumerate(inputs)]
    return merge_long(reduce(DataFrame.unionByName, tagged), keys, "_value", "_number", rules, default, marks, paired)


def present(counts: DataFrame, least: int, count: str = "cnt") -> DataFrame:
    """Adds present INT: whether a table's count is at least `least`; a null count isn't."""
    return counts.withColumn("present", F.coalesce(F.col(count) >= least, F.lit(False)).cast("int"))


def sort_order(keys: list[str], kinds: str) -> list[Column]:
    """Sort expressions of merged keys: capitals descend, keys that are null come last."""
    return [F.desc_nulls_last(k) if x.isupper() else F.asc_nulls_last(k) for k, x in zip(keys, kinds, strict=True)]


def merge_rows(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """1:N merge: every row of the left for every row of the right with its key; `how` as in a join."""
    return left.join(right, keys, how)
