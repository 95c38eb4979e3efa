"""References to records that do not exist."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\r\u00a0"


def levelled_reference(c: Column) -> Column:
    """A reference without outer blanks and case; a text without any digit refers to nothing and is null."""
    text = F.upper(F.btrim(c.cast("string"), F.lit(BLANKS)))
    return F.when(text.rlike("[0-9]"), text)


def first_delivery(df: DataFrame, key: str, delivered: str, columns: list[str]) -> DataFrame:
    """``columns`` of the first delivery of each key; null times come last, ties fall to the smallest row."""
    order = F.struct(F.col(delivered).isNull().alias("__n"), F.col(delivered).alias("__t"), *columns)
    one = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("__one"))
    return one.select(key, F.col("__one.__t").alias(delivered), *[F.col(f"__one.{c}").alias(c) for c in columns])


def target_state(df: DataFrame, keys: list[Column], delivered: str, deleted: str | None, names: list[str]) -> DataFrame:
    """For each target key: its first delivery, and whether all of its rows are deleted."""
    gone = F.col(deleted).isNotNull() if deleted else F.lit(False)
    rows = df.select(*[k.alias(n) for k, n in zip(keys, names)], F.col(delivered).alias("__t"), gone.alias("__gone"))
    return rows.groupBy(*names).agg(F.min("__t").alias("desde"), F.bool_and("__gone").alias("borrada"))


def dangling(
    refs: DataFrame,
    ref_keys: list[str],
    targets: DataFrame,
    target_keys: list[str],
    match: str = "simple",
    constant: list[str] = (),
    when: str | None = None,
) -> DataFrame:
    """The rows of ``refs`` whose key leads to no live target in time, with the reason in ``motivo``.

    Rows are grouped by their null mask over ``ref_keys``; each mask is joined on its non-null columns only:

    * ``simple``: a key with any null refers to nothing and is never reported; only the full mask is joined.
    * ``partial``: the non-null columns must agree with some target; a key of nulls only is never reported.
    * ``full``: like simple, but a key that is null in part is reported as ``ausente`` (SQL's MATCH FULL).

    ``targets`` has ``target_keys``, ``desde`` (first delivery) and ``borrada`` (all rows deleted), as
    ``target_state`` gives them. ``motivo``, the first that holds: ``ausente`` no such target; ``borrada`` every
    matching target deleted; ``tardia`` the first matching target was delivered after the column ``when`` of the
    reference. ``constant`` columns are part of every key but never null (such as the target table's name).
    Duplicated references all come out. A heavy key is split by the adaptive planner: the target side has one row
    for each key, so rows never multiply. Empty references give no row; empty targets make all references absent.
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"unknown match semantics {match!r}")
    n = len(ref_keys)
    mask = reduce(lambda a, b: a + b, [F.when(F.col(k).isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, k in enumerate(ref_keys)])
    marked = refs.withColumn("__mask", mask) if n > 1 else refs
    out = []
    for m in range((1 << n) - 1 if match == "partial" else 1):
        there = [i for i in range(n) if not m >> i & 1]
        rows = marked.where(F.col("__mask") == m).drop("__mask") if n > 1 else marked.where(F.col(ref_keys[0]).isNotNull())
        pairs = [(c, c) for c in constant] + [(ref_keys[i], target_keys[i]) for i in there]
        side = targets.select(*[F.col(t).alias(f"__k{j}") for j, (_, t) in enumerate(pairs)], "desde", "borrada")
        if m:
            side = side.groupBy(*[f"__k{j}" for j in range(len(pairs))]).agg(
                F.min("desde").alias("desde"), F.bool_and("borrada").alias("borrada")
            )
        side = side.select(*[f"__k{j}" for j in range(len(pairs))], F.col("desde").alias("__desde"), F.col("borrada").alias("__borrada"))
        on = reduce(lambda a, b: a & b, [rows[r] == side[f"__k{j}"] for j, (r, _) in enumerate(pairs)])
        late = F.col("__desde") > F.col(when) if when else F.lit(False)
        why = (
            F.when(F.col("__borrada").isNull(), F.lit("ausente"))
            .when(F.col("__borrada"), F.lit("borrada"))
            .when(late, F.lit("tardia"))
        )
        joined = rows.join(side, on, "left").withColumn("motivo", why).where("motivo is not null")
        out.append(joined.select(*refs.columns, "motivo"))
    if match == "full" and n > 1:
        part = marked.where((F.col("__mask") > 0) & (F.col("__mask") < (1 << n) - 1)).drop("__mask")
        out.append(part.withColumn("motivo", F.lit("ausente")).select(*refs.columns, "motivo"))
    return reduce(DataFrame.unionByName, out)
