"""Per-key results when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT = "__salt"


def heavy_candidates(df: DataFrame, side: str, key: str, share: float) -> DataFrame:
    """Every ``(side, key)`` that may hold ``share`` of the rows of its side, from one mergeable sketch a side.

    A frequent-items sketch of c counters errs by at most 3.5 n / c of the n rows it saw. With c at least 8 / share
    that is under 0.44 of the threshold: a heavy key's lower bound stays above the error, so none is missed, and
    whatever comes out beside them holds at least 0.56 of the threshold, so at most 2 / share keys a side do. That
    bounds the table whatever the size of the input. Null keys are left out.
    """
    counters = 1 << max(6, int(8 / share - 1).bit_length())
    top = min(counters, int(2 / share))
    sketch = F.expr(f"approx_top_k(`{key}`, {top}, {counters})")
    rows = df.where(F.col(key).isNotNull()).groupBy(side).agg(sketch.alias("top"))
    return rows.select(side, F.explode("top.item").alias(key)).distinct()


def salted_aggregate(
    df: DataFrame,
    keys: list[str],
    partial: dict[str, Column],
    merge: dict[str, Column],
    heavy: DataFrame,
    salts: int = 32,
    spread: Column | None = None,
) -> DataFrame:
    """``partial`` aggregates for each key and salt, then ``merge`` of those for each key.

    Keys in ``heavy`` (a table of proven bound, hence broadcast) are spread over ``salts`` sub-keys; all others
    keep salt 0 and so take part in the second stage with one row. ``merge`` names the columns of ``partial``.
    ``spread`` chooses the salt and defaults to a digest of the whole row: a lost task that is run again gives each row
    the salt it had, in whatever order rows arrive. Equal rows share a salt; the partial sums of each task have made one
    row of them before the shuffle. Null keys form a group of their own, as in GROUP BY.
    """
    marked = df.join(F.broadcast(heavy.select(*keys).withColumn(SALT, F.lit(True))), keys, "left")
    draw = F.pmod(spread if spread is not None else F.xxhash64(*df.columns), F.lit(salts)).cast("int")
    salted = marked.withColumn(SALT, F.when(F.col(SALT), draw).otherwise(F.lit(0)))
    first = salted.groupBy(*keys, SALT).agg(*[c.alias(n) for n, c in partial.items()])
    return first.groupBy(*keys).agg(*[c.alias(n) for n, c in merge.items()])


def edge_ends(edges: DataFrame, sides: list[str], *values: str) -> DataFrame:
    """One ``(extremo, clave, *values)`` row for each side of each edge, null ends included."""
    ends = F.array(*[F.struct(F.lit(s).alias("extremo"), F.col(s).alias("clave")) for s in sides])
    return edges.select(F.explode(ends).alias("e"), *values).select("e.extremo", "e.clave", *values)


def totals_by_end(edges: DataFrame, sides: list[str], weight: str, value: str, share: float = 0.01) -> DataFrame:
    """Rows, sum of ``weight`` and sum of ``value`` for each non-null key of either side.

    ``pesada`` tells whether the key holds at least ``share`` of all rows of the table (rows with a missing end
    count in the whole). Repeated edges count as often as they occur; null weights and values add nothing and give
    a null sum where there is nothing else. An empty table gives no row.
    """
    ends = edge_ends(edges, sides, weight, value)
    heavy = heavy_candidates(ends, "extremo", "clave", share)
    totals = salted_aggregate(
        ends,
        ["extremo", "clave"],
        {"n": F.count(F.lit(1)), "w": F.sum(weight), "v": F.sum(value)},
        {"n_filas": F.sum("n"), "peso_total": F.sum("w"), "valor_total": F.sum("v")},
        heavy,
    )
    whole = edges.agg(F.count(F.lit(1)).alias("__all"))
    return (
        totals.where("clave is not null")
        .crossJoin(F.broadcast(whole))
        .withColumn("pesada", F.col("n_filas") >= F.col("__all") * F.lit(share))
        .drop("__all")
    )


def heavy_keys(edges: DataFrame, sides: list[str], share: float = 0.01) -> DataFrame:
    """The non-null keys that hold at least ``share`` of all rows in their column: ``extremo, clave, n_filas``.

    Only rows of candidate keys pass the salted aggregation, so a shuffle carries at most candidates x salts rows
    a task. Counts are exact. An empty table gives no row.
    """
    ends = edge_ends(edges, sides)
    heavy = heavy_candidates(ends, "extremo", "clave", share)
    few = ends.join(F.broadcast(heavy), ["extremo", "clave"])
    exact = salted_aggregate(
        few, ["extremo", "clave"], {"n": F.count(F.lit(1))}, {"n_filas": F.sum("n")}, heavy
    )
    whole = edges.agg(F.count(F.lit(1)).alias("__all"))
    return exact.crossJoin(F.broadcast(whole)).where(F.col("n_filas") >= F.col("__all") * F.lit(share)).drop("__all")


def risk_triangles(edges: DataFrame, kind: str, origin: str, target: str) -> DataFrame:
    """Buyer, joint venture and member where the buyer awards to both: ``entidad, ut, socio``, each once.

    Repeated edges count once, an actor that is a member of itself gives nothing, missing ends are left out.
    For each membership the buyers of whichever actor has fewer are looked up among the awards of the other, so the
    rows between the joins stay within edges x sqrt(edges) even when one venture or member has most awards.
    """
    ends = edges.where(f"{origin} is not null and {target} is not null")
    awards = ends.where(F.col(kind) == "adjudica").select(F.col(origin).alias("entidad"), F.col(target).alias("actor"))
    awards = awards.distinct()
    members = ends.where((F.col(kind) == "integra") & (F.col(origin) != F.col(target)))
    members = members.select(F.col(origin).alias("ut"), F.col(target).alias("socio")).distinct()
    degree = awards.groupBy("actor").agg(F.count(F.lit(1)).alias("d"))
    sized = members.join(degree.select(F.col("actor").alias("ut"), F.col("d").alias("du")), "ut").join(
        degree.select(F.col("actor").alias("socio"), F.col("d").alias("ds")), "socio"
    )
    from_ut = F.col("du") <= F.col("ds")
    oriented = sized.select(
        "ut", "socio", F.when(from_ut, F.col("ut")).otherwise(F.col("socio")).alias("few"),
        F.when(from_ut, F.col("socio")).otherwise(F.col("ut")).alias("actor"),
    )
    wedges = oriented.join(awards.select("entidad", F.col("actor").alias("few")), "few")
    return wedges.join(awards, ["entidad", "actor"], "left_semi").select("entidad", "ut", "socio")


def triangles_by_key(edges: DataFrame, kind: str, origin: str, target: str, share: float = 0.01) -> DataFrame:
    """Number of risk triangles for each actor and part (``entidad``, ``ut`` or ``socio``): ``extremo, clave, n``."""
    ends = edge_ends(risk_triangles(edges, kind, origin, target), ["entidad", "ut", "socio"])
    heavy = heavy_candidates(ends, "extremo", "clave", share)
    return salted_aggregate(
        ends, ["extremo", "clave"], {"n": F.count(F.lit(1))}, {"n_triangulos": F.sum("n")}, heavy
    )
