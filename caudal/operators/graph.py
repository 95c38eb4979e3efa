"""Graph measures by joins and aggregations over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.session import Stages


def undirected(edges: DataFrame, a: str, b: str, weight: str | None = None) -> DataFrame:
    """Distinct pairs ``a < b`` with summed weight ``w``; loops and missing ends are left out."""
    w = F.sum(F.coalesce(weight, F.lit(1))) if weight else F.count(F.lit(1))
    ends = edges.where(f"{a} <> {b}")
    return ends.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(w.cast("double").alias("w"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each pair in both directions: ``id, other, w``; one scan, no shuffle."""
    turn = F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))
    return pairs.select(F.explode(turn).alias("e"), "w").select("e.id", "e.other", "w")


def degrees(pairs: DataFrame) -> DataFrame:
    """``id, grado, fuerza``: neighbours and total weight."""
    return both_ways(pairs).groupBy("id").agg(F.count(F.lit(1)).alias("grado"), F.sum("w").alias("fuerza"))


def pagerank(pairs: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, rounds: int = 100, exact_rounds: bool = False) -> DataFrame:
    """Weighted PageRank ``id, rank`` of the undirected graph.

    Stops when ranks move by less than ``tolerance`` a vertex in sum, or after exactly ``rounds`` rounds with
    ``exact_rounds``; otherwise running out of rounds is an error. Every vertex has an edge, so no mass dangles.
    """
    stages = Stages(pairs.sparkSession, "pagerank")
    sides = both_ways(pairs)
    force = sides.groupBy("id").agg(F.sum("w").alias("f"))
    shares = stages.cut(sides.join(force, "id").select("id", "other", (F.col("w") / F.col("f")).alias("share")), "shares")
    ids = stages.cut(force.select("id"), "ids")
    n = ids.count()
    if not n:
        return ids.select("id", F.lit(0.0).alias("rank"))
    ranks = ids.select("id", F.lit(1.0 / n).alias("rank"))
    for _ in range(rounds):
        given = shares.join(ranks, "id").groupBy("other").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = given.select(F.col("other").alias("id"), (F.lit((1 - damping) / n) + damping * F.col("got")).alias("rank"))
        new = stages.cut(new, "ranks") if exact_rounds else stages.cut(new.join(ranks.withColumnRenamed("rank", "old"), "id"), "ranks")
        if not exact_rounds:
            moved = new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
            if moved < n * tolerance:
                return new.select("id", "rank")
        ranks = new.select("id", "rank")
    if exact_rounds:
        return ranks
    raise RuntimeError(f"no convergence in {rounds} rounds")


def components(pairs: DataFrame, rounds: int = 100) -> DataFrame:
    """``id, componente`` (smallest id) by alternating large and small stars over the edge set.

    Each step rewires edges towards the smallest neighbour; the edge set shrinks to stars around the smallest ids
    and the loop ends when a round leaves it as it was.
    """
    stages = Stages(pairs.sparkSession, "components")
    edges = stages.cut(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")), "edges")

    def summary(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = summary(edges)
    for _ in range(rounds):
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sides.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = sides.join(low, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        large = stages.cut(large.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "large")
        down = large.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("m"), F.col("u").alias("x"), "v")
        rewired = small.select("m", F.explode(F.array("x", "v")).alias("v")).where("m <> v")
        edges = stages.cut(rewired.select(F.least("m", "v").alias("u"), F.greatest("m", "v").alias("v")).distinct(), "edges")
        after = summary(edges)
        if after == before:
            label = edges.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("componente"))
            roots = edges.select("u").distinct().join(label, F.col("u") == F.col("id"), "left_anti").select(F.col("u").alias("id"), F.col("u").alias("componente"))
            return label.unionByName(roots)
        before = after
    raise RuntimeError(f"edges still changed after {rounds} rounds")


def triangles(pairs: DataFrame) -> DataFrame:
    """Each triangle once, ``x, y, z``; edges point from lower to higher degree, so open wedges stay within edges^1.5."""
    d = both_ways(pairs).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    key = lambda end, c: d.select(F.col("id").alias(end), F.struct("d", "id").alias(c))
    sized = pairs.select("a", "b").join(key("a", "ka"), "a").join(key("b", "kb"), "b").select("ka", "kb")
    out = sized.select(F.least("ka", "kb").alias("lo"), F.greatest("ka", "kb").alias("hi")).select(F.col("lo.id").alias("s"), F.col("hi.id").alias("t"), F.col("hi").alias("k"))
    one, two = out.select("s", F.col("t").alias("y"), F.col("k").alias("ky")), out.select("s", F.col("t").alias("z"), F.col("k").alias("kz"))
    wedges = one.join(two, "s").where("ky < kz").select(F.col("s").alias("x"), "y", "z")
    closing = out.select(F.col("s").alias("y"), F.col("t").alias("z"))
    return wedges.join(closing, ["y", "z"], "left_semi").select("x", "y", "z")


def k_core(pairs: DataFrame, k: int, rounds: int = 1000) -> DataFrame:
    """The edges that stay when vertices of fewer than ``k`` neighbours are removed until none is left."""
    stages = Stages(pairs.sparkSession, "kcore")
    left, n = stages.cut(pairs, "edges"), -1
    for _ in range(rounds):
        m = left.count()
        if m == n or not m:
            return left
        n = m
        keep = both_ways(left).groupBy("id").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") >= k).select("id")
        inner = left.join(keep, left["a"] == keep["id"], "left_semi").join(keep, F.col("b") == keep["id"], "left_semi")
        left = stages.cut(inner, "edges")
    raise RuntimeError(f"not done after {rounds} rounds")


def communities(pairs: DataFrame, rounds: int = 1000, least: float = 1e-5) -> DataFrame:
    """``id, comunidad`` (smallest id) by modularity: vertices move in rounds, then communities become vertices (Louvain).

    In a round about half of the vertices, by a digest of id and round, may move to the neighbouring community of largest
    gain; a round counts only if it raises the modularity by ``least``, so the method always ends. A level ends
    after two rounds in a row that don't; then each community becomes one vertex, and the whole ends with a level in
    which nothing moved. Running out of rounds is an error. An empty graph gives no row.
    """
    stages = Stages(pairs.sparkSession, "communities")
    edges = stages.cut(pairs.select("a", "b", "w"), "edges")
    whole = edges.agg(F.sum("w")).first()[0]
    members = stages.cut(both_ways(edges).select("id").distinct().withColumn("comunidad", F.col("id")), "members")
    if not whole:
        return members
    turn, quality = 0, None
    while True:
        sides = stages.cut(both_ways(edges.where("a <> b")), "sides")
        force = both_ways(edges).groupBy("id").agg(F.sum("w").alias("k"))
        labels, held_by = stages.cut(force.withColumn("c", F.col("id")), f"start{turn}"), f"start{turn}"
        if quality is None:
            quality = _quality(edges, labels, whole)
        failed = moved = 0
        while failed < 2:
            if turn == rounds:
                raise RuntimeError(f"communities still moved after {rounds} rounds")
            turn += 1
            total = labels.groupBy("c").agg(F.sum("k").alias("t"))
            seen = sides.join(labels.select(F.col("id").alias("other"), "c"), "other").groupBy("id", "c").agg(F.sum("w").alias("w"))
            held = labels.select("id", "c").withColumn("w", F.lit(0.0))
            seen = seen.unionByName(held).groupBy("id", "c").agg(F.sum("w").alias("w"))
            seen = seen.join(labels.select("id", "k", F.col("c").alias("own")), "id").join(total, "c")
            stays = F.col("c") == F.col("own")
            rest = F.col("t") - F.when(stays, F.col("k")).otherwise(0.0)
            gain = F.round(F.col("w") - F.col("k") * rest / F.lit(2.0 * whole), 9)
            best = seen.groupBy("id").agg(F.min(F.struct((-gain).alias("g"), (~stays).alias("away"), "c")).alias("b"))
            may = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0
            new = labels.join(best, "id").select("id", "k", F.when(may, F.col("b.c")).otherwise(F.col("c")).alias("c"))
            new, tag = stages.cut(new, f"labels{turn}"), f"labels{turn}"
            q = _quality(edges, new, whole)
            if q > quality + least:
                stages.drop(held_by)
                labels, held_by, quality, failed, moved = new, tag, q, 0, moved + 1
            else:
                stages.drop(tag)
                failed += 1
        name = labels.select(F.col("id").alias("comunidad"), F.col("c").alias("new"))
        members = stages.cut(members.join(name, "comunidad").select("id", F.col("new").alias("comunidad")), "members")
        if not moved:
            least_id = members.groupBy("comunidad").agg(F.min("id").alias("name"))
            return members.join(least_id, "comunidad").select("id", F.col("name").alias("comunidad"))
        ends = lambda e: labels.select(F.col("id").alias(e), F.col("c").alias(f"c{e}"))
        merged = edges.join(ends("a"), "a").join(ends("b"), "b").groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))
        edges = stages.cut(merged.agg(F.sum("w").alias("w")), "edges")


def _quality(edges: DataFrame, labels: DataFrame, whole: float) -> float:
    """Modularity of ``labels(id, k, c)``; ``edges`` may have loops, which lie within their vertex."""
    ends = lambda e: labels.select(F.col("id").alias(e), F.col("c").alias(f"c{e}"))
    inside = edges.join(ends("a"), "a").join(ends("b"), "b").where("ca = cb").agg(F.sum("w")).first()[0] or 0.0
    spread = labels.groupBy("c").agg(F.sum("k").alias("t")).agg(F.sum(F.pow(F.col("t") / (2.0 * whole), 2))).first()[0]
    return inside / whole - spread


def modularity(pairs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """One row ``comunidades, modularidad`` of a labelling, by two aggregations."""
    l = labels.select("id", F.col(label).alias("c"))
    named = pairs.join(l.withColumnRenamed("id", "a").withColumnRenamed("c", "ca"), "a").join(l.withColumnRenamed("id", "b").withColumnRenamed("c", "cb"), "b")
    inside = named.where("ca = cb").groupBy(F.col("ca").alias("c")).agg(F.sum("w").alias("l"))
    force = degrees(pairs).join(l, "id").groupBy("c").agg(F.sum("fuerza").alias("d"))
    whole = pairs.agg(F.sum("w").alias("m"))
    each = force.join(inside, "c", "left").crossJoin(F.broadcast(whole))
    part = F.coalesce("l", F.lit(0.0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)
    return each.agg(F.count(F.lit(1)).alias("comunidades"), F.sum(part).alias("modularidad"))


def propagate(awards: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """Mean of ``columns`` over the other actors with which an actor shares buyers, once for each shared buyer.

    ``awards`` has distinct ``entidad, actor``; ``values`` has ``actor`` and the columns. The projection of
    actors on actors is never built: sums by buyer minus the actor's own value, divided by the number of others.
    """
    rows = awards.join(values, "actor")
    sums = rows.groupBy("entidad").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(f"__s_{c}") for c in columns])
    back = rows.join(sums, "entidad").groupBy("actor").agg(
        F.sum(F.col("__n") - 1).alias("vecinos"), *[F.sum(F.col(f"__s_{c}") - F.col(c)).alias(f"__t_{c}") for c in columns]
    )
    return back.select("actor", "vecinos", *[F.coalesce(F.try_divide(F.col(f"__t_{c}"), F.col("vecinos")), F.lit(0.0)).alias(f"{c}_vecinos") for c in columns])


def hops(awards: DataFrame, values: DataFrame, columns: list[str], steps: int = 2) -> DataFrame:
    """``actor, vecinos``, the columns, and their means ``c_1`` ... ``c_steps`` one to ``steps`` applications of ``propagate`` away.

    Each step is written to the shared folder, so the next starts from a table of one row an actor.
    """
    stages = Stages(values.sparkSession, "hops")
    out = last = values
    for step in range(1, steps + 1):
        near = stages.cut(propagate(awards, last, columns), f"step{step}")
        last = near.select("actor", *[F.col(f"{c}_vecinos").alias(c) for c in columns])
        named = near.select("actor", *(["vecinos"] if step == 1 else []), *[F.col(f"{c}_vecinos").alias(f"{c}_{step}") for c in columns])
        out = out.join(named, "actor")
    return out
