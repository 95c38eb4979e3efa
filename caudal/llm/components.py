"""Consolidation of pairwise links into groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caudal.session import Stages

BLANKS = " \t\n\r\u00a0"


def levelled_id(c: Column) -> Column:
    """An identifier without outer blanks, in upper case; an empty one is null."""
    return F.nullif(F.upper(F.btrim(c.cast("string"), F.lit(BLANKS))), F.lit(""))


def accepted_links(pairs: DataFrame, left: str, right: str, score: str | None, at_least: float) -> DataFrame:
    """Distinct undirected links ``(a, b)`` with ``a < b`` among the scored pairs.

    A pair counts when a row of it, in either order, has ``score >= at_least``; null and NaN scores, missing ends
    and pairs of a record with itself give nothing.
    """
    l, r = levelled_id(F.col(left)), levelled_id(F.col(right))
    rows = pairs
    if score:
        s = F.col(score)
        rows = rows.where(s.isNotNull() & ~F.isnan(s.cast("double")) & (s >= at_least))
    ends = rows.select(l.alias("l"), r.alias("r")).where("l is not null and r is not null and l <> r")
    return ends.select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b")).distinct()


def group_labels(links: DataFrame, *, max_rounds: int = 200) -> DataFrame:
    """Smallest identifier of its group for every end of ``links(a, b)``: columns ``id, label``.

    Every round sends each record the smallest label among its neighbours, hands that label on to the record's
    present representative as well, and then jumps pointers (a label is replaced by its own label), so distances
    shrink by about half a round and a chain of n links needs about log2(n) rounds. Each round is written to the
    shared folder; the loop ends when a round changes no label. Identifiers are compared by their characters.

    Labels only ever fall, so a round that changes nothing is the fixed point: neighbours have equal labels.
    The hot ends of star-shaped groups are combined before the shuffle (min is associative); the joins carry one
    row for each record on the label side, so the adaptive planner can split the other side of a skewed key.
    Nulls, blanks and self pairs must be removed before (``accepted_links``). An empty input gives no row.
    """
    spark = links.sparkSession
    stages = Stages(spark, "groups")
    both = links.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(
        links.select(F.col("b").alias("id"), F.col("a").alias("other"))
    )
    edges = stages.cut(both, "edges")
    labels = stages.cut(
        edges.groupBy("id").agg(F.min("other").alias("m")).select("id", F.least("id", "m").alias("label")), "labels"
    )
    for _ in range(max_rounds):
        of_other = labels.select(F.col("id").alias("other"), F.col("label").alias("seen"))
        nearest = edges.join(of_other, "other").groupBy("id").agg(F.min("seen").alias("seen"))
        known = labels.join(nearest, "id")
        told = known.select(
            F.explode(
                F.array(
                    F.struct("id", F.least("label", "seen").alias("label"), F.col("label").alias("old")),
                    F.struct(F.col("label").alias("id"), F.col("seen").alias("label"), F.lit(None).cast("string").alias("old")),
                )
            ).alias("t")
        ).select("t.*")
        hooked = told.groupBy("id").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        up = hooked.select(F.col("id").alias("label"), F.col("label").alias("above"))
        jumped = hooked.join(up, "label").select("id", F.col("above").alias("label"), "old")
        after = stages.cut(jumped, "labels")
        moved = after.where("label <> old").limit(1).count()
        labels = after.select("id", "label")
        if not moved:
            stages.drop("edges")
            return labels
    raise RuntimeError(f"labels still changed after {max_rounds} rounds")


def consolidate(
    pairs: DataFrame,
    left: str,
    right: str,
    score: str | None = None,
    at_least: float = 0.95,
    records: DataFrame | None = None,
    record_id: str | None = None,
) -> DataFrame:
    """One ``(id, group)`` row for every record, linked directly or through others.

    With ``records`` also those without any link come out, as groups of one. Repeated and reversed pairs count
    once; ids that ``records`` does not know still count. Extra columns of any name are ignored.
    """
    labels = group_labels(accepted_links(pairs, left, right, score, at_least))
    out = labels.select("id", F.col("label").alias("group"))
    if records is None:
        return out
    alone = records.select(levelled_id(F.col(record_id)).alias("id")).where("id is not null").distinct()
    return alone.join(out, "id", "full_outer").select("id", F.coalesce("group", "id").alias("group"))
