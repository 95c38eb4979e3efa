"""Mixing sources to target weights under a cap on repetitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Parts into which a range of hashes is cut at a time; documents of a range that are gone through one by one; end of the hashes.
PARTS, FEW, END = 1024, 512, 2**63 - 1


def feasible_total(sizes: dict[str, int], weights: dict[str, float], caps: dict[str, int]) -> float:
    """The largest total at which every source that has any tokens still meets its share within its cap."""
    live = [s for s in weights if weights[s] > 0 and sizes.get(s, 0) > 0 and caps[s] > 0]
    mass = sum(weights[s] for s in live)
    return min((caps[s] * sizes[s] * mass / weights[s] for s in live), default=0.0)


def water_fill(sizes: dict[str, int], weights: dict[str, float], caps: dict[str, int], total: float) -> dict[str, float]:
    """Tokens to take from each source: shares of ``total`` by weight, none above ``cap x size``.

    Sources whose share is above their ceiling are clamped to it; what they can't give is shared among the others
    in proportion to their weights, again and again until none is above its ceiling (or all are clamped, when the
    sum stays below ``total``). Sources without tokens have ceiling 0.
    """
    ceiling = {s: caps[s] * sizes.get(s, 0) for s in weights}
    fixed: dict[str, float] = {s: 0.0 for s in weights if weights[s] <= 0}
    while True:
        free = [s for s in weights if s not in fixed]
        mass = sum(weights[s] for s in free)
        left = max(0.0, total - sum(fixed.values()))
        over = [s for s in free if left * weights[s] / mass > ceiling[s] * (1 + 1e-12)]
        if not over:
            return fixed | {s: left * weights[s] / mass for s in free}
        fixed |= {s: float(ceiling[s]) for s in over}


def plan(sized: DataFrame, targets: DataFrame, total: float | None) -> DataFrame:
    """One row a source of either table: size, ceiling, tokens to take, whole repetitions and the rest in tokens.

    ``sized`` has ``source, n_tokens``; ``targets`` has ``source, peso, max_repeticiones`` and is a configuration
    table, which does not grow with the corpus; only its rows and the sums by source reach the driver.
    """
    spark = sized.sparkSession
    sums = sized.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("size"))
    wanted = targets.where("source is not null").groupBy("source").agg(F.max("peso").alias("peso"), F.max("max_repeticiones").alias("max_repeticiones"))
    rows = wanted.join(sums, "source", "left").collect()
    sizes = {r["source"]: int(r["size"] or 0) for r in rows}
    weights = {r["source"]: max(0.0, float(r["peso"] or 0)) for r in rows}
    caps = {r["source"]: max(0, int(r["max_repeticiones"] or 0)) for r in rows}
    goal = feasible_total(sizes, weights, caps) if total is None else float(total)
    take = water_fill(sizes, weights, caps, goal)
    out = []
    for r in rows:
        s, size = r["source"], sizes[r["source"]]
        whole = min(caps[s], int(take[s] / size + 1e-9)) if size else 0
        rest = max(0.0, take[s] - whole * size) if whole < caps[s] else 0.0
        out.append((s, weights[s], caps[s], int(r["docs"] or 0), size, float(take[s]), whole, rest))
    schema = "source string, peso double, max_repeticiones int, documentos long, tokens_fuente long, tokens_objetivo double, enteras int, resto double"
    return spark.createDataFrame(out, T._parse_datatype_string(schema))


def _fill(docs: pd.DataFrame) -> pd.DataFrame:
    """How many copies (``tomadas``) of each document of one range, in hash order, fit into what is left; then the best last one."""
    docs = docs.sort_values(["__h", "n_tokens"], kind="stable")
    left = float(docs["__left"].iloc[0])
    sizes, copies, taken = docs["n_tokens"].fillna(0).to_numpy(), docs["copias"].to_numpy(), np.zeros(len(docs), np.int64)
    for i, (n, k) in enumerate(zip(sizes, copies)):
        taken[i] = k if n <= 0 else min(k, int(left // n))
        left -= taken[i] * n
    if (taken < copies).any():
        i = np.where(taken < copies, np.abs(left - sizes), np.inf).argmin()
        taken[i] += abs(left - sizes[i]) < left
    return docs.assign(tomadas=taken)


def _last_ranges(docs: DataFrame, rests: dict[str, float]) -> dict[str, tuple[int, int, float]]:
    """For each source the range of hashes in which its rest ends, of at most FEW documents or a single hash, and what is left there.

    All documents below the range are taken and none above it. A round cuts each range into PARTS and keeps the one in
    which the sum passes the rest, so a source of n documents takes about log(n) / log(PARTS) rounds; only sums of
    the parts are gathered, and their running sum goes over PARTS rows.
    """
    spark = docs.sparkSession
    found = {s: (0, 0, 0.0) for s, rest in rests.items() if rest <= 0}
    at = {s: (0, END, rest) for s, rest in rests.items() if rest > 0}
    while at:
        width = {s: max(1, -(-(hi - lo) // PARTS)) for s, (lo, hi, _) in at.items()}
        state = spark.createDataFrame([(s, lo, hi, left, width[s]) for s, (lo, hi, left) in at.items()], "source string, __lo long, __hi long, __left double, __w long")
        inside = docs.join(F.broadcast(state), "source").where("__h >= __lo and __h < __hi").withColumn("__b", F.expr("(__h - __lo) div __w"))
        parts = inside.groupBy("source", "__b", "__left").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("k"))
        upto = F.sum("t").over(Window.partitionBy("source").orderBy("__b"))
        over = parts.withColumn("__to", upto).where("__to > __left").groupBy("source").agg(F.min(F.struct("__b", "k", (F.col("__to") - F.col("t")).alias("before"))).alias("p"))
        cut = {r["source"]: r["p"] for r in over.collect()}
        after = {}
        for s, (lo, hi, left) in at.items():
            if s not in cut:
                found[s] = (hi, hi, 0.0)  # the rest is all that the range holds
                continue
            low = lo + cut[s]["__b"] * width[s]
            state_of = (low, min(hi, low + width[s]), left - cut[s]["before"])
            (found if cut[s]["k"] <= FEW or width[s] == 1 else after)[s] = state_of
        at = after
    return found


def mix(sized: DataFrame, key: str, plan_rows: DataFrame, seed: int = 7) -> DataFrame:
    """The documents of the mix: ``key, source, n_tokens, repeticiones``.

    Each source comes ``enteras`` times whole; for the rest, its documents are put in the order of a seeded hash of key and
    size and taken until ``resto`` tokens are reached. Ranges of the hash are narrowed until the one where the rest
    ends has at most FEW documents (``_last_ranges``); only those are gone through one by one, skipping documents
    that no longer fit. Copies of one row count as one document with a number there, so no task holds them. The choice
    depends on key, size and seed alone. Documents without source or of a source without target are left out.
    """
    rows = [(r["source"], int(r["enteras"]), float(r["resto"])) for r in plan_rows.select("source", "enteras", "resto").collect()]
    docs = sized.select(key, "source", "n_tokens", F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key), "n_tokens"), 1).alias("__h"))
    last = _last_ranges(docs, {s: rest for s, _, rest in rows})
    state = sized.sparkSession.createDataFrame([(s, e, *last[s]) for s, e, _ in rows], "source string, enteras int, __lo long, __hi long, __left double")
    placed = docs.join(F.broadcast(state), "source")
    inside = (F.col("__h") >= F.col("__lo")) & (F.col("__h") < F.col("__hi"))
    done = placed.where(~inside).select(key, "source", "n_tokens", (F.col("enteras") + (F.col("__h") < F.col("__lo")).cast("int")).alias("repeticiones"))
    edge = placed.where(inside).groupBy(key, "source", "n_tokens", "__h", "enteras", "__left").agg(F.count(F.lit(1)).alias("copias")).withColumn("tomadas", F.lit(0).cast("long"))
    edge = edge.groupBy("source").applyInPandas(_fill, edge.schema)
    times = F.array(F.struct((F.col("enteras") + 1).alias("r"), F.col("tomadas").alias("n")), F.struct(F.col("enteras").alias("r"), (F.col("copias") - F.col("tomadas")).alias("n")))
    edge = edge.select(key, "source", "n_tokens", F.explode(times).alias("x")).where("x.n > 0 and x.r > 0")
    edge = edge.select(key, "source", "n_tokens", F.col("x.r").alias("repeticiones"), F.explode(F.sequence(F.lit(1).cast("long"), "x.n"))).drop("col")
    return done.unionByName(edge).where("repeticiones > 0")


def shares(mixed: DataFrame, plan_rows: DataFrame) -> DataFrame:
    """Target and reached share of each source, with its repetitions on average."""
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeticiones")).alias("tokens_mezcla"))
    rows = plan_rows.join(got, "source", "left").withColumn("tokens_mezcla", F.coalesce("tokens_mezcla", F.lit(0)))
    whole = F.sum("tokens_mezcla").over(Window.partitionBy())
    return rows.select(
        "source", "peso", "max_repeticiones", "documentos", "tokens_fuente", "tokens_objetivo", "tokens_mezcla",
        F.coalesce(F.try_divide(F.col("tokens_mezcla"), whole), F.lit(0.0)).alias("cuota"),
        F.coalesce(F.try_divide(F.col("tokens_mezcla"), F.col("tokens_fuente")), F.lit(0.0)).alias("repeticiones"),
    )
