"""Probabilistic record linkage: blocking, comparison vectors, parameters and weights."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Comparison:
    """A column compared on levels: conditions from the best to the worst; none of them is level 0, a null side -1."""

    name: str
    column: str
    levels: tuple

    def gamma(self) -> Column:
        l, r = F.col(f"{self.column}_l"), F.col(f"{self.column}_r")
        out = F.lit(0)
        for i, test in enumerate(reversed(self.levels)):
            out = F.when(test(l, r), F.lit(i + 1)).otherwise(out)
        return F.when(l.isNull() | r.isNull(), F.lit(-1)).otherwise(out).alias(f"g_{self.name}")


def exact(l: Column, r: Column) -> Column:
    return l == r


def within(distance: int):
    return lambda l, r: F.levenshtein(l, r) <= distance


def blocking_sizes(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """For each rule: blocks of two or more, the largest one, and the pairs it would give."""
    n = F.col("n").cast("double")
    parts = [
        df.select(F.lit(name).alias("regla"), key.cast("string").alias("clave")).where("clave is not null").groupBy("regla", "clave").agg(F.count(F.lit(1)).alias("n"))
        for name, key in rules.items()
    ]
    out = reduce(DataFrame.unionByName, parts).where("n > 1").groupBy("regla")
    return out.agg(F.count(F.lit(1)).alias("bloques"), F.max("n").alias("mayor"), F.sum(n * (n - 1) / 2).cast("long").alias("pares"))


def audited(df: DataFrame, rules: dict[str, Column], most: int) -> dict[str, Column]:
    """The rules, if none gives more than ``most`` pairs; else an error that names those which do."""
    bad = blocking_sizes(df, rules).where(F.col("pares") > most).collect()
    if bad:
        raise ValueError("blocking rules give too many pairs: " + ", ".join(f"{r['regla']} ({r['pares']})" for r in bad))
    return rules


def blocked_pairs(df: DataFrame, key: str, rules: dict[str, Column], columns: list[str]) -> DataFrame:
    """Distinct pairs ``l < r`` that agree on any rule, with the columns of both sides.

    One scan gives the keys of all rules and one join the pairs; the adaptive planner splits a hot block between tasks, since
    nothing but a new exchange follows. Work grows with the square of a block: ``blocking_sizes`` tells beforehand,
    ``audited`` refuses.
    """
    each = F.array(*[F.struct(F.lit(i).alias("i"), k.cast("string").alias("k")) for i, k in enumerate(rules.values())])
    side = df.select(F.col(key).alias("id"), F.explode(each).alias("x")).select("id", "x.i", "x.k").where("k is not null")
    pairs = side.withColumnRenamed("id", "l").join(side.withColumnRenamed("id", "r"), ["i", "k"]).where("l < r").select("l", "r").distinct()
    return with_sides(pairs, df, key, columns)


def with_sides(pairs: DataFrame, df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    out = pairs
    for side in ("l", "r"):
        out = out.join(df.select(F.col(key).alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
    return out


def patterns(pairs: DataFrame, comparisons: list[Comparison]) -> DataFrame:
    """Number of pairs of each comparison vector; the only thing that training has to see."""
    g = [c.gamma() for c in comparisons]
    return pairs.select(*g).groupBy(*[f"g_{c.name}" for c in comparisons]).agg(F.count(F.lit(1)).alias("n"))


def train(counts: list[dict], comparisons: list[Comparison], u: dict, start: float = 0.1, rounds: int = 50) -> tuple[float, dict]:
    """Share of matches and m-probabilities by expectation maximisation over counts of comparison vectors.

    ``u`` has the probability of each level among non-matches; a null level says nothing. The vectors number at
    most the product of the levels, so the driver holds them all.
    """
    size = {c.name: len(c.levels) + 1 for c in comparisons}
    m = {c.name: [(0.1 if i == 0 else 0.9 * (i / sum(range(1, size[c.name])))) for i in range(size[c.name])] for c in comparisons}
    share = start
    for _ in range(rounds):
        hits, total = 0.0, 0.0
        seen = {k: [1e-6] * n for k, n in size.items()}
        for row in counts:
            p, q = share, 1 - share
            for c in comparisons:
                g = row[f"g_{c.name}"]
                if g >= 0:
                    p, q = p * m[c.name][g], q * u[c.name][g]
            w = row["n"] * p / (p + q)
            hits, total = hits + w, total + row["n"]
            for c in comparisons:
                if (g := row[f"g_{c.name}"]) >= 0:
                    seen[c.name][g] += w
        share = hits / total if total else share
        m = {k: [x / sum(v) for x in v] for k, v in seen.items()}
    return share, m


def weigh(pairs: DataFrame, comparisons: list[Comparison], share: float, m: dict, u: dict) -> DataFrame:
    """Match weight log2(prior odds) + sum of log2(m/u), and the probability 2^w / (1 + 2^w)."""
    out = pairs.select("*", *[c.gamma() for c in comparisons])
    w = F.lit(math.log2(share / (1 - share)))
    for c in comparisons:
        bits = F.lit(0.0)
        for g in range(len(c.levels) + 1):
            bits = F.when(F.col(f"g_{c.name}") == g, F.lit(math.log2(m[c.name][g] / u[c.name][g]))).otherwise(bits)
        w = w + bits
    return out.withColumn("peso", w).withColumn("probabilidad", 1 / (1 + F.pow(F.lit(2.0), -F.col("peso"))))
