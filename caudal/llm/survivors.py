"""Best representative of each group of duplicate records, by Bayesian fusion with copy detection."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caudal.session import Stages

#: Accuracy a source starts with; number of false values that a field is thought to have; share of a copier's
#: values that it copies; prior probability that two sources depend on each other.
ACCURACY, FALSE_VALUES, COPIED, DEPENDENT = 0.8, 10, 0.8, 0.2
ROUNDS = 4
#: Sources are kinds of origin, which don't grow with the records; beyond this the fusion refuses to start.
MOST_SOURCES = 1000
#: Log-odds that a declared order gives its first value against any other. Votes of MOST_SOURCES sources can't reach it.
DECLARED = 10_000.0
#: Width of the ranges of votes whose exponentials are added up together.
RANGE = 50.0


@dataclass
class Fused:
    """``values``: ``grupo, campo, valor, fuentes, confianza, fecha``; ``accuracy`` by source; ``dependence`` of pairs."""

    values: DataFrame
    accuracy: dict[str, float]
    dependence: dict[tuple[str, str], float]


def _dependence(shared_true: int, shared_false: int, different: int, a: float, b: float) -> float:
    """Posterior probability that one of two sources copies the other."""
    n, c = FALSE_VALUES, COPIED
    same_true, same_false = a * b, (1 - a) * (1 - b) / n
    apart = max(1e-9, 1 - same_true - same_false)
    both = (a + b) / 2
    terms = (
        (shared_true, (both * c + same_true * (1 - c)) / same_true),
        (shared_false, ((1 - both) * c + same_false * (1 - c)) / same_false),
        (different, apart * (1 - c) / apart),
    )
    odds = math.log(DEPENDENT / (1 - DEPENDENT)) + sum(k * math.log(r) for k, r in terms)
    return 1 / (1 + math.exp(-min(max(odds, -50.0), 50.0)))


def fuse(claims: DataFrame, contested: list[str] | None = None, declared: list[str] | None = None, rounds: int = ROUNDS) -> Fused:
    """Posterior probability of every value that the records of a group claim for a field.

    ``claims`` has ``grupo, campo, valor (string), fuente, fecha`` and, for ``declared`` fields, ``orden`` (the smallest
    comes first); null values claim nothing, a null source is a source of its own. A round (1) adds up, for each value,
    the log-odds of its sources' accuracies, where a source counts only for the part it did not copy from more accurate
    sources of the same value; (2) turns the sums of a field into probabilities, with room for values nobody claims;
    (3) sets each source's accuracy to the mean probability of its claims; (4) judges for each pair of sources from the
    values they share whether one copies the other: shared false values are strong evidence, shared true ones weak,
    differing ones against it. Before the first round the pairs are judged by how often they agree at all, so that many
    copies of one bad source can't pass for a majority.

    Sources are judged by the ``contested`` fields alone (all by default): a field in which the records of a group differ
    by nature, such as their own codes, says nothing about who errs. In a ``declared`` field the value that comes first
    in ``orden`` has the prior log-odds DECLARED against the others; votes decide between values of equal order.

    Claims are combined to one row for each value before anything else, so neither repeated rows nor a group that
    holds a third of all records meet in one task: rows carry their set of sources, of bounded size, and sums
    over a group are combined before the shuffle. Only figures by source and by pair of sources reach the driver.
    """
    spark = claims.sparkSession
    stages = Stages(spark, "fusion")
    if "orden" not in claims.columns:
        claims = claims.withColumn("orden", F.lit(None).cast("long"))
    each = claims.where("valor is not null").groupBy("grupo", "campo", "valor", F.coalesce("fuente", F.lit("")).alias("fuente"))
    each = stages.cut(each.agg(F.max("fecha").alias("fecha"), F.min("orden").alias("orden")), "claims")
    sources = sorted(r["fuente"] for r in each.select("fuente").distinct().limit(MOST_SOURCES + 1).collect())
    if len(sources) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    index = {s: i for i, s in enumerate(sources)}
    ids = spark.createDataFrame([(s, i) for s, i in index.items()] or [("", 0)], "fuente string, f int")
    rows = each.join(F.broadcast(ids), "fuente").groupBy("grupo", "campo", "valor")
    rows = rows.agg(F.array_sort(F.collect_set("f")).alias("fs"), F.max("fecha").alias("fecha"), F.min("orden").alias("orden"))
    rows = stages.cut(rows, "rows")
    judges = rows if contested is None else rows.where(F.col("campo").isin(contested))
    covered = judges.select("grupo", "campo", F.explode("fs").alias("f")).groupBy("grupo", "campo").agg(F.array_sort(F.collect_set("f")).alias("fs"))
    together = {(r["a"], r["b"]): r["n"] for r in _pairs(covered).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).collect()}
    accuracy = np.full(max(1, len(sources)), ACCURACY)

    def dependences(shared: list[tuple[int, int, int, int]]) -> dict[tuple[int, int], float]:
        return {(a, b): _dependence(t, f, max(0, together[a, b] - t - f), accuracy[a], accuracy[b]) for a, b, t, f in shared}

    first = _pairs(judges.select("fs")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).collect()
    depends = dependences([(r["a"], r["b"], r["n"], 0) for r in first])
    for _ in range(rounds - 1):
        judged = stages.cut(_judged(judges, accuracy, depends), "judged")
        by_source = judged.select(F.explode("fs").alias("f"), "confianza").groupBy("f").agg(F.avg("confianza").alias("a")).collect()
        for r in by_source:
            accuracy[r["f"]] = min(0.99, max(0.05, r["a"]))
        shared = _pairs(judged.select("fs", (F.col("confianza") >= 0.5).alias("true"))).groupBy("a", "b")
        counts = shared.agg(F.count_if("true").alias("t"), F.count_if(~F.col("true")).alias("f")).collect()
        depends = dependences([(r["a"], r["b"], r["t"], r["f"]) for r in counts])
    prior = F.lit(0.0)
    if declared:
        start = rows.where(F.col("campo").isin(declared)).groupBy("grupo", "campo").agg(F.min("orden").alias("primero"))
        rows = rows.join(start, ["grupo", "campo"], "left")
        prior = F.when(F.col("campo").isin(declared) & ~F.col("orden").eqNullSafe(F.col("primero")), -DECLARED).otherwise(0.0)
    last = _judged(rows.withColumn("previo", prior).drop("orden", "primero"), accuracy, depends)
    names = F.array(*[F.lit(s) for s in sources] or [F.lit("")])
    out = stages.cut(last.withColumn("fuentes", F.transform("fs", lambda i: F.element_at(names, i + 1))).drop("fs"), "fused")
    return Fused(out, {s: float(accuracy[i]) for s, i in index.items()}, {(sources[a], sources[b]): p for (a, b), p in depends.items()})


def _pairs(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != "fs"]
    one = df.select("fs", F.posexplode("fs").alias("i", "a"), *rest)
    return one.select("a", F.explode(F.slice("fs", F.col("i") + 2, F.size("fs"))).alias("b"), *rest)


def _judged(rows: DataFrame, accuracy: np.ndarray, depends: dict[tuple[int, int], float]) -> DataFrame:
    """Rows with ``confianza``, the posterior probability of the value among those of its group and field."""
    sent = rows.sparkSession.sparkContext.broadcast((accuracy, depends))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, dep = sent.value
        known: dict[tuple[int, ...], float] = {}
        for batch in batches:
            votes = []
            for fs in batch.column(batch.schema.get_field_index("fs")).to_pylist():
                k = tuple(fs)
                if k not in known:
                    total, before = 0.0, []
                    for s in sorted(k, key=lambda s: (-a[s], s)):
                        own = 1.0
                        for t in before:
                            own *= 1 - COPIED * dep.get((min(s, t), max(s, t)), 0.0)
                        total += own * math.log(FALSE_VALUES * a[s] / (1 - a[s]))
                        before.append(s)
                    known[k] = total
                votes.append(known[k])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(votes, pa.float64())], names=[*batch.schema.names, "voto"])

    schema = rows.schema.simpleString()[len("struct<") : -1]
    voted = rows.mapInArrow(run, f"{schema},voto double")
    if "previo" in rows.columns:
        voted = voted.withColumn("voto", F.col("voto") + F.col("previo")).drop("previo")
    # Exponentials are added up by ranges of the votes, of which a field has a bounded number, so none is cut or lost.
    at = F.floor(F.col("voto") / RANGE)
    parts = voted.groupBy("grupo", "campo", at.alias("at")).agg(F.sum(F.exp(F.col("voto") - at * RANGE)).alias("e"), F.count(F.lit(1)).alias("n"))
    total = parts.groupBy("grupo", "campo").agg(F.collect_list(F.struct("at", "e")).alias("parts"), F.sum("n").alias("n"))
    free = F.struct(F.lit(0).cast("long").alias("at"), F.greatest(F.lit(0.0), F.lit(FALSE_VALUES + 1.0) - F.col("n")).alias("e"))
    total = total.select("grupo", "campo", F.concat("parts", F.array(free)).alias("parts")).withColumn("top", F.array_max(F.filter("parts", lambda p: p["e"] > 0))["at"])
    scaled = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["e"] * F.exp((p["at"] - F.col("top")) * RANGE))
    total = total.select("grupo", "campo", (F.log(scaled) + F.col("top") * RANGE).alias("total"))
    return voted.join(total, ["grupo", "campo"]).withColumn("confianza", F.exp(F.col("voto") - F.col("total"))).drop("total")


def most_probable(values: DataFrame, field: str) -> DataFrame:
    """``grupo``, the value of maximum posterior and its probability; ties go to the more recent, then the smaller one.

    One pass of hash-combined minima, so a group of any size is never gathered.
    """
    key = F.struct(-F.col("voto"), _late(F.col("fecha")), "valor", "confianza")
    best = values.where(F.col("campo") == field).groupBy("grupo").agg(F.min(key).alias("k"))
    return best.select("grupo", F.col("k.valor").alias(field), F.col("k.confianza").alias(f"{field}_confianza"))


def _late(date: Column) -> Column:
    """Later dates first, none last."""
    return F.coalesce(-F.unix_micros(date.cast("timestamp")), F.lit(2**63 - 1))


#: Weights of the digits from the right, for the check digit of a NIT (fixed values).
NIT_WEIGHTS = [3, 7, 13, 17, 19, 23, 29, 37, 41]


def usable_nit(c: Column) -> Column:
    """The nine digits of a NIT, or null.

    Its digits are nine, or nine and a check digit that fits; one digit repeated and 123456789 are not usable.
    """
    d = F.regexp_replace(c, "[^0-9]", "")
    nine = F.substring(d, 1, 9)
    total = sum((F.substring(d, 9 - i, 1).cast("int") * w for i, w in enumerate(NIT_WEIGHTS)), F.lit(0))
    rest = total % 11
    check = F.when(rest < 2, rest).otherwise(11 - rest)
    fits = (F.length(d) == 9) | ((F.length(d) == 10) & F.when(F.length(d) == 10, F.substring(d, 10, 1).cast("int") == check))
    good = fits & (nine != F.repeat(F.substring(d, 1, 1), F.lit(9))) & (nine != "123456789")
    return F.when(good, nine)


def writing(number: Column, name: Column) -> Column:
    """The kind of form a record comes from, told by its notation: the system that wrote a NIT and the case of the name.

    Sources by this rule are at most 6 x 3 x 2, however many records there are.
    """
    has = lambda p: F.coalesce(number.rlike(p), F.lit(False))
    notation = F.when(F.coalesce(F.btrim(number), F.lit("")) == "", "none").when(~has("[0-9]"), "word").when(has("[A-Za-z]"), "prefixed").when(has("[.]"), "dotted").when(has("-"), "dashed").otherwise("plain")
    case = F.when(name == F.upper(name), "upper").when(name == F.lower(name), "lower").otherwise("title")
    blanks = F.when(F.coalesce(name != F.btrim(name), F.lit(False)) | F.coalesce(number != F.btrim(number), F.lit(False)), "blanks").otherwise("tight")
    return F.concat_ws(" ", notation, F.coalesce(case, F.lit("title")), blanks)


#: Fields whose claims are right or wrong, by which sources are judged.
CONTESTED = ["nit_entidad", "nombre_entidad", "departamento", "orden_entidad"]


def buyer_claims(entities: DataFrame, groups: DataFrame) -> DataFrame:
    """What the records of each group with two or more codes claim; the source is the ``writing`` of the record.

    ``orden``: codes by most contracts (none counts as 0), then the latest record, then the smallest code; numbers of
    contracts from the largest; NITs from the latest record.
    """
    linked = groups.select(F.col("clave").alias("codigo_entidad"), "grupo").distinct()
    several = linked.groupBy("grupo").agg(F.count_distinct("codigo_entidad").alias("n")).where("n > 1").select("grupo")
    need = ["codigo_entidad", "nit_entidad", "nombre_entidad", "departamento", "orden_entidad", "n_contratos_hist", "fecha_actualizacion"]
    rows = entities.select(*need).join(linked, "codigo_entidad").join(several, "grupo", "left_semi")
    late, none, zero = _late(F.col("fecha_actualizacion")), F.lit(""), F.lit(0).cast("long")
    count = F.coalesce(F.col("n_contratos_hist").cast("long"), zero)
    order = lambda *c: F.struct(*[x.alias(f"o{i}") for i, x in enumerate(c)])
    claim = lambda f, c, o=order(zero, zero, none): F.struct(F.lit(f).alias("campo"), c.cast("string").alias("valor"), o.alias("orden"))
    text = lambda c: F.nullif(F.btrim(c), F.lit(""))
    fields = F.array(
        claim("codigo_entidad", F.col("codigo_entidad"), order(-count, late, F.col("codigo_entidad"))),
        claim("nit_entidad", usable_nit(F.col("nit_entidad")), order(late, zero, none)),
        claim("n_contratos_hist", F.col("n_contratos_hist"), order(-count, zero, none)),
        claim("nombre_entidad", F.upper(text("nombre_entidad"))),
        claim("departamento", F.initcap(text("departamento"))),
        claim("orden_entidad", F.initcap(text("orden_entidad"))),
    )
    source = writing(F.col("nit_entidad"), F.col("nombre_entidad"))
    rows = rows.select("grupo", F.explode(fields).alias("x"), source.alias("fuente"), F.col("fecha_actualizacion").alias("fecha"))
    return rows.select("grupo", "x.campo", "x.valor", "x.orden", "fuente", "fecha")


def surviving_buyers(entities: DataFrame, groups: DataFrame) -> DataFrame:
    """One built record for each buyer with several codes, field by field by maximum posterior.

    The code and the number of contracts have a declared order (counts only grow, so the largest is the most
    recent true one); NIT, name, department and order are decided by the votes of the sources alone. ``*_confianza`` are
    posterior probabilities. Groups without any usable value of a field have null there.
    """
    return _survivors(fuse(buyer_claims(entities, groups), CONTESTED, ["codigo_entidad", "n_contratos_hist"]), ["codigo_entidad", "n_contratos_hist", *CONTESTED])


def chosen_buyers(entities: DataFrame, groups: DataFrame) -> DataFrame:
    """``codigo_entidad, nit_entidad, n_contratos_hist`` of each buyer with several codes, of maximum posterior.

    The order declared for each field is its prior: the code of the record with most contracts (then latest, then
    smallest), the largest number of contracts, the usable NIT of the most recent record. The votes of the sources, less
    what they copied, decide where that order is silent, such as between NITs of the same moment.
    """
    fields = ["codigo_entidad", "nit_entidad", "n_contratos_hist"]
    return _survivors(fuse(buyer_claims(entities, groups), CONTESTED, fields), fields).select(*fields)


def _survivors(fused: Fused, fields: list[str]) -> DataFrame:
    out = most_probable(fused.values, fields[0])
    for field in fields[1:]:
        out = out.join(most_probable(fused.values, field), "grupo", "left")
    return out.withColumn("n_contratos_hist", F.col("n_contratos_hist").cast("long")).drop("grupo")
