"""Risk orderings: features, propagation, metrics, comparison, models."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caudal.functions.casts import displayed
from caudal.operators import compare, graph, metrics
from caudal.plans import base
from caudal.plans.network import AWARD_PAIRS, _SIDES, award_pairs
from caudal.plans.registry import query
from caudal.plans.warehouse import _CRI, cri
from caudal.session import table

_PRED = f"""{_CRI}, g AS (SELECT codigo_proveedor, max(CASE WHEN es_grupo THEN 1 ELSE 0 END) AS y FROM {base.CONTRACTS} WHERE codigo_proveedor IS NOT NULL GROUP BY 1),
    pred AS MATERIALIZED (SELECT codigo_proveedor AS id, y, round(cri + 1e-12, 9) AS p, n, e FROM s JOIN g USING (codigo_proveedor))"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with a score (the risk index) and a label (whether they are groups)."""
    g = base.contracts(spark, sf_dir).where("codigo_proveedor is not null").groupBy("codigo_proveedor").agg(F.max(F.when(F.col("es_grupo"), 1).otherwise(0)).alias("y"))
    return cri(spark, sf_dir).join(g, "codigo_proveedor").select(F.col("codigo_proveedor").alias("id"), "y", F.round(F.col("cri") + 1e-12, 9).alias("p"), "n", "e")


@query(f"WITH {_PRED} SELECT id, y, p FROM pred")
def scored_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).select("id", "y", "p")


@query(
    f"""WITH {_PRED}, t AS (SELECT p, count(*) AS n, sum(y) AS pos FROM pred GROUP BY p), c AS (SELECT *, sum(n) OVER (ORDER BY p) - n + (n + 1) / 2.0::DOUBLE AS r, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS tot FROM t)
    SELECT round((sum(pos * r) - sum(pos) * (sum(pos) + 1) / 2.0::DOUBLE) / (sum(pos) * (sum(n) - sum(pos))) + 1e-7, 5) AS auc, round(sum(pos * tp / tot) / sum(pos) + 1e-7, 5) AS precision_media FROM c"""
)
def auc_and_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.auc_and_precision(predictions(spark, sf_dir))
    return m.select(displayed(F.col("auc"), 5).alias("auc"), displayed(F.col("precision_media"), 5).alias("precision_media"))


@query(
    f"""WITH {_PRED}, ord AS (SELECT *, row_number() OVER (ORDER BY p DESC, id) AS i FROM pred), w AS (SELECT sum(y) AS pp, count(*) AS nn FROM pred)
    SELECT CAST(k AS INTEGER) AS k, CAST(sum(y) AS BIGINT) AS aciertos, round(sum(y) / least(k, any_value(nn))::DOUBLE + 1e-7, 4) AS precision, round(sum(y) / any_value(pp)::DOUBLE + 1e-7, 4) AS cobertura,
    round(sum(y) / least(k, any_value(nn))::DOUBLE / (any_value(pp) / any_value(nn)::DOUBLE) + 1e-7, 4) AS ganancia FROM (VALUES (50), (100), (200), (500), (1000)) ks(k) JOIN ord ON i <= k, w GROUP BY k"""
)
def lift_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = metrics.top(predictions(spark, sf_dir), [50, 100, 200, 500, 1000])
    return t.select("k", "aciertos", *[displayed(F.col(c)).alias(c) for c in ("precision", "cobertura", "ganancia")])


@query(
    f"""WITH {_PRED}, t AS (SELECT p, count(*) AS n, sum(y) AS pos FROM pred GROUP BY p), c AS (SELECT p, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS tot FROM t), w AS (SELECT sum(y) AS pp, count(*) AS nn FROM pred)
    SELECT p AS umbral, round(tp / pp::DOUBLE + 1e-7, 4) AS tpr, round((tot - tp) / (nn - pp)::DOUBLE + 1e-7, 4) AS fpr, round(tp / tot::DOUBLE + 1e-7, 4) AS precision FROM c, w"""
)
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.curve(predictions(spark, sf_dir)).select("umbral", *[displayed(F.col(c)).alias(c) for c in ("tpr", "fpr", "precision")])


@query(f"WITH {_PRED} SELECT count(*) FILTER (WHERE p >= .4 AND y = 1) AS tp, count(*) FILTER (WHERE p >= .4 AND y = 0) AS fp, count(*) FILTER (WHERE p < .4 AND y = 1) AS fn, count(*) FILTER (WHERE p < .4 AND y = 0) AS tn, round(2.0::DOUBLE * count(*) FILTER (WHERE p >= .4 AND y = 1) / (2 * count(*) FILTER (WHERE p >= .4 AND y = 1) + count(*) FILTER (WHERE p >= .4 AND y = 0) + count(*) FILTER (WHERE p < .4 AND y = 1)) + 1e-7, 4) AS f1 FROM pred")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(predictions(spark, sf_dir), 0.4).withColumn("f1", displayed(F.col("f1")))


@query(f"WITH {_PRED}, t AS (SELECT p, count(*) AS n, sum(y) AS pos FROM pred GROUP BY p), c AS (SELECT p, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS tot FROM t) SELECT p AS umbral, round(2.0::DOUBLE * tp / (tot + (SELECT sum(y) FROM pred)), 9) AS f1 FROM c ORDER BY f1 DESC, umbral DESC LIMIT 1")
def f1_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_f1(predictions(spark, sf_dir))


@query(f"WITH {_PRED} SELECT round(avg((p - y) * (p - y)) + 1e-7, 5) AS brier FROM pred")
def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).agg(displayed(F.avg(F.pow(F.col("p") - F.col("y"), 2)), 5).alias("brier"))


@query(f"WITH {_PRED} SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS tramo, count(*) AS n, round(avg(p) + 1e-7, 4) AS media, round(avg(y) + 1e-7, 4) AS positivos FROM pred GROUP BY 1")
def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.reliability(predictions(spark, sf_dir)).select("tramo", "n", displayed(F.col("media")).alias("media"), displayed(F.col("positivos")).alias("positivos"))


REPLICATES = 2000


def replicates_sql(scores: dict[str, str]) -> str:
    """CTE ``a`` (m, r, auc): the AUC of each replicate for each of the named scores, which share their weights."""
    u = "CAST('0x' || substr(h, CAST(4 * k + 1 AS INTEGER), 4) AS INTEGER)"
    w = " + ".join(f"CAST({u} >= {math.ceil(c * 65536)} AS INTEGER)" for c in metrics.POISSON)
    each = " UNION ALL ".join(f"SELECT '{m}' AS m, r, {s} AS s, sum(w) AS n, sum(w * y) AS pos FROM b WHERE w > 0 GROUP BY r, {s}" for m, s in scores.items())
    return f"""{_PRED}, h AS MATERIALIZED (SELECT p, y, n, g, md5('b|' || CAST(g AS VARCHAR) || '|' || id) AS h FROM pred, range({REPLICATES // metrics.LANES}) t(g)),
    b AS MATERIALIZED (SELECT g * {metrics.LANES} + k AS r, p, y, n, {w} AS w FROM h, range({metrics.LANES}) l(k)), t AS ({each}),
    c AS (SELECT *, sum(n) OVER (PARTITION BY m, r ORDER BY s) - n + (n + 1) / 2.0::DOUBLE AS k FROM t), a AS (SELECT m, r, (sum(pos * k) - sum(pos) * (sum(pos) + 1) / 2.0::DOUBLE) / (sum(pos) * (sum(n) - sum(pos))) AS auc FROM c GROUP BY 1, 2)"""


@query(f"WITH {replicates_sql({'p': 'p'})} SELECT count(*) AS replicas, round(avg(auc) + 1e-7, 4) AS media, round(quantile_cont(auc, .025) + 1e-7, 4) AS bajo, round(quantile_cont(auc, .975) + 1e-7, 4) AS alto FROM a")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and 95 % interval of the AUC over 2,000 replicates."""
    a = metrics.bootstrap(predictions(spark, sf_dir), REPLICATES)
    q = lambda x: displayed(F.percentile("auc", F.lit(x)))
    return a.agg(F.count(F.lit(1)).alias("replicas"), displayed(F.avg("auc")).alias("media"), q(0.025).alias("bajo"), q(0.975).alias("alto"))


@query(
    f"""WITH {_PRED}, f AS (SELECT id, y, CAST(('0x' || left(md5('42|' || CAST(y AS VARCHAR) || '|' || id), 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM pred)
    SELECT y, u < .3 AS prueba, CASE WHEN u >= .3 THEN CAST(floor((u - .3) / (1 - .3::DOUBLE) * 3) AS INTEGER) END AS pliegue, count(*) AS n FROM f GROUP BY ALL"""
)
def strat_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = metrics.split(predictions(spark, sf_dir), "id", "y")
    return s.groupBy("y", "prueba", "pliegue").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_PRED} SELECT count(*) FILTER (WHERE p >= .4 AND n >= 10) AS ambos, count(*) FILTER (WHERE p >= .4 AND n < 10) AS solo_a, count(*) FILTER (WHERE p < .4 AND n >= 10) AS solo_b, count(*) FILTER (WHERE p < .4 AND n < 10) AS ninguno FROM pred"""
)
def overlap_2x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = metrics.overlap(F.col("p") >= 0.4, F.col("n") >= 10, predictions(spark, sf_dir))
    return t.select("ambos", "solo_a", "solo_b", "ninguno")


@query(f"WITH {_PRED} SELECT CASE WHEN n <= 1 THEN '0-1' WHEN n <= 5 THEN '2-5' ELSE '>5' END AS zona, count(*) AS actores, quantile_cont(p, 0.5) AS mediana, round(avg(e) + 1e-7, 4) AS entidades FROM pred GROUP BY 1")
def zone_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = F.when(F.col("n") <= 1, "0-1").when(F.col("n") <= 5, "2-5").otherwise(">5").alias("zona")
    return predictions(spark, sf_dir).groupBy(zone).agg(F.count(F.lit(1)).alias("actores"), F.percentile("p", F.lit(0.5)).alias("mediana"), displayed(F.avg("e")).alias("entidades"))


@query(f"WITH {_PRED}, r AS (SELECT p, n, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS rp, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0::DOUBLE AS rn FROM pred) SELECT round(corr(p, n) + 1e-7, 4) AS pearson, round(corr(rp, rn) + 1e-7, 4) AS spearman FROM r")
def rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson and Spearman correlation of index and number of contracts; ranks come from distinct values."""
    d = predictions(spark, sf_dir)

    def ranks(column: str) -> DataFrame:
        g = d.groupBy(column).agg(F.count(F.lit(1)).alias("k"))
        upto = F.sum("k").over(Window.orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
        return g.select(column, (upto - F.col("k") + (F.col("k") + 1) / 2.0).alias(f"r_{column}"))

    r = d.join(ranks("p"), "p").join(ranks("n"), "n")
    return r.agg(displayed(F.corr("p", F.col("n").cast("double"))).alias("pearson"), displayed(F.corr("r_p", "r_n")).alias("spearman"))


_ACTOR_EDGES = "(SELECT DISTINCT origen AS entidad, destino AS actor FROM vinculo_2025 WHERE tipo = 'adjudica' AND origen LIKE 'ENT:%' AND destino IS NOT NULL)"


def _hop_sql(name: str, of: str, columns: list[str]) -> str:
    """CTEs that end in ``name``: the means of ``columns`` of ``of`` over the other actors with which an actor shares buyers."""
    sums, back = ", ".join(f"sum({c}) AS t_{c}" for c in columns), ", ".join(f"CASE WHEN sum(n - 1) = 0 THEN 0 ELSE sum(t_{c} - {c}) / CAST(sum(n - 1) AS DOUBLE) END AS {c}" for c in columns)
    return f"""{name}_r AS MATERIALIZED (SELECT a.entidad, a.actor, {', '.join(columns)} FROM a JOIN {of} USING (actor)), {name}_s AS MATERIALIZED (SELECT entidad, count(*) AS n, {sums} FROM {name}_r GROUP BY 1),
    {name} AS MATERIALIZED (SELECT actor, sum(n - 1) AS vecinos, {back} FROM {name}_r JOIN {name}_s USING (entidad) GROUP BY 1)"""


@query(
    f"""WITH a AS MATERIALIZED {_ACTOR_EDGES}, x AS MATERIALIZED (SELECT destino AS actor, CAST(count(DISTINCT origen) AS DOUBLE) AS grado, CAST(sum(coalesce(peso, 1)) AS DOUBLE) AS fuerza FROM vinculo_2025 WHERE tipo = 'adjudica' AND origen LIKE 'ENT:%' AND destino IS NOT NULL GROUP BY 1),
    {_hop_sql('h1', 'x', ['grado', 'fuerza'])}, {_hop_sql('h2', 'h1', ['grado', 'fuerza'])}
    SELECT x.actor, x.grado, x.fuerza, CAST(h1.vecinos AS BIGINT) AS vecinos, round(h1.grado + 1e-7, 4) AS grado_1, round(h1.fuerza + 1e-7, 4) AS fuerza_1, round(h2.grado + 1e-7, 4) AS grado_2, round(h2.fuerza + 1e-7, 4) AS fuerza_2 FROM x JOIN h1 USING (actor) JOIN h2 USING (actor)"""
)
def sgc_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degree and strength of each actor and their means one and two steps away, without building the projection."""
    v = award_edges(spark, sf_dir)
    x = v.groupBy("actor").agg(F.count_distinct("entidad").cast("double").alias("grado"), F.sum(F.coalesce("peso", F.lit(1))).cast("double").alias("fuerza"))
    out = graph.hops(v.select("entidad", "actor").distinct(), x, ["grado", "fuerza"])
    return out.select("actor", "grado", "fuerza", "vecinos", *[displayed(F.col(c)).alias(c) for c in ("grado_1", "fuerza_1", "grado_2", "fuerza_2")])


def award_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "vinculo_2025").where(F.col("tipo") == "adjudica").where(F.col("origen").startswith("ENT:") & F.col("destino").isNotNull())
    return v.select(F.col("origen").alias("entidad"), F.col("destino").alias("actor"), "peso")


@query(
    f"""WITH a AS MATERIALIZED {_ACTOR_EDGES}, s AS (SELECT entidad, count(*) AS n FROM a GROUP BY 1)
    SELECT actor, entidad, parte FROM (SELECT a.actor, a.entidad, round(n / sum(n) OVER (PARTITION BY actor) + 1e-7, 4) AS parte, n FROM a JOIN s USING (entidad)) QUALIFY row_number() OVER (PARTITION BY actor ORDER BY n DESC, entidad) <= 5"""
)
def neighbour_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five buyers that contribute most to an actor's surroundings, with their share."""
    v = table(spark, sf_dir, "vinculo_2025").where(F.col("tipo") == "adjudica").where(F.col("origen").startswith("ENT:") & F.col("destino").isNotNull())
    a = v.select(F.col("origen").alias("entidad"), F.col("destino").alias("actor")).distinct()
    r = a.join(a.groupBy("entidad").agg(F.count(F.lit(1)).alias("n")), "entidad")
    every = Window.partitionBy("actor")
    r = r.withColumn("parte", displayed(F.col("n") / F.sum("n").over(every))).withColumn("i", F.row_number().over(every.orderBy(F.desc("n"), "entidad")))
    return r.where("i <= 5").select("actor", "entidad", "parte")


_FEATURES = f"""WITH p AS {AWARD_PAIRS}, d AS (SELECT id, count(*) AS grado, sum(w) AS fuerza FROM {_SIDES('p')} GROUP BY id),
    k AS (SELECT codigo_proveedor, count(*) AS n, CAST(sum(valor_del_contrato) AS DOUBLE) AS v FROM {base.CONTRACTS} WHERE codigo_proveedor IS NOT NULL GROUP BY 1)
    SELECT a.id_nodo, coalesce(grado, 0) AS grado, coalesce(fuerza, 0) AS fuerza, coalesce(n, 0) AS n_contratos, round(log10(coalesce(n, 0) + 1) + 1e-7, 4) AS log_n, round(log10(greatest(coalesce(v, 0), 0) + 1) + 1e-7, 4) AS log_valor
    FROM {base.ACTORS} a LEFT JOIN d ON d.id = a.id_nodo LEFT JOIN k USING (codigo_proveedor)"""


@query(_FEATURES)
def actor_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Network and contract features of each actor."""
    d = graph.degrees(award_pairs(spark, sf_dir)).withColumnRenamed("id", "id_nodo")
    k = base.contracts(spark, sf_dir).where("codigo_proveedor is not null").groupBy("codigo_proveedor").agg(F.count(F.lit(1)).alias("n"), F.sum("valor_del_contrato").cast("double").alias("v"))
    a = base.actors(spark, sf_dir).select("id_nodo", "codigo_proveedor").join(d, "id_nodo", "left").join(k, "codigo_proveedor", "left")
    n, v = F.coalesce("n", F.lit(0)), F.greatest(F.coalesce("v", F.lit(0.0)), F.lit(0.0))
    return a.select(
        "id_nodo", F.coalesce("grado", F.lit(0)).alias("grado"), F.coalesce("fuerza", F.lit(0.0)).alias("fuerza"), n.alias("n_contratos"), displayed(F.log10(n + 1)).alias("log_n"), displayed(F.log10(v + 1)).alias("log_valor")
    )


@query(
    f"""SELECT 'clave de contratos' AS control, count(*) AS casos, count(*) = 0 AS cumple FROM (SELECT id_contrato FROM {base.CONTRACTS} GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'fechas de contratos', count(*), count(*) = 0 FROM {base.CONTRACTS} WHERE fecha_fin < fecha_inicio
    UNION ALL SELECT 'aristas repetidas', count(*), count(*) = 0 FROM (SELECT tipo, origen, destino FROM vinculo_2025 GROUP BY ALL HAVING count(*) > 1)
    UNION ALL SELECT 'origen sin entidad', count(*), count(*) = 0 FROM (SELECT DISTINCT origen FROM vinculo_2025 WHERE tipo = 'adjudica' AND origen IS NOT NULL AND origen NOT IN (SELECT 'ENT:' || codigo_entidad FROM entidades))
    UNION ALL SELECT 'clave de procesos', count(*), count(*) = 0 FROM (SELECT id_del_proceso FROM {base.TENDERS} GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'clave de ofertas', count(*), count(*) = 0 FROM (SELECT id_oferta FROM {base.BIDS} GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'clave de actores', count(*), count(*) = 0 FROM (SELECT id_nodo FROM {base.ACTORS} GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'claves nulas', count(*), count(*) = 0 FROM contratos WHERE id_contrato IS NULL
    UNION ALL SELECT 'lazos', count(*), count(*) = 0 FROM vinculo_2025 WHERE origen = destino
    UNION ALL SELECT 'extremos que faltan', count(*), count(*) = 0 FROM vinculo_2025 WHERE origen IS NULL OR destino IS NULL
    UNION ALL SELECT 'valores negativos', count(*), count(*) = 0 FROM {base.CONTRACTS} WHERE valor_del_contrato < 0
    UNION ALL SELECT 'ofertas sin proceso', count(*), count(*) = 0 FROM {base.BIDS} WHERE id_del_proceso IS NOT NULL AND id_del_proceso NOT IN (SELECT id_portafolio FROM {base.TENDERS} WHERE id_portafolio IS NOT NULL)
    UNION ALL SELECT 'probabilidad fuera de 0 a 1', count(*), count(*) = 0 FROM pares WHERE NOT isnan(match_probability) AND (match_probability < 0 OR match_probability > 1)
    UNION ALL SELECT 'actor sin cuenta conocida', count(*), count(*) = 0 FROM {base.ACTORS} WHERE codigo_proveedor IS NOT NULL AND codigo_proveedor NOT IN (SELECT upper(trim(codigo_proveedor)) FROM proveedores WHERE codigo_proveedor IS NOT NULL)"""
)
def invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, v = base.contracts(spark, sf_dir), table(spark, sf_dir, "vinculo_2025")
    ent = base.buyers(spark, sf_dir).select(F.concat(F.lit("ENT:"), "codigo_entidad").alias("origen"))
    bids, actors = base.bids(spark, sf_dir), base.actors(spark, sf_dir)
    known = base.tenders(spark, sf_dir).select(F.col("id_portafolio").alias("id_del_proceso")).na.drop()
    accounts = table(spark, sf_dir, "proveedores").select(F.upper(F.trim("codigo_proveedor")).alias("codigo_proveedor")).na.drop()
    repeated = lambda df, k: df.groupBy(k).count().where("count > 1")
    return compare.invariants([
        ("clave de contratos", c.groupBy("id_contrato").count().where("count > 1")),
        ("fechas de contratos", c.where("fecha_fin < fecha_inicio")),
        ("aristas repetidas", v.groupBy("tipo", "origen", "destino").count().where("count > 1")),
        ("origen sin entidad", v.where("tipo = 'adjudica' and origen is not null").select("origen").distinct().join(ent, "origen", "left_anti")),
        ("clave de procesos", repeated(base.tenders(spark, sf_dir), "id_del_proceso")),
        ("clave de ofertas", repeated(bids, "id_oferta")),
        ("clave de actores", repeated(actors, "id_nodo")),
        ("claves nulas", table(spark, sf_dir, "contratos").where("id_contrato is null")),
        ("lazos", v.where("origen = destino")),
        ("extremos que faltan", v.where("origen is null or destino is null")),
        ("valores negativos", c.where("valor_del_contrato < 0")),
        ("ofertas sin proceso", bids.where("id_del_proceso is not null").join(known, "id_del_proceso", "left_anti")),
        ("probabilidad fuera de 0 a 1", table(spark, sf_dir, "pares").where("not isnan(match_probability) and (match_probability < 0 or match_probability > 1)")),
        ("actor sin cuenta conocida", actors.where("codigo_proveedor is not null").join(accounts, "codigo_proveedor", "left_anti")),
    ])


@query(
    f"""WITH a AS (SELECT codigo_entidad, count(*) AS n FROM {base.CONTRACTS} WHERE codigo_entidad IS NOT NULL GROUP BY 1), b AS (SELECT upper(trim(codigo_entidad)) AS codigo_entidad, max(n_contratos_hist) AS n FROM entidades GROUP BY 1)
    SELECT 'n' AS columna, count(*) FILTER (WHERE a.codigo_entidad IS NOT NULL AND b.codigo_entidad IS NOT NULL AND a.n IS NOT DISTINCT FROM b.n) AS iguales, count(*) FILTER (WHERE a.codigo_entidad IS NOT NULL AND b.codigo_entidad IS NOT NULL AND a.n IS DISTINCT FROM b.n) AS distintas,
    count(*) FILTER (WHERE b.codigo_entidad IS NULL) AS solo_a, count(*) FILTER (WHERE a.codigo_entidad IS NULL) AS solo_b FROM a FULL JOIN b USING (codigo_entidad)""".replace("FULL JOIN b USING (codigo_entidad)", "FULL JOIN b ON a.codigo_entidad = b.codigo_entidad")
)
def compare_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted contracts of each buyer against those its record states."""
    a = base.contracts(spark, sf_dir).where("codigo_entidad is not null").groupBy("codigo_entidad").agg(F.count(F.lit(1)).alias("n"))
    b = table(spark, sf_dir, "entidades").groupBy(F.upper(F.trim("codigo_entidad")).alias("codigo_entidad")).agg(F.max("n_contratos_hist").alias("n"))
    return compare.compare_tables(a, b, ["codigo_entidad"])


FEATURES = ["log_valor", "log_n", "reparto", "adicion", "anios", "grado", "fuerza"]
#: What a model of the index learns from: the features alone, or with their means one and two steps away.
PROPAGATED = [f"{c}{step}" for step in ("", "_1", "_2") for c in FEATURES]


def model_matrix(spark: SparkSession, sf_dir: str, propagated: bool = False) -> DataFrame:
    """``id, y``, features and the parts of the split, written once: the models pass over it many times.

    ``y`` is an index in the top tenth; the parts of the index (shares of single bids and of modalities) are no features.
    """
    from caudal.plans.facts import feature_frame
    from caudal.session import Stages

    f = feature_frame(spark, sf_dir)
    raw = {"log_valor": F.log10(F.greatest("v", F.lit(0.0)) + 1), "log_n": F.log10(F.col("n") + 1), "reparto": F.col("e") / F.col("n"), "adicion": F.col("adicion"), "anios": F.col("anios"), "grado": F.coalesce("grado", F.lit(0)), "fuerza": F.coalesce("fuerza", F.lit(0.0))}
    parts = ["solo", "directa", "minima"]
    m = f.select(F.col("id_nodo").alias("id"), (F.col("r") >= F.col("p90") - 1e-9).cast("int").alias("y"), "cri", *parts, (1 - F.col("e") / F.col("n")).alias("reparto_inverso"), F.least(F.col("n") / 50.0, F.lit(1.0)).alias("recurrencia"), *[c.cast("double").alias(k) for k, c in raw.items()])
    stages = Stages(spark, "models")
    m = stages.cut(m, "features")
    if propagated:
        x = m.select(F.col("id").alias("actor"), *FEATURES)
        near = graph.hops(award_edges(spark, sf_dir).select("entidad", "actor").distinct(), x, FEATURES).drop("vecinos", *FEATURES)
        m = m.join(near.withColumnRenamed("actor", "id"), "id", "left").na.fill(0.0)
    share = m.agg(F.avg("y").alias("__s"))
    m = m.crossJoin(F.broadcast(share)).withColumn("balance", F.when(F.col("y") == 1, 0.5 / F.greatest("__s", F.lit(1e-9))).otherwise(0.5 / F.greatest(1 - F.col("__s"), F.lit(1e-9)))).drop("__s")
    return stages.cut(metrics.split(m, "id", "y"), "matrix")


def fitted(rows: DataFrame, estimator, features: list[str] = FEATURES):
    """The pipeline of scaling and estimator, fitted to the training part."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    steps = [VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), estimator]
    return Pipeline(stages=steps).fit(rows.where("not prueba"))


def scores_of(model, rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows.where("prueba")).select("id", "y", vector_to_array("probability")[1].alias("p"))


def estimators() -> dict:
    """The estimators by name, with the sizes of the comparison."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier

    return {
        "logistica": LogisticRegression(labelCol="y", regParam=0.01, weightCol="balance"),
        "bosque": RandomForestClassifier(labelCol="y", numTrees=100, maxDepth=8, seed=42),
        "refuerzo": GBTClassifier(labelCol="y", maxIter=100, stepSize=0.1, maxDepth=3, seed=42),
        "perceptron": MultilayerPerceptronClassifier(labelCol="y", layers=[len(FEATURES), 128, 64, 2], maxIter=200, seed=42),
        "propagado": MultilayerPerceptronClassifier(labelCol="y", layers=[len(PROPAGATED), 128, 64, 2], maxIter=200, seed=42),
        "bosque_propagado": RandomForestClassifier(labelCol="y", numTrees=100, maxDepth=8, seed=42),
    }


def _model(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    wide = "propagado" in name
    rows = model_matrix(spark, sf_dir, wide)
    return scores_of(fitted(rows, estimators()[name], PROPAGATED if wide else FEATURES), rows)


@query()
def model_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the test part by a logistic regression with balanced classes."""
    return _model(spark, sf_dir, "logistica")


@query()
def model_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the test part by 100 trees of depth 8."""
    return _model(spark, sf_dir, "bosque")


@query()
def model_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the test part by 100 boosted trees of depth 3."""
    return _model(spark, sf_dir, "refuerzo")


@query()
def model_perceptron(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the test part by a perceptron of 128 and 64 units."""
    return _model(spark, sf_dir, "perceptron")


@query()
def model_propagated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the test part by that perceptron over the features and their means one and two steps away."""
    return _model(spark, sf_dir, "propagado")


@query()
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, average precision and precision among the best 200 of the models on the same test part, with and without propagation."""
    from functools import reduce

    out = []
    rows = model_matrix(spark, sf_dir, True)
    for name in ("logistica", "bosque", "perceptron", "propagado", "bosque_propagado"):
        s = scores_of(fitted(rows, estimators()[name], PROPAGATED if "propagado" in name else FEATURES), rows)
        s = s.withColumn("p", F.round("p", 9))
        out.append(metrics.auc_and_precision(s).crossJoin(metrics.top(s, [200]).select(F.col("precision").alias("precision_200"))).withColumn("modelo", F.lit(name)))
    return reduce(DataFrame.unionByName, out)


@query()
def model_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of each feature in the forest."""
    forest = fitted(model_matrix(spark, sf_dir), estimators()["bosque"]).stages[-1]
    return spark.createDataFrame([(c, float(w)) for c, w in zip(FEATURES, forest.featureImportances.toArray())], "rasgo string, peso double")


@query()
def leakage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each part of the index, and of the index, linear and tree models of the features explain on the test part."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import LinearRegression, RandomForestRegressor

    rows, out = model_matrix(spark, sf_dir), []
    for part in ("solo", "directa", "minima", "reparto_inverso", "recurrencia", "cri"):
        for kind, est in (("lineal", LinearRegression(labelCol=part)), ("bosque", RandomForestRegressor(labelCol=part, numTrees=50, maxDepth=8, seed=42))):
            told = fitted(rows, est).transform(rows.where("prueba"))
            out.append((part, kind, float(RegressionEvaluator(labelCol=part, metricName="r2").evaluate(told))))
    return spark.createDataFrame(out, "parte string, modelo string, r2 double")


@query()
def shapley_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact Shapley values of the logistic score for the 100 best of the test part, against 60 rows of the training part.

    All 128 coalitions of the seven features are reckoned, so the values add up to the score less the mean score.
    """
    rows = model_matrix(spark, sf_dir)
    model = fitted(rows, estimators()["logistica"])
    scale, last = model.stages[1], model.stages[2]
    weights = last.coefficients.toArray() / scale.std.toArray().clip(1e-12)
    bias = last.intercept - float((weights * scale.mean.toArray()).sum())
    base = [[r[c] for c in FEATURES] for r in rows.where("not prueba").orderBy(F.md5("id"), "id").limit(60).select(*FEATURES).collect()]
    best = scores_of(model, rows).orderBy(F.desc("p"), "id").limit(100).select("id")
    return metrics.coalition_shapley(rows.join(F.broadcast(best), "id"), "id", FEATURES, list(map(float, weights)), bias, base)
