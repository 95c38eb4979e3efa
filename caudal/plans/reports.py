"""Report tables and further comparisons of orderings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caudal.functions import casts, text
from caudal.operators import graph, metrics
from caudal.plans import base
from caudal.plans.evaluation import _PRED, REPLICATES, predictions, replicates_sql
from caudal.plans.identity import _INPUT, linkage_input
from caudal.plans.network import _TRI, AWARD_PAIRS, award_pairs, triangles
from caudal.plans.registry import query
from caudal.plans.warehouse import _PAIRED, bidders
from caudal.session import table

#: Families of buyers by name, first match (fixed values).
FAMILIES = [
    (r"\bALCALDIA|\bMUNICIPIO", "alcaldia"), (r"\bGOBERNACION|\bDEPARTAMENTO", "gobernacion"), (r"\bHOSPITAL|\bE\.?S\.?E\b", "salud"), (r"\bUNIVERSIDAD|\bINSTITUCION EDUCATIVA", "educacion"),
    (r"\bSECRETARIA", "secretaria"), (r"\bINSTITUTO", "instituto"), (r"\bEMPRESA", "empresa"), (r"\bCONCEJO|\bPERSONERIA|\bCONTRALORIA", "control"),
]


@query(
    f"WITH x AS (SELECT translate(upper(nombre_entidad), '{text.ACCENTED}', '{text.PLAIN}') AS n FROM {base.BUYERS}) SELECT CASE "
    + " ".join(f"WHEN regexp_matches(n, '{p}') THEN '{l}'" for p, l in FAMILIES) + " ELSE 'otra' END AS familia, count(*) AS entidades FROM x GROUP BY 1"
)
def buyer_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = text.unaccented(F.upper("nombre_entidad"))
    return base.buyers(spark, sf_dir).groupBy(F.coalesce(text.first_rule(n, FAMILIES), F.lit("otra")).alias("familia")).agg(F.count(F.lit(1)).alias("entidades"))


@query(f"WITH {_PRED} SELECT id, n, p FROM pred WHERE n >= 5 ORDER BY p DESC, id LIMIT 8")
def top_cri(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight suppliers of highest index among those of five contracts and more."""
    return predictions(spark, sf_dir).where("n >= 5").orderBy(F.desc("p"), "id").limit(8).select("id", "n", "p")


@query(f"WITH {_PAIRED}, k AS (SELECT p FROM b GROUP BY p HAVING count(*) BETWEEN 2 AND 100) SELECT x.s AS a, y.s AS b, count(*) AS procesos FROM b x JOIN k USING (p) JOIN b y ON x.p = y.p AND x.s < y.s GROUP BY 1, 2 ORDER BY procesos DESC, a, b LIMIT 9")
def top_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine pairs of suppliers that meet most often."""
    b = bidders(spark, sf_dir)
    few = b.join(b.groupBy("p").agg(F.count(F.lit(1)).alias("k")).where("k between 2 and 100").select("p"), "p", "left_semi")
    pairs = few.withColumnRenamed("s", "a").join(few.withColumnRenamed("s", "b"), "p").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("procesos"))
    return pairs.orderBy(F.desc("procesos"), "a", "b").limit(9)


@query(f"WITH {_TRI} SELECT entidad, count(*) AS triangulos, count(DISTINCT ut) AS uts FROM tri GROUP BY 1 ORDER BY triangulos DESC, entidad LIMIT 6")
def top_triangle_buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triangles(spark, sf_dir).groupBy("entidad").agg(F.count(F.lit(1)).alias("triangulos"), F.count_distinct("ut").alias("uts"))
    return t.orderBy(F.desc("triangulos"), "entidad").limit(6)


@query("WITH i AS " + _INPUT + " SELECT id_nodo, nombre, left(nombre, 10) AS bloque FROM i WHERE tipo_nodo <> 'union_temporal' AND nombre IS NOT NULL AND (doc IS NULL OR length(doc) <> 9)")
def linkage_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actors that only a probabilistic match can place: no document, or one of unusual length."""
    i = linkage_input(spark, sf_dir).where((F.col("tipo_nodo") != "union_temporal") & F.col("nombre").isNotNull() & (F.col("doc").isNull() | (F.length("doc") != 9)))
    return i.select("id_nodo", "nombre", F.left("nombre", F.lit(10)).alias("bloque"))


@query(
    f"""WITH {_PRED}, o AS (SELECT 1), r AS (SELECT *, ntile(10) OVER (ORDER BY p DESC, md5(id), id) AS decil FROM pred) SELECT CAST(decil AS INTEGER) AS decil, count(*) AS actores, CAST(sum(y) AS BIGINT) AS positivos, round(avg(p) + 1e-7, 4) AS media FROM r GROUP BY 1""".replace(", o AS (SELECT 1)", "")
)
def score_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenths of the ordering."""
    placed = metrics.places(predictions(spark, sf_dir))
    size, extra = F.expr("todas div 10"), F.col("todas") % 10
    long = (size + 1) * extra
    decile = F.when(F.col("i") <= long, F.expr("(i - 1) div (todas div 10 + 1)")).otherwise(extra + F.floor((F.col("i") - 1 - long) / F.greatest(size, F.lit(1))))
    return placed.groupBy((decile + 1).cast("int").alias("decil")).agg(F.count(F.lit(1)).alias("actores"), F.sum("y").cast("long").alias("positivos"), casts.displayed(F.avg("p")).alias("media"))


@query(
    f"""WITH {replicates_sql({'p': 'p', 'q': 'CAST(n AS DOUBLE) / (n + 50)'})}
    SELECT round(avg(x.auc - z.auc) + 1e-7, 4) AS diferencia, round(quantile_cont(x.auc - z.auc, .025) + 1e-7, 4) AS bajo, round(quantile_cont(x.auc - z.auc, .975) + 1e-7, 4) AS alto FROM a x JOIN a z ON x.r = z.r AND x.m = 'p' AND z.m = 'q'"""
)
def paired_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of AUC of two orderings over replicates that share their weights, with its 95 % interval."""
    d = predictions(spark, sf_dir)
    q = F.col("n").cast("double") / (F.col("n") + 50)
    one, two = metrics.bootstrap(d, REPLICATES), metrics.bootstrap(d.select("id", "y", q.alias("p")), REPLICATES)
    a = one.withColumnRenamed("auc", "x").join(two.withColumnRenamed("auc", "z"), "r")
    diff = F.col("x") - F.col("z")
    at = lambda v: casts.displayed(F.percentile(diff, F.lit(v)))
    return a.agg(casts.displayed(F.avg(diff)).alias("diferencia"), at(0.025).alias("bajo"), at(0.975).alias("alto"))


@query(
    f"""WITH p AS {AWARD_PAIRS}, d AS (SELECT CASE WHEN id LIKE 'ENT:%' THEN 'comprador' ELSE 'actor' END AS clase, id, count(*) AS g FROM (SELECT a AS id FROM p UNION ALL SELECT b FROM p) GROUP BY id)
    SELECT clase, count(*) AS nodos, quantile_cont(g, 0.5) AS mediana, quantile_cont(g, 0.9) AS p90, max(g) AS maximo FROM d GROUP BY clase"""
)
def degree_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = graph.degrees(award_pairs(spark, sf_dir)).withColumn("clase", F.when(F.col("id").startswith("ENT:"), "comprador").otherwise("actor"))
    return d.groupBy("clase").agg(F.count(F.lit(1)).alias("nodos"), F.percentile("grado", F.lit(0.5)).alias("mediana"), F.percentile("grado", F.lit(0.9)).alias("p90"), F.max("grado").alias("maximo"))


@query("SELECT n_name AS nacion, r_name AS region, count(*) AS clientes, round(avg(c_acctbal) + 1e-7, 4) AS saldo FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def customers_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star join: two fixed small tables next to a large one, aggregated before the names are joined."""
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("clientes"), casts.displayed(F.avg("c_acctbal")).alias("saldo"))
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("nacion"), F.col("r_name").alias("region"), "clientes", "saldo")


@query(
    """WITH e AS (SELECT DISTINCT l_suppkey AS s, o_custkey AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT s AS proveedor, count(*) AS clientes FROM e GROUP BY 1"""
)
def supplier_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct customers of each supplier over the orders star."""
    l, o = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return l.join(o, l["l_orderkey"] == o["o_orderkey"]).groupBy(F.col("l_suppkey").alias("proveedor")).agg(F.count_distinct("o_custkey").alias("clientes"))
