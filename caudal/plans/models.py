"""Model selection and explanation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caudal.functions.casts import displayed
from caudal.operators import metrics
from caudal.plans.evaluation import _CRI, _PRED, FEATURES, model_matrix, predictions
from caudal.plans.registry import query
from caudal.plans.warehouse import cri

@query()
def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean area under the curve of each grid point (penalty by balance of classes) over the three folds, the same for every point."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    lr = LogisticRegression(labelCol="y", maxIter=50)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.001, 0.01, 0.1, 1.0]).addGrid(lr.weightCol, ["uno", "balance"]).build()
    rows = model_matrix(spark, sf_dir).where("not prueba").withColumn("uno", F.lit(1.0))
    steps = [VectorAssembler(inputCols=FEATURES, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), lr]
    cv = CrossValidator(estimator=Pipeline(stages=steps), estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol="y"), numFolds=3, foldCol="pliegue", parallelism=4)
    found = cv.fit(rows).avgMetrics
    return spark.createDataFrame([(float(g[lr.regParam]), g[lr.weightCol] == "balance", float(a)) for g, a in zip(grid, found)], "regularizacion double, equilibrada boolean, auc double")


#: Weights of the index by component (fixed values).
WEIGHTS = {"solo": 0.3, "directa": 0.2, "reparto_inverso": 0.2, "recurrencia": 0.15, "minima": 0.15}


def components_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cri(spark, sf_dir)
    return c.select("codigo_proveedor", "cri", "solo", "directa", "minima", (1 - F.col("e").cast("double") / F.col("n")).alias("reparto_inverso"), F.least(F.col("n") / 50.0, F.lit(1.0)).alias("recurrencia"))


_COMPONENTS = f"""{_CRI}, m AS (SELECT codigo_proveedor, solo, directa, minima, 1 - CAST(e AS DOUBLE) / n AS reparto_inverso, least(n / 50.0::DOUBLE, 1.0::DOUBLE) AS recurrencia FROM k)"""


@query(
    f"WITH {_COMPONENTS}, a AS (" + " UNION ALL ".join(f"SELECT codigo_proveedor, '{c}' AS rasgo, {w}::DOUBLE * ({c} - avg({c}) OVER ()) AS aporte FROM m" for c, w in WEIGHTS.items())
    + ") SELECT codigo_proveedor, rasgo, round(aporte + 1e-7, 4) AS aporte FROM a"
)
def index_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each component adds to a supplier's index, against the mean supplier."""
    a = metrics.linear_shapley(components_of(spark, sf_dir), "codigo_proveedor", WEIGHTS)
    return a.select("codigo_proveedor", "rasgo", displayed(F.col("aporte")).alias("aporte"))


@query(
    f"WITH {_COMPONENTS}, a AS (" + " UNION ALL ".join(f"SELECT codigo_proveedor, '{c}' AS rasgo, abs(round({w}::DOUBLE * ({c} - avg({c}) OVER ()), 9)) AS aporte FROM m" for c, w in WEIGHTS.items())
    + "), t AS (SELECT rasgo FROM a QUALIFY row_number() OVER (PARTITION BY codigo_proveedor ORDER BY aporte DESC, rasgo) = 1) SELECT rasgo, count(*) AS proveedores FROM t GROUP BY rasgo"
)
def leading_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each component weighs most."""
    a = metrics.linear_shapley(components_of(spark, sf_dir), "codigo_proveedor", WEIGHTS)
    best = a.groupBy("codigo_proveedor").agg(F.min(F.struct((-F.abs(F.round("aporte", 9))).alias("a"), "rasgo")).alias("b"))
    return best.groupBy(F.col("b.rasgo").alias("rasgo")).agg(F.count(F.lit(1)).alias("proveedores"))


@query(
    f"""WITH {_PRED}, c AS (SELECT CAST(count(*) FILTER (WHERE p >= .4 AND n >= 10) AS DOUBLE) AS x, CAST(count(*) FILTER (WHERE p >= .4 AND n < 10) AS DOUBLE) AS y, CAST(count(*) FILTER (WHERE p < .4 AND n >= 10) AS DOUBLE) AS z, CAST(count(*) FILTER (WHERE p < .4 AND n < 10) AS DOUBLE) AS w FROM pred),
    fx AS (SELECT *, x + y + z + w AS n, lgamma(x + y + 1) + lgamma(z + w + 1) + lgamma(x + z + 1) + lgamma(y + w + 1) - lgamma(x + y + z + w + 1) AS top FROM c),
    t AS (SELECT exp(top - lgamma(k + 1) - lgamma(x + y - k + 1) - lgamma(x + z - k + 1) - lgamma(n - x - y - x - z + k + 1)) AS q, exp(top - lgamma(x + 1) - lgamma(y + 1) - lgamma(z + 1) - lgamma(w + 1)) AS here
      FROM fx, range(CAST((SELECT greatest(0, x + y + x + z - n) FROM fx) AS BIGINT), CAST((SELECT least(x + y, x + z) + 1 FROM fx) AS BIGINT)) r(k))
    SELECT round(x / (x + y + z) + 1e-7, 4) AS jaccard, round(x * w / nullif(y * z, 0) + 1e-7, 4) AS razon, round(n * pow(greatest(abs(x * w - y * z) - n / 2, 0), 2) / ((x + y) * (z + w) * (x + z) * (y + w)) + 1e-7, 3) AS chi2,
    round((SELECT least(1, sum(q)) FROM t WHERE q <= here * (1 + 1e-7)) + 1e-7, 4) AS p FROM fx"""
)
def exact_overlap_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard, odds ratio, chi-square and Fisher's exact probability of the overlap of high index and many contracts."""
    t = metrics.overlap(F.col("p") >= 0.4, F.col("n") >= 10, predictions(spark, sf_dir)).first()
    p = metrics.fisher(t["ambos"], t["solo_a"], t["solo_b"], t["ninguno"])
    out = spark.createDataFrame([(t["jaccard"], t["razon"], t["chi2"], p)], "jaccard double, razon double, chi2 double, p double")
    return out.select(displayed(F.col("jaccard")).alias("jaccard"), displayed(F.col("razon")).alias("razon"), displayed(F.col("chi2"), 3).alias("chi2"), displayed(F.col("p")).alias("p"))


@query(
    f"WITH {_PRED}, t AS (SELECT id, y, p, row_number() OVER (ORDER BY p DESC, md5('7|' || id), id) AS i FROM pred) SELECT id, y, p FROM t WHERE i <= 25"
)
def top_seeded_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 highest scores with ties in a seeded order."""
    d = predictions(spark, sf_dir).withColumn("h", F.md5(F.concat(F.lit("7|"), "id")))
    return d.orderBy(F.desc("p"), "h", "id").limit(25).select("id", "y", "p")


@query(
    f"WITH {_PRED}, t AS (SELECT id, row_number() OVER (ORDER BY p DESC, md5(id), id) AS i, count(*) OVER () AS n FROM pred) SELECT id, i <= round(n * 0.1) AS etiqueta FROM t"
)
def top_decile_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label for exactly a tenth of the suppliers."""
    placed = metrics.places(predictions(spark, sf_dir))
    return placed.select("id", (F.col("i") <= F.round(F.col("todas") * 0.1)).alias("etiqueta"))
