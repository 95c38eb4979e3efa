"""Queries of the general data problems: dangling references and heavy keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caudal.operators import references, skew
from caudal.plans.registry import query
from caudal.session import table

#: Referring table: its key, and for each referring column the kind of target.
REFERENCES = {
    "contratos": ("id_contrato", {"id_portafolio": "portafolio", "codigo_proveedor": "proveedor", "codigo_entidad": "entidad"}),
    "ofertas": ("id_oferta", {"id_del_proceso": "portafolio", "codigo_proveedor": "proveedor"}),
    "procesos": ("id_del_proceso", {"codigo_proveedor": "proveedor", "codigo_entidad": "entidad"}),
    "nodos": ("id_nodo", {"codigo_proveedor": "proveedor"}),
}
#: Kind of target: its table and key.
TARGETS = {"portafolio": ("procesos", "id_portafolio"), "proveedor": ("proveedores", "codigo_proveedor"), "entidad": ("entidades", "codigo_entidad")}

_KEY = "upper(trim({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(160)))"
_REF = "CASE WHEN regexp_matches({c}, '[0-9]') THEN " + _KEY + " END"


def _references_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    key, columns = REFERENCES[name]
    first = references.first_delivery(table(spark, sf_dir, name), key, "fecha_carga", list(columns))
    each = F.array(
        *[
            F.struct(F.lit(c).alias("campo"), F.lit(kind).alias("destino"), references.levelled_reference(F.col(c)).alias("clave"))
            for c, kind in columns.items()
        ]
    )
    return first.select(F.lit(name).alias("tabla"), F.col(key).alias("id_registro"), "fecha_carga", F.explode(each).alias("r")).select(
        "tabla", "r.campo", "id_registro", "fecha_carga", "r.destino", "r.clave"
    )


def _dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = reduce(DataFrame.unionByName, [_references_of(spark, sf_dir, n) for n in REFERENCES])
    targets = reduce(
        DataFrame.unionByName,
        [
            references.target_state(table(spark, sf_dir, t), [references.levelled_reference(F.col(k))], "fecha_carga", "fecha_baja", ["clave"])
            .where("clave is not null")
            .withColumn("destino", F.lit(kind))
            for kind, (t, k) in TARGETS.items()
        ],
    )
    return references.dangling(refs, ["clave"], targets, ["clave"], "simple", ["destino"], "fecha_carga")


def _dangling_sql() -> str:
    refs, targets = [], []
    for name, (key, columns) in REFERENCES.items():
        first = f"(SELECT * FROM {name} WHERE {key} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY fecha_carga NULLS LAST, {', '.join(c + ' NULLS FIRST' for c in columns)}) = 1)"
        for c, kind in columns.items():
            refs.append(f"SELECT '{name}' AS tabla, '{c}' AS campo, {key} AS id_registro, fecha_carga, '{kind}' AS destino, {_REF.format(c=c)} AS clave FROM {first}")
    for kind, (t, k) in TARGETS.items():
        targets.append(f"SELECT '{kind}' AS destino, {_KEY.format(c=k)} AS clave, min(fecha_carga) AS desde, bool_and(fecha_baja IS NOT NULL) AS borrada FROM {t} GROUP BY ALL")
    return f"""WITH refs AS ({' UNION ALL '.join(refs)}), targets AS ({' UNION ALL '.join(targets)}),
    judged AS (SELECT r.*, CASE WHEN t.clave IS NULL THEN 'ausente' WHEN t.borrada THEN 'borrada' WHEN t.desde > r.fecha_carga THEN 'tardia' END AS motivo
    FROM refs r LEFT JOIN targets t USING (destino, clave) WHERE r.clave IS NOT NULL)"""


@query(_dangling_sql() + " SELECT tabla, campo, id_registro, motivo FROM judged WHERE motivo IS NOT NULL")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to records that are absent, deleted or came later."""
    return _dangling(spark, sf_dir).select("tabla", "campo", "id_registro", "motivo")


@query(
    _dangling_sql()
    + " SELECT tabla, campo, motivo, strftime(fecha_carga, '%Y-%m') AS mes, count(*) AS n FROM judged WHERE motivo IS NOT NULL GROUP BY ALL"
)
def p4_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dangling references for each table, column, reason and month of delivery."""
    month = F.date_format("fecha_carga", "yyyy-MM").alias("mes")
    return _dangling(spark, sf_dir).groupBy("tabla", "campo", "motivo", month).agg(F.count(F.lit(1)).alias("n"))


_COMPOSITE_KEYS = ["codigo_entidad", "codigo_proveedor"]


def _composite(spark: SparkSession, sf_dir: str, match: str) -> DataFrame:
    """Awards named by a contract (buyer and supplier together) that no tender knows."""
    level = [references.levelled_reference(F.col(c)).alias(c) for c in _COMPOSITE_KEYS]
    refs = references.first_delivery(table(spark, sf_dir, "contratos"), "id_contrato", "fecha_carga", _COMPOSITE_KEYS)
    refs = refs.select("id_contrato", "fecha_carga", *level)
    keys = [references.levelled_reference(F.col(c)) for c in _COMPOSITE_KEYS]
    targets = references.target_state(table(spark, sf_dir, "procesos"), keys, "fecha_carga", "fecha_baja", _COMPOSITE_KEYS)
    return references.dangling(refs, _COMPOSITE_KEYS, targets, _COMPOSITE_KEYS, match, when="fecha_carga").select("id_contrato", *_COMPOSITE_KEYS, "motivo")


_COMPOSITE_SQL = f"""WITH r AS (SELECT id_contrato, fecha_carga AS f, {_REF.format(c='codigo_entidad')} AS e, {_REF.format(c='codigo_proveedor')} AS p FROM
    (SELECT * FROM contratos WHERE id_contrato IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id_contrato ORDER BY fecha_carga NULLS LAST, codigo_entidad NULLS FIRST, codigo_proveedor NULLS FIRST) = 1)),
    t AS (SELECT {_REF.format(c='codigo_entidad')} AS e, {_REF.format(c='codigo_proveedor')} AS p, bool_and(fecha_baja IS NOT NULL) AS b, min(fecha_carga) AS d FROM procesos GROUP BY ALL),
    te AS (SELECT e, bool_and(b) AS b, min(d) AS d FROM t GROUP BY e), tp AS (SELECT p, bool_and(b) AS b, min(d) AS d FROM t GROUP BY p),
    j AS (SELECT id_contrato, f, r.e AS codigo_entidad, r.p AS codigo_proveedor,
      CASE WHEN r.e IS NOT NULL AND r.p IS NOT NULL THEN 'both' WHEN r.e IS NULL AND r.p IS NULL THEN 'none' ELSE 'part' END AS mask,
      CASE WHEN r.p IS NULL THEN te.b WHEN r.e IS NULL THEN tp.b ELSE t.b END AS b, CASE WHEN r.p IS NULL THEN te.d WHEN r.e IS NULL THEN tp.d ELSE t.d END AS d
      FROM r LEFT JOIN t ON r.e = t.e AND r.p = t.p LEFT JOIN te ON r.e = te.e LEFT JOIN tp ON r.p = tp.p),
    m AS (SELECT *, CASE WHEN b IS NULL THEN 'ausente' WHEN b THEN 'borrada' WHEN d > f THEN 'tardia' END AS motivo FROM j)
    SELECT id_contrato, codigo_entidad, codigo_proveedor, motivo FROM m WHERE """


@query(_COMPOSITE_SQL + "mask = 'both' AND motivo IS NOT NULL")
def p4_composite_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _composite(spark, sf_dir, "simple")


@query(_COMPOSITE_SQL + "mask <> 'none' AND motivo IS NOT NULL")
def p4_composite_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _composite(spark, sf_dir, "partial")


@query(_COMPOSITE_SQL.replace("CASE WHEN b IS NULL", "CASE WHEN b IS NULL OR mask = 'part'") + "mask <> 'none' AND motivo IS NOT NULL")
def p4_composite_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _composite(spark, sf_dir, "full")


_ENDS = "(SELECT 'origen' AS extremo, origen AS clave, peso, valor FROM vinculo_2025 UNION ALL SELECT 'destino', destino, peso, valor FROM vinculo_2025)"


@query(f"SELECT extremo, clave FROM {_ENDS} WHERE clave IS NOT NULL GROUP BY ALL HAVING count(*) >= 0.01 * (SELECT count(*) FROM vinculo_2025)")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys that hold at least one in a hundred of the edges."""
    return skew.heavy_keys(table(spark, sf_dir, "vinculo_2025"), ["origen", "destino"], 0.01).select("extremo", "clave")


@query(
    f"""SELECT extremo, clave, count(*) AS n_filas, CAST(sum(peso) AS BIGINT) AS peso_total, CAST(sum(valor) AS DOUBLE) AS valor_total,
    count(*) >= 0.01 * (SELECT count(*) FROM vinculo_2025) AS pesada FROM {_ENDS} WHERE clave IS NOT NULL GROUP BY ALL"""
)
def p5_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges, weight and value of each key on either side."""
    totals = skew.totals_by_end(table(spark, sf_dir, "vinculo_2025"), ["origen", "destino"], "peso", "valor", 0.01)
    return totals.withColumn("valor_total", F.col("valor_total").cast("double"))


@query(
    """WITH a AS (SELECT DISTINCT origen AS entidad, destino AS actor FROM vinculo_2025 WHERE tipo = 'adjudica' AND origen IS NOT NULL AND destino IS NOT NULL),
    m AS (SELECT DISTINCT origen AS ut, destino AS socio FROM vinculo_2025 WHERE tipo = 'integra' AND origen <> destino),
    t AS (SELECT a.entidad, m.ut, m.socio FROM m JOIN a ON a.actor = m.ut JOIN a d ON d.entidad = a.entidad AND d.actor = m.socio)
    SELECT extremo, clave, count(*) AS n_triangulos FROM (SELECT 'entidad' AS extremo, entidad AS clave FROM t UNION ALL SELECT 'ut', ut FROM t UNION ALL SELECT 'socio', socio FROM t) GROUP BY ALL"""
)
def p5_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk triangles of each buyer, joint venture and member."""
    return skew.triangles_by_key(table(spark, sf_dir, "vinculo_2025"), "tipo", "origen", "destino")
