"""Staging, dimensions, facts and analytic views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caudal.functions import casts, text
from caudal.operators import dedup
from caudal.plans import base
from caudal.plans.registry import query
from caudal.session import table

_UNACCENT = f"translate({{c}}, '{text.ACCENTED}', '{text.PLAIN}')"
_NORM = "nullif(trim(regexp_replace(upper(" + _UNACCENT + "), '\\s+', ' ', 'g')), '')"
_CLEAN = "CASE WHEN trim({c}) <> '' AND upper(trim({c})) NOT IN (" + ", ".join(f"'{s}'" for s in text.SENTINELS) + ") THEN trim({c}) END"
_CANON = (
    "nullif(trim(regexp_replace(regexp_replace(regexp_replace(upper(" + _UNACCENT + "), '[^A-Z0-9 ]', ' ', 'g'), '\\s+("
    + "|".join(text.LEGAL_FORMS) + ")\\s*$', ''), '\\s+', ' ', 'g')), '')"
)
_DIGITS = "nullif(regexp_replace({c}, '[^0-9]', '', 'g'), '')"
_DOCUMENT = (
    "CASE WHEN length(" + _DIGITS + ") >= 6 AND " + _DIGITS + " <> repeat(" + _DIGITS + "[1], CAST(length(" + _DIGITS + ") AS BIGINT)) AND "
    + _DIGITS + " NOT IN (" + ", ".join(f"'{s}'" for s in text.NO_DOCUMENT) + ") THEN " + _DIGITS + " END"
)
_NORM_, _CLEAN_, _CANON_, _DOC_ = (lambda t: lambda c: t.replace("{c}", c))(_NORM), (lambda t: lambda c: t.replace("{c}", c))(_CLEAN), (lambda t: lambda c: t.replace("{c}", c))(_CANON), (lambda t: lambda c: t.replace("{c}", c))(_DOCUMENT)
SQL_NORM, SQL_CLEAN, SQL_CANON, SQL_DOCUMENT = _NORM_, _CLEAN_, _CANON_, _DOC_
SQL_DIGITS = lambda c: _DIGITS.replace("{c}", c)


@query(
    """SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey, l_partkey, l_quantity, l_extendedprice) = 1"""
)
def dedup_business_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["l_suppkey", "l_partkey", "l_quantity", "l_extendedprice"]
    return dedup.smallest_per_key(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], columns)


@query(
    """SELECT codigo_proveedor, codigo_entidad, id_del_proceso FROM procesos
    QUALIFY row_number() OVER (PARTITION BY codigo_proveedor, codigo_entidad ORDER BY fecha_carga DESC NULLS LAST, id_del_proceso) = 1"""
)
def dedup_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest tender of each supplier and buyer, null keys being one key."""
    df = table(spark, sf_dir, "procesos").select("codigo_proveedor", "codigo_entidad", "id_del_proceso", "fecha_carga")
    order = [F.col("fecha_carga").desc_nulls_last(), F.col("id_del_proceso")]
    return dedup.one_per_key(df, ["codigo_proveedor", "codigo_entidad"], order).drop("fecha_carga")


@query("SELECT id_contrato, count(*) AS n FROM contratos GROUP BY ALL HAVING count(*) > 1")
def repeated_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.repeated_keys(table(spark, sf_dir, "contratos"), ["id_contrato"])


@query(f"SELECT {_CLEAN_('tipo_empresa')} AS tipo_empresa, {_CLEAN_('departamento')} AS departamento, count(*) AS n FROM proveedores GROUP BY ALL")
def sentinel_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "proveedores")
    return df.groupBy(text.cleaned("tipo_empresa").alias("tipo_empresa"), text.cleaned("departamento").alias("departamento")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT id_contrato, strftime(fecha_firma, '%Y-%m-%d') AS firma, CAST(valor_del_contrato AS DECIMAL(24,2)) AS valor, dias_adicionados AS dias, es_grupo AS grupo,
    CASE WHEN regexp_matches(id_portafolio, '^[0-9]+$') THEN CAST(id_portafolio AS BIGINT) END AS numero FROM contratos"""
)
def try_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values written as text and read back through the tolerant casts."""
    c = table(spark, sf_dir, "contratos")
    written = c.select(
        "id_contrato", F.concat(F.col("fecha_firma").cast("string"), F.lit("T00:00:00.000")).alias("f"), F.concat(F.lit("$ "), F.format_number("valor_del_contrato", 2)).alias("v"),
        F.concat(F.lit(" "), F.col("dias_adicionados").cast("string"), F.lit(".0")).alias("d"), F.when(F.col("es_grupo"), "Si").when(~F.col("es_grupo"), "Falso").alias("g"), "id_portafolio",
    )
    return written.select(
        "id_contrato", casts.to_date(F.col("f")).cast("string").alias("firma"), casts.to_decimal(F.regexp_replace("v", " ", "")).alias("valor"), casts.to_long(F.col("d")).alias("dias"),
        casts.to_boolean(F.col("g")).alias("grupo"), F.when(F.col("id_portafolio").rlike("^[0-9]+$"), F.col("id_portafolio")).try_cast("long").alias("numero"),
    )


@query(f"SELECT codigo_proveedor, {_CANON_('nombre_proveedor')} AS canonico, {_NORM_('nombre_proveedor')} AS normal FROM {base.SUPPLIERS}")
def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = base.suppliers(spark, sf_dir)
    return s.select("codigo_proveedor", text.canonical_name("nombre_proveedor").alias("canonico"), text.normalised("nombre_proveedor").alias("normal"))


@query(f"SELECT id_nodo, {_DOC_('documento')} AS documento, {_DOC_('doc_rep_legal')} AS doc_rep_legal FROM {base.ACTORS}")
def doc_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = base.actors(spark, sf_dir)
    return a.select("id_nodo", text.valid_document("documento").alias("documento"), text.valid_document("doc_rep_legal").alias("doc_rep_legal"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("long").alias("k")
    return table(spark, sf_dir, "events").groupBy("event_type", k).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""SELECT id_contrato, year(fecha_firma) AS anio, quarter(fecha_firma) AS trimestre, month(fecha_firma) AS mes, week(fecha_firma) AS semana,
    dayofweek(fecha_firma) AS dia_semana, dayname(fecha_firma) AS nombre_dia, monthname(fecha_firma) AS nombre_mes,
    date_diff('day', fecha_inicio, fecha_fin) AS dias, date_diff('year', fecha_inicio, fecha_fin) AS anios, strftime(date_trunc('month', fecha_firma), '%Y-%m-%d') AS desde
    FROM {base.CONTRACTS}"""
)
def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("fecha_firma")
    return base.contracts(spark, sf_dir).select(
        "id_contrato", F.year(f).alias("anio"), F.quarter(f).alias("trimestre"), F.month(f).alias("mes"), F.weekofyear(f).alias("semana"),
        (F.dayofweek(f) - 1).alias("dia_semana"), F.date_format(f, "EEEE").alias("nombre_dia"), F.date_format(f, "MMMM").alias("nombre_mes"),
        F.datediff("fecha_fin", "fecha_inicio").alias("dias"), (F.year("fecha_fin") - F.year("fecha_inicio")).alias("anios"),
        F.date_format(F.trunc(f, "month"), "yyyy-MM-dd").alias("desde"),
    )


@query(
    """SELECT strftime(d, '%Y-%m-%d') AS fecha, CAST(strftime(d, '%Y%m%d') AS INTEGER) AS id_fecha, year(d) AS anio, quarter(d) AS trimestre, month(d) AS mes, strftime(d, '%Y-%m') AS anio_mes,
    monthname(d) AS nombre_mes, day(d) AS dia, dayofweek(d) AS dia_semana, dayname(d) AS nombre_dia_semana, week(d) AS semana_iso, dayofweek(d) IN (0, 6) AS es_fin_de_semana
    FROM range((SELECT CAST(min(fecha_firma) AS TIMESTAMP) FROM contratos), (SELECT CAST(max(fecha_fin) AS TIMESTAMP) + INTERVAL 1 DAY FROM contratos), INTERVAL 1 DAY) t(d)"""
)
def calendar_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = table(spark, sf_dir, "contratos").agg(F.min("fecha_firma").alias("a"), F.max("fecha_fin").alias("b"))
    d = F.col("fecha")
    days = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("fecha"))
    return days.select(
        F.date_format(d, "yyyy-MM-dd").alias("fecha"), F.date_format(d, "yyyyMMdd").cast("int").alias("id_fecha"), F.year(d).alias("anio"), F.quarter(d).alias("trimestre"), F.month(d).alias("mes"),
        F.date_format(d, "yyyy-MM").alias("anio_mes"), F.date_format(d, "MMMM").alias("nombre_mes"), F.dayofmonth(d).alias("dia"), (F.dayofweek(d) - 1).alias("dia_semana"),
        F.date_format(d, "EEEE").alias("nombre_dia_semana"), F.weekofyear(d).alias("semana_iso"), F.dayofweek(d).isin(1, 7).alias("es_fin_de_semana"),
    )


_DEPARTMENTS = ["entidades", "proveedores", "nodos"]
#: Departments whose name is shown in one form, first match (fixed values).
DISPLAYED = [("BOGOT", "Bogotá D.C."), ("SAN ANDRES", "San Andrés y Providencia"), ("VALLE", "Valle del Cauca"), ("NORTE DE SANT", "Norte de Santander")]


@query(
    "SELECT departamento_norm, CASE " + " ".join(f"WHEN departamento_norm LIKE '%{p}%' THEN '{n}'" for p, n in DISPLAYED) + " ELSE array_to_string(list_transform(string_split(lower(departamento_norm), ' '), lambda x: upper(x[1]) || substr(x, 2)), ' ') END AS departamento, departamento_norm LIKE '%BOGOTA%' AS es_capital, count(*) AS n_tablas FROM (SELECT DISTINCT t, n AS departamento_norm FROM ("
    + " UNION ALL ".join(f"SELECT '{t}' AS t, {_NORM_('departamento')} AS n FROM {t}" for t in _DEPARTMENTS)
    + ") WHERE n IS NOT NULL) GROUP BY ALL"
)
def department_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = [table(spark, sf_dir, t).select(F.lit(t).alias("t"), text.normalised("departamento").alias("departamento_norm")) for t in _DEPARTMENTS]
    named = reduce(DataFrame.unionByName, each).where("departamento_norm is not null").distinct()
    out = named.groupBy("departamento_norm").agg(F.count(F.lit(1)).alias("n_tablas"))
    shown = text.first_rule(F.col("departamento_norm"), DISPLAYED, None)
    return out.withColumns({"departamento": F.coalesce(shown, text.title_case("departamento_norm")), "es_capital": F.col("departamento_norm").contains("BOGOTA")})


@query(
    f"""WITH c AS (SELECT codigo_entidad, count(*) AS n_contratos, CAST(sum(valor_del_contrato) AS DOUBLE) AS valor FROM {base.CONTRACTS} WHERE codigo_entidad IS NOT NULL GROUP BY 1),
    p AS (SELECT codigo_entidad, count(*) AS n_procesos FROM {base.TENDERS} WHERE codigo_entidad IS NOT NULL GROUP BY 1),
    e AS (SELECT upper(trim(codigo_entidad)) AS codigo_entidad, min(nombre_entidad) AS nombre, min({_CLEAN_('departamento')}) AS departamento FROM entidades GROUP BY 1),
    k AS (SELECT codigo_entidad FROM c UNION SELECT codigo_entidad FROM p UNION SELECT codigo_entidad FROM e)
    SELECT codigo_entidad, coalesce(nombre, 'SIN REGISTRO') AS nombre, departamento, coalesce(n_contratos, 0) AS n_contratos, coalesce(n_procesos, 0) AS n_procesos, coalesce(valor, 0) AS valor
    FROM k LEFT JOIN c USING (codigo_entidad) LEFT JOIN p USING (codigo_entidad) LEFT JOIN e USING (codigo_entidad)"""
)
def entity_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every buyer of any table, with what each table knows."""
    c = base.contracts(spark, sf_dir).where("codigo_entidad is not null").groupBy("codigo_entidad").agg(F.count(F.lit(1)).alias("n_contratos"), F.sum("valor_del_contrato").cast("double").alias("valor"))
    p = base.tenders(spark, sf_dir).where("codigo_entidad is not null").groupBy("codigo_entidad").agg(F.count(F.lit(1)).alias("n_procesos"))
    e = table(spark, sf_dir, "entidades").groupBy(F.upper(F.trim("codigo_entidad")).alias("codigo_entidad")).agg(F.min("nombre_entidad").alias("nombre"), F.min(text.cleaned("departamento")).alias("departamento"))
    out = c.join(p, "codigo_entidad", "full_outer").join(e, "codigo_entidad", "full_outer")
    return out.select(
        "codigo_entidad", F.coalesce("nombre", F.lit("SIN REGISTRO")).alias("nombre"), "departamento", F.coalesce("n_contratos", F.lit(0)).alias("n_contratos"),
        F.coalesce("n_procesos", F.lit(0)).alias("n_procesos"), F.coalesce("valor", F.lit(0.0)).alias("valor"),
    )


@query(
    """SELECT p_type AS tipo, left(p_type, 2) AS nivel2, left(p_type, 4) AS nivel4, left(p_brand, 6) AS marca, count(*) AS n, count(DISTINCT p_size) AS tallas FROM part GROUP BY ALL"""
)
def category_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("p_type")
    by = [t.alias("tipo"), F.left(t, F.lit(2)).alias("nivel2"), F.left(t, F.lit(4)).alias("nivel4"), F.left("p_brand", F.lit(6)).alias("marca")]
    return table(spark, sf_dir, "part").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_size").alias("tallas"))


#: Groups of contract modalities, first match (fixed values).
MODALITIES = [("DIRECTA", "Directa"), ("MINIMA CUANT", "Minima cuantia"), ("LICITACION", "Licitacion"), ("ABREVIADA", "Abreviada"), ("CONCURSO DE MERITOS", "Concurso"), ("REGIMEN ESPECIAL", "Especial")]
_MODALITY = lambda c: "CASE " + " ".join(f"WHEN {_NORM_(c)} LIKE '%{p}%' THEN '{l}'" for p, l in MODALITIES) + f" WHEN {_NORM_(c)} IS NOT NULL THEN 'Otra' END"


def modality(c: str | Column) -> Column:
    n = text.normalised(c)
    return F.when(n.isNotNull(), text.first_rule(n, MODALITIES, "Otra"))


@query(
    f"""SELECT modalidad, grupo, grupo IN ('Licitacion', 'Abreviada') AS competitiva, grupo = 'Directa' AS directa, grupo = 'Minima cuantia' AS minima, count(*) AS n FROM (SELECT {_NORM_('modalidad_de_contratacion')} AS modalidad, {_MODALITY('modalidad_de_contratacion')} AS grupo FROM procesos) WHERE modalidad IS NOT NULL GROUP BY ALL"""
)
def modality_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "procesos").select(text.normalised("modalidad_de_contratacion").alias("modalidad"), modality("modalidad_de_contratacion").alias("grupo")).where("modalidad is not null")
    return m.groupBy("modalidad", "grupo").agg(F.count(F.lit(1)).alias("n")).withColumns({"competitiva": F.col("grupo").isin("Licitacion", "Abreviada"), "directa": F.col("grupo") == "Directa", "minima": F.col("grupo") == "Minima cuantia"})


@query(
    f"""SELECT id_contrato, codigo_entidad, codigo_proveedor, CAST(strftime(fecha_firma, '%Y%m%d') AS INTEGER) AS id_fecha_firma, {_MODALITY('modalidad_de_contratacion')} AS modalidad,
    CAST(valor_del_contrato AS DOUBLE) AS valor, valor_del_contrato > 1e12 AS es_extremo, coalesce(dias_adicionados, 0) > 0 AS tiene_adiciones, date_diff('day', fecha_inicio, fecha_fin) AS plazo FROM {base.CONTRACTS}"""
)
def fact_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.contracts(spark, sf_dir).select(
        "id_contrato", "codigo_entidad", "codigo_proveedor", F.date_format("fecha_firma", "yyyyMMdd").cast("int").alias("id_fecha_firma"), modality("modalidad_de_contratacion").alias("modalidad"),
        F.col("valor_del_contrato").cast("double").alias("valor"), (F.col("valor_del_contrato").cast("double") > 1e12).alias("es_extremo"),
        (F.coalesce("dias_adicionados", F.lit(0)) > 0).alias("tiene_adiciones"), F.datediff("fecha_fin", "fecha_inicio").alias("plazo"),
    )


_COMPETITION = f"""o AS (SELECT id_del_proceso AS id_portafolio, count(DISTINCT codigo_proveedor) AS reales, CAST(min(valor_oferta) AS DOUBLE) AS menor, CAST(max(valor_oferta) AS DOUBLE) AS mayor,
    round(avg(CAST(valor_oferta AS DOUBLE)) + 1e-7, 4) AS media, round(stddev_samp(CAST(valor_oferta AS DOUBLE)) / nullif(avg(CAST(valor_oferta AS DOUBLE)), 0) + 1e-7, 4) AS cv FROM {base.BIDS} WHERE id_del_proceso IS NOT NULL GROUP BY 1),
    p AS (SELECT id_portafolio, max(proveedores_unicos_respuesta) AS declarados FROM {base.TENDERS} WHERE id_portafolio IS NOT NULL GROUP BY 1)"""


@query(
    f"""WITH {_COMPETITION} SELECT id_portafolio, coalesce(declarados, 0) AS declarados, coalesce(reales, 0) AS reales, menor, mayor, media, cv,
    greatest(coalesce(reales, 0), coalesce(declarados, 0)) <= 1 AS oferente_unico FROM p LEFT JOIN o USING (id_portafolio)"""
)
def competition_per_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bidders and bids of each tender; each side is aggregated before the join, so nothing fans out."""
    v = F.col("valor_oferta").cast("double")
    o = base.bids(spark, sf_dir).where("id_del_proceso is not null").groupBy(F.col("id_del_proceso").alias("id_portafolio")).agg(
        F.count_distinct("codigo_proveedor").alias("reales"), F.min("valor_oferta").cast("double").alias("menor"), F.max("valor_oferta").cast("double").alias("mayor"),
        casts.displayed(F.avg(v)).alias("media"), casts.displayed(F.try_divide(F.stddev_samp(v), F.avg(v))).alias("cv"),
    )
    p = base.tenders(spark, sf_dir).where("id_portafolio is not null").groupBy("id_portafolio").agg(F.max("proveedores_unicos_respuesta").alias("declarados"))
    real, said = F.coalesce("reales", F.lit(0)), F.coalesce("declarados", F.lit(0))
    return p.join(o, "id_portafolio", "left").select("id_portafolio", said.alias("declarados"), real.alias("reales"), "menor", "mayor", "media", "cv", (F.greatest(real, said) <= 1).alias("oferente_unico"))


_CRI = f"""{_COMPETITION}, u AS (SELECT id_portafolio, greatest(coalesce(reales, 0), coalesce(declarados, 0)) <= 1 AS unico FROM p LEFT JOIN o USING (id_portafolio)),
    k AS (SELECT c.codigo_proveedor, count(*) AS n, count(DISTINCT c.codigo_entidad) AS e, avg(CASE WHEN coalesce(unico, true) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS solo,
    avg(CASE WHEN {_MODALITY('c.modalidad_de_contratacion')} = 'Directa' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS directa,
    avg(CASE WHEN {_MODALITY('c.modalidad_de_contratacion')} = 'Minima cuantia' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS minima
    FROM {base.CONTRACTS} c LEFT JOIN u USING (id_portafolio) WHERE c.codigo_proveedor IS NOT NULL GROUP BY 1),
    s AS (SELECT codigo_proveedor, n, e, .3 * solo + .2 * directa + .2 * (1 - CAST(e AS DOUBLE) / n) + .15 * least(n / 50.0::DOUBLE, 1.0::DOUBLE) + .15 * minima AS cri FROM k)"""


def cri(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = competition_per_process(spark, sf_dir).select("id_portafolio", "oferente_unico")
    m = modality("modalidad_de_contratacion")
    flag = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    c = base.contracts(spark, sf_dir).where("codigo_proveedor is not null").select("codigo_proveedor", "codigo_entidad", "id_portafolio", m.alias("m"))
    k = c.join(one, "id_portafolio", "left").groupBy("codigo_proveedor").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("codigo_entidad").alias("e"), flag(F.coalesce("oferente_unico", F.lit(True))).alias("solo"),
        flag(F.col("m") == "Directa").alias("directa"), flag(F.col("m") == "Minima cuantia").alias("minima"),
    )
    score = 0.3 * F.col("solo") + 0.2 * F.col("directa") + 0.2 * (1 - F.col("e").cast("double") / F.col("n")) + 0.15 * F.least(F.col("n") / 50.0, F.lit(1.0)) + 0.15 * F.col("minima")
    return k.select("codigo_proveedor", "n", "e", score.alias("cri"), "solo", "directa", "minima")


@query(
    f"""WITH {_CRI} SELECT codigo_proveedor, n AS n_contratos, e AS n_entidades, round(cri + 1e-7, 4) AS cri,
    cri >= (SELECT quantile_cont(cri, 0.9) FROM s) - 1e-9 AS riesgo_alto FROM s"""
)
def cri_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corruption-risk index of each supplier and whether it lies in the top tenth."""
    s = cri(spark, sf_dir)
    limit = s.agg(F.percentile("cri", F.lit(0.9)).alias("p90"))
    out = s.crossJoin(F.broadcast(limit))
    return out.select("codigo_proveedor", F.col("n").alias("n_contratos"), F.col("e").alias("n_entidades"), casts.displayed(F.col("cri")).alias("cri"), (F.col("cri") >= F.col("p90") - 1e-9).alias("riesgo_alto"))


@query(
    f"""SELECT codigo_entidad, codigo_proveedor, count(*) AS n, CAST(sum(valor_del_contrato) AS DOUBLE) AS valor, year(min(fecha_firma)) AS desde, year(max(fecha_firma)) AS hasta
    FROM {base.CONTRACTS} WHERE codigo_entidad IS NOT NULL AND codigo_proveedor IS NOT NULL GROUP BY 1, 2"""
)
def bipartite_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = base.contracts(spark, sf_dir).where("codigo_entidad is not null and codigo_proveedor is not null")
    return c.groupBy("codigo_entidad", "codigo_proveedor").agg(
        F.count(F.lit(1)).alias("n"), F.sum("valor_del_contrato").cast("double").alias("valor"), F.year(F.min("fecha_firma")).alias("desde"), F.year(F.max("fecha_firma")).alias("hasta")
    )


_PAIRED = f"b AS (SELECT DISTINCT id_del_proceso AS p, codigo_proveedor AS s FROM {base.BIDS} WHERE id_del_proceso IS NOT NULL AND codigo_proveedor IS NOT NULL)"


def bidders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.bids(spark, sf_dir).where("id_del_proceso is not null and codigo_proveedor is not null").select(F.col("id_del_proceso").alias("p"), F.col("codigo_proveedor").alias("s")).distinct()


@query(f"WITH {_PAIRED}, k AS (SELECT p FROM b GROUP BY p HAVING count(*) BETWEEN 2 AND 100) SELECT x.s AS a, y.s AS b, count(*) AS procesos FROM b x JOIN k USING (p) JOIN b y ON x.p = y.p AND x.s < y.s GROUP BY 1, 2")
def co_bidding_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that bid for the same tenders of 2 to 100 bidders; larger tenders are left out by definition."""
    b = bidders(spark, sf_dir)
    fit = b.groupBy("p").agg(F.count(F.lit(1)).alias("k")).where("k between 2 and 100").select("p")
    few = b.join(fit, "p", "left_semi")
    pairs = few.withColumnRenamed("s", "a").join(few.withColumnRenamed("s", "b"), "p").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("procesos"))


@query(f"WITH {_PAIRED} SELECT k AS oferentes, count(*) AS procesos FROM (SELECT p, CASE WHEN count(*) <= 1 THEN '1' WHEN count(*) <= 5 THEN '2-5' WHEN count(*) <= 20 THEN '6-20' WHEN count(*) <= 100 THEN '21-100' ELSE '>100' END AS k FROM b GROUP BY p) GROUP BY 1")
def bidder_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = bidders(spark, sf_dir).groupBy("p").agg(F.count(F.lit(1)).alias("k"))
    return n.groupBy(text.bucketed("k", [0, 1, 5, 20, 100]).alias("oferentes")).agg(F.count(F.lit(1)).alias("procesos"))


_CONTACTS = " UNION ALL ".join(f"SELECT '{c}' AS canal, {_NORM_(c)} AS valor, codigo_proveedor FROM {base.SUPPLIERS}" for c in ("correo", "telefono"))


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = base.suppliers(spark, sf_dir).select("codigo_proveedor", text.normalised("correo").alias("correo"), text.normalised("telefono").alias("telefono"))
    return s.unpivot("codigo_proveedor", ["correo", "telefono"], "canal", "valor").where("valor is not null").distinct()


@query(
    f"""SELECT canal, valor, count(DISTINCT codigo_proveedor) AS proveedores, array_to_string(list_slice(list_sort(list(DISTINCT codigo_proveedor)), 1, 3), ',') AS muestra
    FROM ({_CONTACTS}) WHERE valor IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT codigo_proveedor) > 1"""
)
def shared_contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact values of several suppliers with the first three of them; the limit is applied before the shuffle."""
    k = contacts(spark, sf_dir)
    w = Window.partitionBy("canal", "valor").orderBy("codigo_proveedor")
    first = k.withColumn("i", F.row_number().over(w)).where("i <= 3").groupBy("canal", "valor").agg(F.array_sort(F.collect_list("codigo_proveedor")).alias("m"))
    many = k.groupBy("canal", "valor").agg(F.count(F.lit(1)).alias("proveedores")).where("proveedores > 1")
    return many.join(first, ["canal", "valor"]).select("canal", "valor", "proveedores", F.array_join("m", ",").alias("muestra"))


@query(
    f"""WITH k AS (SELECT DISTINCT canal, valor, codigo_proveedor FROM ({_CONTACTS}) WHERE valor IS NOT NULL), f AS (SELECT canal, valor FROM k GROUP BY ALL HAVING count(*) BETWEEN 2 AND 20)
    SELECT a.codigo_proveedor AS a, b.codigo_proveedor AS b, count(*) AS valores, string_agg(DISTINCT a.canal, ',' ORDER BY a.canal) AS canales
    FROM k a JOIN f USING (canal, valor) JOIN k b ON a.canal = b.canal AND a.valor = b.valor AND a.codigo_proveedor < b.codigo_proveedor GROUP BY 1, 2"""
)
def shared_contact_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = contacts(spark, sf_dir)
    fit = k.groupBy("canal", "valor").agg(F.count(F.lit(1)).alias("n")).where("n between 2 and 20").drop("n")
    few = k.join(fit, ["canal", "valor"], "left_semi")
    pairs = few.withColumnRenamed("codigo_proveedor", "a").join(few.withColumnRenamed("codigo_proveedor", "b"), ["canal", "valor"]).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("valores"), F.array_join(F.array_sort(F.collect_set("canal")), ",").alias("canales"))
