"""Identity of suppliers, buyers and actors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caudal.functions import casts, digest, similarity, text
from caudal.operators import graph, linkage
from caudal.plans import base
from caudal.plans.registry import query
from caudal.plans.warehouse import SQL_CANON, SQL_DIGITS, SQL_DOCUMENT, SQL_NORM
from caudal.session import table

_DOCS = f"(SELECT codigo_proveedor, {SQL_DOCUMENT('nit_proveedor')} AS doc, {SQL_CANON('nombre_proveedor')} AS nombre FROM {base.SUPPLIERS})"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.suppliers(spark, sf_dir).select("codigo_proveedor", text.valid_document("nit_proveedor").alias("doc"), text.canonical_name("nombre_proveedor").alias("nombre"))


@query(
    f"""WITH d AS {_DOCS}, r AS (SELECT DISTINCT {SQL_DOCUMENT('documento')} AS doc FROM {base.ACTORS}), n AS (SELECT DISTINCT doc, nombre FROM d WHERE doc IS NOT NULL)
    SELECT codigo_proveedor, d.doc, CASE WHEN d.doc IS NULL THEN NULL WHEN r.doc IS NOT NULL OR n.doc IS NOT NULL THEN substr(d.doc, 1, length(d.doc) - 1) ELSE d.doc END AS resuelto,
    CASE WHEN d.doc IS NULL THEN 'sin documento' WHEN r.doc IS NOT NULL THEN 'registro' WHEN n.doc IS NOT NULL THEN 'nombre' ELSE 'igual' END AS metodo
    FROM d LEFT JOIN r ON r.doc = substr(d.doc, 1, length(d.doc) - 1) LEFT JOIN n ON n.doc = substr(d.doc, 1, length(d.doc) - 1) AND n.nombre = d.nombre"""
)
def dv_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without their check digit, where the registry or a namesake confirms the shorter one."""
    d = documents(spark, sf_dir).withColumn("corto", text.without_check_digit("doc"))
    r = base.actors(spark, sf_dir).select(text.valid_document("documento").alias("corto")).where("corto is not null").distinct().withColumn("r", F.lit(True))
    n = documents(spark, sf_dir).where("doc is not null").select(F.col("doc").alias("corto"), "nombre").distinct().withColumn("n", F.lit(True))
    out = d.join(r, "corto", "left").join(n, ["corto", "nombre"], "left")
    how = F.when(F.col("doc").isNull(), "sin documento").when(F.col("r"), "registro").when(F.col("n"), "nombre").otherwise("igual")
    return out.select("codigo_proveedor", "doc", F.when(F.col("r") | F.col("n"), F.col("corto")).otherwise(F.col("doc")).alias("resuelto"), how.alias("metodo"))


@query(
    f"""SELECT doc, id_nodo, tipo_nodo FROM (SELECT {SQL_DOCUMENT('documento')} AS doc, id_nodo, tipo_nodo, fecha_matricula FROM {base.ACTORS}) WHERE doc IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY doc ORDER BY CASE tipo_nodo WHEN 'persona_juridica' THEN 0 WHEN 'union_temporal' THEN 1 ELSE 2 END, fecha_matricula DESC NULLS LAST, id_nodo) = 1"""
)
def registry_best_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best registry row of each document: kind, then latest registration, then id."""
    a = base.actors(spark, sf_dir).select(text.valid_document("documento").alias("doc"), "id_nodo", "tipo_nodo", "fecha_matricula").where("doc is not null")
    kind = F.when(F.col("tipo_nodo") == "persona_juridica", 0).when(F.col("tipo_nodo") == "union_temporal", 1).otherwise(2)
    w = Window.partitionBy("doc").orderBy(kind, F.col("fecha_matricula").desc_nulls_last(), "id_nodo")
    return a.withColumn("i", F.row_number().over(w)).where("i = 1").select("doc", "id_nodo", "tipo_nodo")


@query(
    f"""WITH k AS (SELECT codigo_proveedor, count(*) AS n, count(DISTINCT codigo_entidad) AS e, CAST(sum(valor_del_contrato) AS DOUBLE) AS v, bool_or(es_grupo) AS g FROM {base.CONTRACTS} WHERE codigo_proveedor IS NOT NULL GROUP BY 1)
    SELECT a.id_nodo, max(a.nombre) AS nombre, CAST(coalesce(sum(n), 0) AS BIGINT) AS contratos, CAST(coalesce(sum(e), 0) AS BIGINT) AS entidades, coalesce(sum(v), 0) AS valor, coalesce(bool_or(g), false) AS grupo,
    max(year(DATE '2026-01-01') - year(a.fecha_matricula)) AS antiguedad FROM {base.ACTORS} a LEFT JOIN k USING (codigo_proveedor) GROUP BY 1"""
)
def actor_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts aggregated first, then actors over their accounts."""
    k = base.contracts(spark, sf_dir).where("codigo_proveedor is not null").groupBy("codigo_proveedor").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("codigo_entidad").alias("e"), F.sum("valor_del_contrato").cast("double").alias("v"), F.bool_or("es_grupo").alias("g")
    )
    a = base.actors(spark, sf_dir).join(k, "codigo_proveedor", "left").groupBy("id_nodo")
    return a.agg(
        F.max("nombre").alias("nombre"), F.coalesce(F.sum("n"), F.lit(0)).alias("contratos"), F.coalesce(F.sum("e"), F.lit(0)).alias("entidades"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("valor"),
        F.coalesce(F.bool_or("g"), F.lit(False)).alias("grupo"), F.max(F.lit(2026) - F.year("fecha_matricula")).alias("antiguedad"),
    )


@query(
    f"""WITH e AS (SELECT codigo_entidad, {SQL_DIGITS('nit_entidad')} AS nit, {SQL_NORM('nombre_entidad')} AS nombre, coalesce(n_contratos_hist, 0) AS n, coalesce(n_procesos_hist, 0) AS p FROM {base.BUYERS}),
    b AS (SELECT x.codigo_entidad, y.codigo_entidad AS base FROM e x JOIN e y ON y.codigo_entidad = regexp_extract(upper(x.codigo_entidad), '^(.*)_DUP[0-9]*$', 1)),
    s AS (SELECT codigo_entidad, first_value(codigo_entidad) OVER (PARTITION BY nit, nombre ORDER BY n DESC, p DESC, codigo_entidad) AS jefe FROM e WHERE nit IS NOT NULL AND nombre IS NOT NULL)
    SELECT e.codigo_entidad, coalesce(b.base, s.jefe, e.codigo_entidad) AS codigo_resuelto, CASE WHEN b.base IS NOT NULL THEN 'sufijo' WHEN s.jefe <> e.codigo_entidad THEN 'nit y nombre' ELSE 'propio' END AS regla
    FROM e LEFT JOIN b USING (codigo_entidad) LEFT JOIN s USING (codigo_entidad)"""
)
def entity_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buyer codes led back to one: copy suffix with its base present, then same NIT and name, most active first."""
    e = base.buyers(spark, sf_dir).select(
        "codigo_entidad", text.digits("nit_entidad").alias("nit"), text.normalised("nombre_entidad").alias("nombre"), F.coalesce("n_contratos_hist", F.lit(0)).alias("n"), F.coalesce("n_procesos_hist", F.lit(0)).alias("p")
    )
    root = F.regexp_extract(F.upper("codigo_entidad"), "^(.*)_DUP[0-9]*$", 1)
    have = e.select(F.col("codigo_entidad").alias("base"))
    b = e.select("codigo_entidad", root.alias("base")).where("base <> ''").join(have, "base")
    w = Window.partitionBy("nit", "nombre").orderBy(F.desc("n"), F.desc("p"), "codigo_entidad")
    s = e.where("nit is not null and nombre is not null").select("codigo_entidad", F.first("codigo_entidad").over(w).alias("jefe"))
    out = e.select("codigo_entidad").join(b, "codigo_entidad", "left").join(s, "codigo_entidad", "left")
    rule = F.when(F.col("base").isNotNull(), "sufijo").when(F.col("jefe") != F.col("codigo_entidad"), "nit y nombre").otherwise("propio")
    return out.select("codigo_entidad", F.coalesce("base", "jefe", "codigo_entidad").alias("codigo_resuelto"), rule.alias("regla"))


@query("WITH x AS (" + f"SELECT {SQL_DIGITS('nit_entidad')} AS nit, codigo_entidad, {SQL_NORM('nombre_entidad')} AS nombre FROM {base.BUYERS}" + ") SELECT nit, count(*) AS codigos, count(DISTINCT nombre) AS nombres, array_to_string(list_slice(list_sort(list(DISTINCT codigo_entidad)), 1, 3), ',') AS muestra FROM x WHERE nit IS NOT NULL GROUP BY nit HAVING count(*) > 1")
def consolidation_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NITs of several codes, with the number of names and three of the codes."""
    x = base.buyers(spark, sf_dir).select(text.digits("nit_entidad").alias("nit"), "codigo_entidad", text.normalised("nombre_entidad").alias("nombre")).where("nit is not null")
    w = Window.partitionBy("nit").orderBy("codigo_entidad")
    first = x.withColumn("i", F.row_number().over(w)).where("i <= 3").groupBy("nit").agg(F.array_sort(F.collect_list("codigo_entidad")).alias("m"))
    many = x.groupBy("nit").agg(F.count(F.lit(1)).alias("codigos"), F.count_distinct("nombre").alias("nombres")).where("codigos > 1")
    return many.join(first, "nit").select("nit", "codigos", "nombres", F.array_join("m", ",").alias("muestra"))


@query(
    f"""WITH c AS (SELECT DISTINCT fuente, codigo, doc FROM (SELECT 'proveedores' AS fuente, codigo_proveedor AS codigo, {SQL_DOCUMENT('nit_proveedor')} AS doc FROM {base.SUPPLIERS} UNION ALL SELECT 'nodos', codigo_proveedor, {SQL_DOCUMENT('documento')} FROM {base.ACTORS}) WHERE doc IS NOT NULL AND codigo IS NOT NULL)
    SELECT 'documentos por codigo' AS medida, n, count(*) AS casos FROM (SELECT codigo, count(DISTINCT doc) AS n FROM c GROUP BY 1) GROUP BY n UNION ALL
    SELECT 'codigos por documento', n, count(*) FROM (SELECT doc, count(DISTINCT codigo) AS n FROM c GROUP BY 1) GROUP BY n UNION ALL SELECT 'longitud', length(doc), count(DISTINCT doc) FROM c GROUP BY 2"""
)
def identity_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents a code has, codes a document, and how long documents are."""
    s = base.suppliers(spark, sf_dir).select(F.col("codigo_proveedor").alias("codigo"), text.valid_document("nit_proveedor").alias("doc"))
    a = base.actors(spark, sf_dir).select(F.col("codigo_proveedor").alias("codigo"), text.valid_document("documento").alias("doc"))
    c = s.unionByName(a).na.drop().distinct()

    def sizes(by: str, label: str) -> DataFrame:
        return c.groupBy(by).agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("casos")).select(F.lit(label).alias("medida"), "n", "casos")

    length = c.select("doc").distinct().groupBy(F.length("doc").cast("long").alias("n")).agg(F.count(F.lit(1)).alias("casos"))
    return sizes("codigo", "documentos por codigo").unionByName(sizes("doc", "codigos por documento")).unionByName(length.select(F.lit("longitud").alias("medida"), "n", "casos"))


def linkage_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = base.actors(spark, sf_dir)
    return a.select(
        "id_nodo", "tipo_nodo", text.valid_document("documento").alias("doc"), text.canonical_name("nombre").alias("nombre"), text.valid_document("doc_rep_legal").alias("rep"),
        F.lower(text.cleaned("correo")).alias("correo"), text.digits("telefono").alias("telefono"),
    )


_INPUT = f"""(SELECT id_nodo, tipo_nodo, {SQL_DOCUMENT('documento')} AS doc, {SQL_CANON('nombre')} AS nombre, {SQL_DOCUMENT('doc_rep_legal')} AS rep,
    lower(CASE WHEN trim(correo) <> '' AND upper(trim(correo)) NOT IN ({', '.join(f"'{s}'" for s in text.SENTINELS)}) THEN trim(correo) END) AS correo, {SQL_DIGITS('telefono')} AS telefono FROM {base.ACTORS})"""
_RULES_SQL = {"nombre": "nombre || '|' || tipo_nodo", "representante": "rep || '|' || left(nombre, 4)", "correo": "correo", "telefono": "telefono", "documento": "substr(doc, 1, length(doc) - 1)"}


def rules() -> dict:
    join = lambda *c: F.concat(c[0], F.lit("|"), c[1])
    return {
        "nombre": join(F.col("nombre"), F.col("tipo_nodo")), "representante": join(F.col("rep"), F.left("nombre", F.lit(4))), "correo": F.col("correo"), "telefono": F.col("telefono"),
        "documento": text.without_check_digit("doc"),
    }


@query(
    "WITH i AS " + _INPUT + ", k AS (" + " UNION ALL ".join(f"SELECT '{n}' AS regla, {e} AS clave FROM i" for n, e in _RULES_SQL.items())
    + ") SELECT regla, count(*) AS bloques, max(n) AS mayor, CAST(sum(n * (n - 1) / 2) AS BIGINT) AS pares FROM (SELECT regla, clave, count(*) AS n FROM k WHERE clave IS NOT NULL GROUP BY ALL HAVING count(*) > 1) GROUP BY regla"
)
def blocking_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.blocking_sizes(linkage_input(spark, sf_dir), rules())


_BLOCKED = "i AS MATERIALIZED " + _INPUT + ", p AS (" + " UNION ".join(f"SELECT x.id_nodo AS l, y.id_nodo AS r FROM i x JOIN i y ON x.id_nodo < y.id_nodo AND {e.replace('nombre', 'x.nombre').replace('tipo_nodo', 'x.tipo_nodo').replace('rep ', 'x.rep ').replace('correo', 'x.correo').replace('telefono', 'x.telefono').replace('doc', 'x.doc')} = {e.replace('nombre', 'y.nombre').replace('tipo_nodo', 'y.tipo_nodo').replace('rep ', 'y.rep ').replace('correo', 'y.correo').replace('telefono', 'y.telefono').replace('doc', 'y.doc')}" for e in _RULES_SQL.values()) + ")"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = linkage_input(spark, sf_dir)
    return linkage.blocked_pairs(i, "id_nodo", rules(), ["nombre", "doc", "rep", "correo", "telefono"])


@query(f"WITH {_BLOCKED} SELECT l, r FROM p")
def blocked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of actors that agree on any blocking rule, once each."""
    return pairs(spark, sf_dir).select("l", "r")


@query(f"WITH {_BLOCKED} SELECT p.l, p.r, levenshtein(x.nombre, y.nombre) AS distancia, CASE WHEN levenshtein(x.nombre, y.nombre) <= 1 THEN 2 WHEN levenshtein(x.nombre, y.nombre) <= 2 THEN 1 ELSE 0 END AS nivel FROM p JOIN i x ON x.id_nodo = l JOIN i y ON y.id_nodo = r WHERE x.nombre IS NOT NULL AND y.nombre IS NOT NULL")
def levenshtein_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.levenshtein("nombre_l", "nombre_r")
    p = pairs(spark, sf_dir).where("nombre_l is not null and nombre_r is not null")
    return p.select("l", "r", d.alias("distancia"), F.when(d <= 1, 2).when(d <= 2, 1).otherwise(0).alias("nivel"))


@query(f"WITH {_BLOCKED}, s AS (SELECT p.l, p.r, jaro_winkler_similarity(x.nombre, y.nombre) AS s FROM p JOIN i x ON x.id_nodo = l JOIN i y ON y.id_nodo = r WHERE x.nombre IS NOT NULL AND y.nombre IS NOT NULL) SELECT l, r, round(s + 1e-7, 4) AS parecido, CASE WHEN s >= .95 THEN 3 WHEN s >= .88 THEN 2 WHEN s >= .8 THEN 1 ELSE 0 END AS nivel FROM s")
def jaro_winkler_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir).where("nombre_l is not null and nombre_r is not null")
    s = p.select("l", "r", similarity.jaro_winkler(F.col("nombre_l"), F.col("nombre_r")).alias("s"))
    return s.select("l", "r", casts.displayed(F.col("s")).alias("parecido"), similarity.level(F.col("s"), [0.95, 0.88, 0.8]).alias("nivel"))


COMPARISONS = [
    linkage.Comparison("nombre", "nombre", (linkage.exact, linkage.within(1), linkage.within(2))),
    linkage.Comparison("doc", "doc", (linkage.exact, linkage.within(1))),
    linkage.Comparison("rep", "rep", (linkage.exact,)),
    linkage.Comparison("correo", "correo", (linkage.exact,)),
    linkage.Comparison("telefono", "telefono", (linkage.exact,)),
]
M = {"nombre": [0.1, 0.1, 0.1, 0.7], "doc": [0.3, 0.2, 0.5], "rep": [0.4, 0.6], "correo": [0.5, 0.5], "telefono": [0.5, 0.5]}
U = {"nombre": [0.997, 0.001, 0.001, 0.001], "doc": [0.998, 0.001, 0.001], "rep": [0.99, 0.01], "correo": [0.99, 0.01], "telefono": [0.99, 0.01]}
SHARE = 0.001


def _weights_sql() -> str:
    import math

    level = {
        "nombre": "CASE WHEN x.nombre IS NULL OR y.nombre IS NULL THEN -1 WHEN x.nombre = y.nombre THEN 3 WHEN levenshtein(x.nombre, y.nombre) <= 1 THEN 2 WHEN levenshtein(x.nombre, y.nombre) <= 2 THEN 1 ELSE 0 END",
        "doc": "CASE WHEN x.doc IS NULL OR y.doc IS NULL THEN -1 WHEN x.doc = y.doc THEN 2 WHEN levenshtein(x.doc, y.doc) <= 1 THEN 1 ELSE 0 END",
    } | {c: f"CASE WHEN x.{c} IS NULL OR y.{c} IS NULL THEN -1 WHEN x.{c} = y.{c} THEN 1 ELSE 0 END" for c in ("rep", "correo", "telefono")}
    bits = " + ".join(f"CASE {level[k]} " + " ".join(f"WHEN {g} THEN {math.log2(M[k][g] / U[k][g])}::DOUBLE" for g in range(len(M[k]))) + " ELSE 0 END" for k in M)
    return f"WITH {_BLOCKED}, s AS (SELECT p.l, p.r, {math.log2(SHARE / (1 - SHARE))}::DOUBLE + {bits} AS w FROM p JOIN i x ON x.id_nodo = l JOIN i y ON y.id_nodo = r) SELECT l, r, round(w + 1e-7, 4) AS peso, round(1 / (1 + pow(2.0::DOUBLE, -w)) + 1e-7, 4) AS probabilidad FROM s"


@query(_weights_sql())
def fs_match_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match weights of blocked pairs under given parameters."""
    w = linkage.weigh(pairs(spark, sf_dir), COMPARISONS, SHARE, M, U)
    return w.select("l", "r", casts.displayed(F.col("peso")).alias("peso"), casts.displayed(F.col("probabilidad")).alias("probabilidad"))


@query()
def fs_trained_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match weights under parameters learnt from the comparison vectors of the blocked pairs."""
    p = pairs(spark, sf_dir)
    counts = [r.asDict() for r in linkage.patterns(p, COMPARISONS).collect()]
    share, m = linkage.train(counts, COMPARISONS, U)
    return linkage.weigh(p, COMPARISONS, min(max(share, 1e-6), 1 - 1e-6), m, U).select("l", "r", "peso", "probabilidad")


@query(
    f"WITH i AS MATERIALIZED {_INPUT} SELECT count(*) AS pares, (SELECT count(doc) * (count(doc) - 1) / 2 FROM (SELECT doc FROM i WHERE doc IS NOT NULL)) AS posibles FROM i a JOIN i b ON b.doc = substr(a.doc, 1, length(a.doc) - 1)"
)
def exact_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that differ by a check digit, against all pairs; counted, not sampled."""
    d = linkage_input(spark, sf_dir).where("doc is not null").select("doc")
    n = d.groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    short = d.groupBy(text.without_check_digit("doc").alias("doc")).agg(F.count(F.lit(1)).alias("k"))
    hit = n.join(short, "doc").agg(F.coalesce(F.sum(F.col("n") * F.col("k")), F.lit(0)).alias("pares"))
    every = d.agg((F.count(F.lit(1)) * (F.count(F.lit(1)) - 1) / 2).alias("posibles"))
    return hit.crossJoin(every)


_SCORED = """(SELECT upper(trim(unique_id_l)) AS l, upper(trim(unique_id_r)) AS r, max(match_probability) AS p, max(nullif(regexp_replace(id_l, '[^0-9]', '', 'g'), '')) AS dl, max(nullif(regexp_replace(id_r, '[^0-9]', '', 'g'), '')) AS dr
    FROM pares WHERE unique_id_l IS NOT NULL AND unique_id_r IS NOT NULL AND upper(trim(unique_id_l)) <> upper(trim(unique_id_r)) AND match_probability IS NOT NULL AND NOT isnan(match_probability) GROUP BY 1, 2)"""
_DECISION = "CASE WHEN dl IS NOT NULL AND dr IS NOT NULL AND dl <> dr AND NOT (dl LIKE dr || '_' OR dr LIKE dl || '_') THEN 'grupo empresarial' WHEN p >= .95 THEN 'unir' WHEN p >= .8 THEN 'revisar' ELSE 'separar' END"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pares")
    up = lambda c: F.upper(F.trim(c))
    rows = p.where(F.col("match_probability").isNotNull() & ~F.isnan("match_probability")).select(up("unique_id_l").alias("l"), up("unique_id_r").alias("r"), "match_probability", text.digits("id_l").alias("dl"), text.digits("id_r").alias("dr"))
    return rows.where("l is not null and r is not null and l <> r").groupBy("l", "r").agg(F.max("match_probability").alias("p"), F.max("dl").alias("dl"), F.max("dr").alias("dr"))


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    related = (text.without_check_digit("dl") == F.col("dr")) | (text.without_check_digit("dr") == F.col("dl"))
    apart = F.coalesce((F.col("dl") != F.col("dr")) & ~related, F.lit(False))
    p = F.col("p")
    return scored(spark, sf_dir).withColumn("decision", F.when(apart, "grupo empresarial").when(p >= 0.95, "unir").when(p >= 0.8, "revisar").otherwise("separar"))


@query(f"SELECT l, r, p AS probabilidad, {_DECISION} AS decision FROM {_SCORED}")
def hard_constraint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision on each scored pair; two valid documents that differ are never merged."""
    return decided(spark, sf_dir).select("l", "r", F.col("p").alias("probabilidad"), "decision")


@query(
    f"""WITH RECURSIVE u AS MATERIALIZED (SELECT l AS a, r AS b FROM {_SCORED} WHERE {_DECISION} = 'unir'), s AS MATERIALIZED (SELECT a AS id, b AS other FROM u UNION SELECT b, a FROM u),
    t(id, c) AS (SELECT DISTINCT id, id FROM s UNION SELECT s.other, t.c FROM t JOIN s USING (id) WHERE t.c < s.other), k AS (SELECT id, min(c) AS grupo FROM t GROUP BY id)
    SELECT id, grupo, count(*) OVER (PARTITION BY grupo) AS miembros FROM k"""
)
def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of merged records with their size."""
    u = decided(spark, sf_dir).where("decision = 'unir'")
    c = graph.components(graph.undirected(u, "l", "r")).withColumnRenamed("componente", "grupo")
    return c.join(c.groupBy("grupo").agg(F.count(F.lit(1)).alias("miembros")), "grupo").select("id", "grupo", "miembros")


KEY = digest.key()
PREFIXES = {"persona_juridica": ("P-", 5), "union_temporal": ("UT-", 4), "persona_natural": ("N-", 5)}


@query(
    f"""SELECT id_nodo, CASE tipo_nodo WHEN 'persona_juridica' THEN 'P-' || lpad(CAST(i AS VARCHAR), CAST(greatest(5, length(CAST(i AS VARCHAR))) AS INTEGER), '0') WHEN 'union_temporal' THEN 'UT-' || lpad(CAST(i AS VARCHAR), CAST(greatest(4, length(CAST(i AS VARCHAR))) AS INTEGER), '0')
    WHEN 'persona_natural' THEN 'N-' || lpad(CAST(i AS VARCHAR), CAST(greatest(5, length(CAST(i AS VARCHAR))) AS INTEGER), '0') ELSE 'X-' || lpad(CAST(i AS VARCHAR), CAST(greatest(4, length(CAST(i AS VARCHAR))) AS INTEGER), '0') END AS seudonimo
    FROM (SELECT id_nodo, tipo_nodo, row_number() OVER (PARTITION BY tipo_nodo ORDER BY {digest.sql_hmac('id_nodo', KEY)}, id_nodo) AS i FROM {base.ACTORS})"""
)
def pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running numbers within each kind, in the order of a keyed digest.

    Numbers come from the sizes of ranges of the digest, so no kind is ordered in one task.
    """
    a = base.actors(spark, sf_dir).select("id_nodo", "tipo_nodo", digest.hmac_sha256(F.col("id_nodo"), KEY).alias("h"))
    a = a.withColumn("b", F.left("h", F.lit(2)))
    sizes = a.groupBy("tipo_nodo", "b").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("antes", F.sum("n").over(Window.partitionBy("tipo_nodo").orderBy("b")) - F.col("n")).drop("n")
    local = a.withColumn("i", F.row_number().over(Window.partitionBy("tipo_nodo", "b").orderBy("h", "id_nodo")))
    at = local.join(before, local["tipo_nodo"].eqNullSafe(before["tipo_nodo"]) & (local["b"] == before["b"])).select("id_nodo", local["tipo_nodo"], (F.col("i") + F.col("antes")).cast("string").alias("k"))
    out = F.concat(F.lit("X-"), F.lpad("k", F.greatest(F.lit(4), F.length("k")), F.lit("0")))
    for kind, (prefix, width) in PREFIXES.items():
        out = F.when(F.col("tipo_nodo") == kind, F.concat(F.lit(prefix), F.lpad("k", F.greatest(F.lit(width), F.length("k")), F.lit("0")))).otherwise(out)
    return at.select("id_nodo", out.alias("seudonimo"))


@query(
    f"""SELECT tipo, 'A-' || left({digest.sql_hmac('origen', KEY)}, 24) AS origen, 'A-' || left({digest.sql_hmac('destino', KEY)}, 24) AS destino, peso, CASE WHEN tipo NOT IN ('representado_por', 'comparte_contacto') THEN detalle END AS detalle
    FROM vinculo_2025 WHERE origen IS NOT NULL AND destino IS NOT NULL"""
)
def publishable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge list with opaque ends, without details that name people; unknown ends stay out."""
    v = table(spark, sf_dir, "vinculo_2025").where("origen is not null and destino is not null")
    detail = F.when(F.col("tipo").isin("representado_por", "comparte_contacto"), F.lit(None)).otherwise(F.col("detalle"))
    return v.select("tipo", digest.opaque(F.col("origen"), KEY, "A-", 24).alias("origen"), digest.opaque(F.col("destino"), KEY, "A-", 24).alias("destino"), "peso", detail.alias("detalle"))


@query(
    f"""WITH b AS MATERIALIZED {base.BUYERS}, m AS (SELECT codigo_entidad, regexp_extract(upper(codigo_entidad), '^(.*)_DUP[0-9]*$', 1) AS nuevo FROM b), k AS (SELECT m.codigo_entidad, nuevo FROM m JOIN b ON b.codigo_entidad = nuevo)
    SELECT coalesce('ENT:' || o.nuevo, v.origen) AS origen, coalesce('ENT:' || d.nuevo, v.destino) AS destino, tipo, count(*) AS filas, CAST(sum(peso) AS BIGINT) AS peso FROM vinculo_2025 v LEFT JOIN k o ON v.origen = 'ENT:' || o.codigo_entidad LEFT JOIN k d ON v.destino = 'ENT:' || d.codigo_entidad
    WHERE tipo IN ('adjudica', 'se_presenta_a') GROUP BY ALL"""
)
def edge_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of buyers at either end moved to the base code, where one exists, and added up again."""
    b = base.buyers(spark, sf_dir).select("codigo_entidad")
    ent = lambda c: F.concat(F.lit("ENT:"), c)
    copies = b.select("codigo_entidad", F.regexp_extract(F.upper("codigo_entidad"), "^(.*)_DUP[0-9]*$", 1).alias("base")).where("base <> ''")
    known = copies.join(b.select(F.col("codigo_entidad").alias("base")), "base")
    v = table(spark, sf_dir, "vinculo_2025").where(F.col("tipo").isin("adjudica", "se_presenta_a"))
    for end in ("origen", "destino"):
        v = v.join(known.select(ent("codigo_entidad").alias(end), ent("base").alias(f"{end}_nuevo")), end, "left")
    return v.groupBy(F.coalesce("origen_nuevo", "origen").alias("origen"), F.coalesce("destino_nuevo", "destino").alias("destino"), "tipo").agg(F.count(F.lit(1)).alias("filas"), F.sum("peso").alias("peso"))
