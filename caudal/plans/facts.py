"""Fact tables, conformed dimensions, the seven kinds of edges, and the nodes of buyers and representatives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caudal.functions import casts, text
from caudal.operators import graph
from caudal.plans import base
from caudal.plans.network import _SIDES, AWARD_PAIRS, award_pairs, components_sql, labelled_components
from caudal.plans.registry import query
from caudal.plans.warehouse import _CRI, _MODALITY, SQL_CLEAN, SQL_DIGITS, SQL_DOCUMENT, SQL_NORM, cri, modality
from caudal.session import table

TENDER = [*base.TENDER, "fase", "url_proceso", "fecha_baja"]
BID = [*base.BID, "moneda", "invitacion_directa"]
CONTRACT = [*base.CONTRACT, "es_pyme", "liquidacion"]
SUPPLIER = [*base.SUPPLIER, "es_pyme", "fecha_baja"]
BUYER = [*base.BUYER, "esta_activa", "fecha_actualizacion", "fecha_baja"]
_TENDERS, _BIDS, _CONTRACTS = base._sql("procesos", "id_del_proceso", TENDER), base._sql("ofertas", "id_oferta", BID), base._sql("contratos", "id_contrato", CONTRACT)
_SUPPLIERS, _BUYERS = base._sql("proveedores", "codigo_proveedor", SUPPLIER), base._sql("entidades", "codigo_entidad", BUYER)
#: Value above which a contract or tender counts as a typing error (fixed value).
EXTREME = 1e12
day_id = lambda c: F.date_format(c, "yyyyMMdd").cast("int")
_DAY = lambda c: f"CAST(strftime({c}, '%Y%m%d') AS INTEGER)"
amount = lambda c: F.col(c).cast("double")


@query(
    f"""SELECT id_del_proceso, id_portafolio, codigo_entidad, codigo_proveedor, {_DAY('fecha_publicacion')} AS id_fecha_publicacion, {_MODALITY('modalidad_de_contratacion')} AS modalidad, {SQL_CLEAN('fase')} AS fase,
    CAST(precio_base AS DOUBLE) AS precio_base, coalesce(CAST(precio_base AS DOUBLE) > 1e12, false) AS es_extremo, coalesce(CAST(precio_base AS DOUBLE), 0) <= 0 AS sin_precio, coalesce(proveedores_unicos_respuesta, 0) AS declarados,
    coalesce(adjudicado, false) AS adjudicado, coalesce(adjudicado, false) AND codigo_proveedor IS NULL AS adjudicado_sin_proveedor, fecha_baja IS NOT NULL AS dado_de_baja, url_proceso IS NOT NULL AS con_url, fecha_carga < CAST(fecha_publicacion AS TIMESTAMP) AS publicado_tarde FROM {_TENDERS}"""
)
def fact_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a tender."""
    price, awarded = amount("precio_base"), F.coalesce("adjudicado", F.lit(False))
    return base._frame(spark, sf_dir, "procesos", "id_del_proceso", TENDER).select(
        "id_del_proceso", "id_portafolio", "codigo_entidad", "codigo_proveedor", day_id("fecha_publicacion").alias("id_fecha_publicacion"), modality("modalidad_de_contratacion").alias("modalidad"), text.cleaned("fase").alias("fase"),
        price.alias("precio_base"), F.coalesce(price > EXTREME, F.lit(False)).alias("es_extremo"), (F.coalesce(price, F.lit(0.0)) <= 0).alias("sin_precio"), F.coalesce("proveedores_unicos_respuesta", F.lit(0)).alias("declarados"),
        awarded.alias("adjudicado"), (awarded & F.col("codigo_proveedor").isNull()).alias("adjudicado_sin_proveedor"), F.col("fecha_baja").isNotNull().alias("dado_de_baja"), F.col("url_proceso").isNotNull().alias("con_url"),
        (F.col("fecha_carga") < F.col("fecha_publicacion").cast("timestamp")).alias("publicado_tarde"),
    )


@query(
    f"""WITH p AS (SELECT id_portafolio, min(codigo_entidad) AS codigo_entidad, CAST(max(precio_base) AS DOUBLE) AS base FROM {_TENDERS} WHERE id_portafolio IS NOT NULL GROUP BY 1)
    SELECT id_oferta, o.id_del_proceso AS id_portafolio, o.codigo_proveedor, codigo_entidad, {_DAY('fecha_registro')} AS id_fecha_registro, CAST(valor_oferta AS DOUBLE) AS valor, {SQL_NORM('moneda')} AS moneda,
    coalesce(invitacion_directa, false) AS invitacion_directa, p.id_portafolio IS NOT NULL AS con_proceso, round(CAST(valor_oferta AS DOUBLE) / nullif(base, 0) + 1e-7, 4) AS razon_base FROM {_BIDS} o LEFT JOIN p ON p.id_portafolio = o.id_del_proceso"""
)
def fact_bid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a bid, with the buyer and base price of its tender; tenders are one row a key before the join."""
    p = base._frame(spark, sf_dir, "procesos", "id_del_proceso", TENDER).where("id_portafolio is not null").groupBy("id_portafolio").agg(F.min("codigo_entidad").alias("codigo_entidad"), F.max("precio_base").cast("double").alias("base"))
    o = base._frame(spark, sf_dir, "ofertas", "id_oferta", BID).withColumnRenamed("id_del_proceso", "id_portafolio")
    both = o.join(p.withColumn("con", F.lit(True)), "id_portafolio", "left")
    return both.select(
        "id_oferta", "id_portafolio", "codigo_proveedor", "codigo_entidad", day_id("fecha_registro").alias("id_fecha_registro"), amount("valor_oferta").alias("valor"), text.normalised("moneda").alias("moneda"),
        F.coalesce("invitacion_directa", F.lit(False)).alias("invitacion_directa"), F.col("con").isNotNull().alias("con_proceso"), casts.displayed(F.try_divide(amount("valor_oferta"), F.nullif("base", F.lit(0.0)))).alias("razon_base"),
    )


@query(
    f"""WITH o AS (SELECT id_del_proceso AS id_portafolio, codigo_proveedor, count(*) AS ofertas, CAST(min(valor_oferta) AS DOUBLE) AS menor, {_DAY('min(fecha_registro)')} AS primera FROM {_BIDS} WHERE id_del_proceso IS NOT NULL AND codigo_proveedor IS NOT NULL GROUP BY 1, 2),
    a AS (SELECT DISTINCT id_portafolio, codigo_proveedor FROM {_TENDERS} WHERE adjudicado AND id_portafolio IS NOT NULL AND codigo_proveedor IS NOT NULL)
    SELECT id_portafolio, codigo_proveedor, coalesce(ofertas, 0) AS ofertas, menor, primera, a.id_portafolio IS NOT NULL AS gana, ofertas IS NULL AS gana_sin_oferta FROM o FULL JOIN a USING (id_portafolio, codigo_proveedor)"""
)
def fact_bidder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a supplier and tender, from bids and awards."""
    keys = ["id_portafolio", "codigo_proveedor"]
    o = base._frame(spark, sf_dir, "ofertas", "id_oferta", BID).withColumnRenamed("id_del_proceso", "id_portafolio").na.drop(subset=keys)
    o = o.groupBy(*keys).agg(F.count(F.lit(1)).alias("ofertas"), F.min("valor_oferta").cast("double").alias("menor"), day_id(F.min("fecha_registro")).alias("primera"))
    a = base._frame(spark, sf_dir, "procesos", "id_del_proceso", TENDER).where("adjudicado").select(*keys).na.drop().distinct().withColumn("gana", F.lit(True))
    out = o.join(a, keys, "full_outer")
    return out.select(*keys, F.coalesce("ofertas", F.lit(0)).alias("ofertas"), "menor", "primera", F.coalesce("gana", F.lit(False)).alias("gana"), F.col("ofertas").isNull().alias("gana_sin_oferta"))


@query(
    f"""SELECT id_contrato, id_portafolio, codigo_entidad, codigo_proveedor, {_DAY('fecha_firma')} AS id_firma, {_DAY('fecha_inicio')} AS id_inicio, {_DAY('fecha_fin')} AS id_fin, {SQL_NORM('tipo_de_contrato')} AS tipo, {_MODALITY('modalidad_de_contratacion')} AS modalidad,
    CAST(valor_del_contrato AS DOUBLE) AS valor, round(log10(greatest(CAST(valor_del_contrato AS DOUBLE), 0) + 1) + 1e-7, 4) AS log_valor, coalesce(CAST(valor_del_contrato AS DOUBLE) > 1e12, false) AS es_extremo, coalesce(CAST(valor_del_contrato AS DOUBLE), 0) <= 0 AS sin_valor, coalesce(dias_adicionados, 0) AS dias_adicionados,
    coalesce(dias_adicionados, 0) > 0 AS tiene_adiciones, date_diff('day', fecha_inicio, fecha_fin) AS plazo, round(coalesce(dias_adicionados, 0) / nullif(CAST(date_diff('day', fecha_inicio, fecha_fin) AS DOUBLE), 0) + 1e-7, 4) AS razon_adicion, coalesce(fecha_inicio < fecha_firma, false) AS empieza_antes,
    es_grupo, es_pyme, liquidacion, year(fecha_firma) AS anio, month(fecha_firma) = 12 AS firmado_en_diciembre, id_portafolio IS NULL AS sin_proceso FROM {_CONTRACTS}"""
)
def fact_contract_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a contract, with keys of dates and dimensions, measures and flags."""
    v, more, term = amount("valor_del_contrato"), F.coalesce("dias_adicionados", F.lit(0)), F.datediff("fecha_fin", "fecha_inicio")
    no = F.lit(False)
    return base._frame(spark, sf_dir, "contratos", "id_contrato", CONTRACT).select(
        "id_contrato", "id_portafolio", "codigo_entidad", "codigo_proveedor", day_id("fecha_firma").alias("id_firma"), day_id("fecha_inicio").alias("id_inicio"), day_id("fecha_fin").alias("id_fin"), text.normalised("tipo_de_contrato").alias("tipo"),
        modality("modalidad_de_contratacion").alias("modalidad"), v.alias("valor"), casts.displayed(F.log10(F.greatest(v, F.lit(0.0)) + 1)).alias("log_valor"), F.coalesce(v > EXTREME, no).alias("es_extremo"), (F.coalesce(v, F.lit(0.0)) <= 0).alias("sin_valor"),
        more.alias("dias_adicionados"), (more > 0).alias("tiene_adiciones"), term.alias("plazo"), casts.displayed(F.try_divide(more.cast("double"), F.nullif(term, F.lit(0)))).alias("razon_adicion"), F.coalesce(F.col("fecha_inicio") < F.col("fecha_firma"), no).alias("empieza_antes"),
        "es_grupo", "es_pyme", "liquidacion", F.year("fecha_firma").alias("anio"), (F.month("fecha_firma") == 12).alias("firmado_en_diciembre"), F.col("id_portafolio").isNull().alias("sin_proceso"),
    )


@query(
    """WITH m AS (SELECT origen AS ut, destino AS socio, count(*) AS filas, min(detalle) AS papel FROM vinculo_2025 WHERE tipo = 'integra' AND origen IS NOT NULL AND destino IS NOT NULL AND origen <> destino GROUP BY 1, 2)
    SELECT ut, socio, filas, papel, count(*) OVER (PARTITION BY ut) AS socios, round(1.0::DOUBLE / count(*) OVER (PARTITION BY ut) + 1e-7, 4) AS parte FROM m"""
)
def venture_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridge of joint ventures and their members, who share equally; sizes by an aggregate, not a window over a venture."""
    v = table(spark, sf_dir, "vinculo_2025").where("tipo = 'integra' and origen <> destino")
    m = v.groupBy(F.col("origen").alias("ut"), F.col("destino").alias("socio")).agg(F.count(F.lit(1)).alias("filas"), F.min("detalle").alias("papel"))
    size = m.groupBy("ut").agg(F.count(F.lit(1)).alias("socios"))
    return m.join(size, "ut").select("ut", "socio", "filas", "papel", "socios", casts.displayed(F.lit(1.0) / F.col("socios")).alias("parte"))


_PERSON = f"(coalesce({SQL_NORM('tipo_empresa')} LIKE '%PERSONA NATURAL%', false) OR coalesce(length({SQL_DIGITS('nit_proveedor')}) BETWEEN 6 AND 8 OR (length({SQL_DIGITS('nit_proveedor')}) = 10 AND left({SQL_DIGITS('nit_proveedor')}, 1) = '1'), false))"


def natural_person():
    """A person by the kind of company, or by a document of the length of an identity card."""
    d = text.digits("nit_proveedor")
    card = F.length(d).between(6, 8) | ((F.length(d) == 10) & (F.left(d, F.lit(1)) == "1"))
    return F.coalesce(text.normalised("tipo_empresa").like("%PERSONA NATURAL%"), F.lit(False)) | F.coalesce(card, F.lit(False))


@query(
    f"""WITH c AS (SELECT codigo_proveedor, count(*) AS n_contratos, count(DISTINCT codigo_entidad) AS n_entidades, CAST(sum(valor_del_contrato) FILTER (WHERE CAST(valor_del_contrato AS DOUBLE) <= 1e12) AS DOUBLE) AS valor, {_DAY('min(fecha_firma)')} AS primera, {_DAY('max(fecha_firma)')} AS ultima, bool_or(es_grupo) AS grupo_c FROM {_CONTRACTS} WHERE codigo_proveedor IS NOT NULL GROUP BY 1),
    o AS (SELECT codigo_proveedor, count(*) AS n_ofertas, count(DISTINCT id_del_proceso) AS n_procesos FROM {_BIDS} WHERE codigo_proveedor IS NOT NULL GROUP BY 1),
    a AS (SELECT codigo_proveedor, count(*) AS n_adjudicados FROM {_TENDERS} WHERE codigo_proveedor IS NOT NULL GROUP BY 1),
    s AS (SELECT upper(trim(codigo_proveedor)) AS codigo_proveedor, min({SQL_CLEAN('nombre_proveedor')}) AS nombre, min({SQL_DIGITS('nit_proveedor')}) AS nit, bool_or(es_grupo) AS grupo_s, bool_or(es_pyme) AS es_pyme, min({SQL_NORM('tipo_empresa')}) AS tipo, min({SQL_NORM('departamento')}) AS departamento, bool_or({_PERSON}) AS persona, bool_and(fecha_baja IS NOT NULL) AS baja FROM {_SUPPLIERS} GROUP BY 1),
    k AS (SELECT codigo_proveedor FROM c UNION SELECT codigo_proveedor FROM o UNION SELECT codigo_proveedor FROM a UNION SELECT codigo_proveedor FROM s)
    SELECT codigo_proveedor, coalesce(nombre, 'SIN REGISTRO') AS nombre, nit, tipo, departamento, coalesce(grupo_s, grupo_c, false) AS es_grupo, coalesce(es_pyme, false) AS es_pyme, coalesce(persona, false) AS es_persona_natural, coalesce(baja, false) AS dado_de_baja, s.codigo_proveedor IS NOT NULL AS registrado,
    coalesce(n_contratos, 0) AS n_contratos, coalesce(n_entidades, 0) AS n_entidades, coalesce(valor, 0) AS valor, primera, ultima, coalesce(n_ofertas, 0) AS n_ofertas, coalesce(n_procesos, 0) AS n_procesos, coalesce(n_adjudicados, 0) AS n_adjudicados
    FROM k LEFT JOIN c USING (codigo_proveedor) LEFT JOIN o USING (codigo_proveedor) LEFT JOIN a USING (codigo_proveedor) LEFT JOIN s USING (codigo_proveedor)"""
)
def supplier_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier of any table with what each table knows; one aggregate a table, joined on the one key."""
    key = "codigo_proveedor"
    v = amount("valor_del_contrato")
    c = base._frame(spark, sf_dir, "contratos", "id_contrato", CONTRACT).where(f"{key} is not null").groupBy(key).agg(
        F.count(F.lit(1)).alias("n_contratos"), F.count_distinct("codigo_entidad").alias("n_entidades"), F.sum(F.when(v <= EXTREME, F.col("valor_del_contrato"))).cast("double").alias("valor"), day_id(F.min("fecha_firma")).alias("primera"), day_id(F.max("fecha_firma")).alias("ultima"), F.bool_or("es_grupo").alias("grupo_c"),
    )
    o = base._frame(spark, sf_dir, "ofertas", "id_oferta", BID).where(f"{key} is not null").groupBy(key).agg(F.count(F.lit(1)).alias("n_ofertas"), F.count_distinct("id_del_proceso").alias("n_procesos"))
    a = base._frame(spark, sf_dir, "procesos", "id_del_proceso", TENDER).where(f"{key} is not null").groupBy(key).agg(F.count(F.lit(1)).alias("n_adjudicados"))
    s = base._frame(spark, sf_dir, "proveedores", key, SUPPLIER).groupBy(F.upper(F.trim(key)).alias(key)).agg(
        F.min(text.cleaned("nombre_proveedor")).alias("nombre"), F.min(text.digits("nit_proveedor")).alias("nit"), F.bool_or("es_grupo").alias("grupo_s"), F.bool_or("es_pyme").alias("pyme"), F.min(text.normalised("tipo_empresa")).alias("tipo"),
        F.min(text.normalised("departamento")).alias("departamento"), F.bool_or(natural_person()).alias("persona"), F.bool_and(F.col("fecha_baja").isNotNull()).alias("baja"), F.lit(True).alias("en_registro"),
    )
    out = c.join(o, key, "full_outer").join(a, key, "full_outer").join(s, key, "full_outer")
    zero, no = lambda n: F.coalesce(n, F.lit(0)).alias(n), lambda n, x: F.coalesce(n, F.lit(False)).alias(x)
    return out.select(
        key, F.coalesce("nombre", F.lit("SIN REGISTRO")).alias("nombre"), "nit", "tipo", "departamento", F.coalesce("grupo_s", "grupo_c", F.lit(False)).alias("es_grupo"), no("pyme", "es_pyme"), no("persona", "es_persona_natural"), no("baja", "dado_de_baja"), no("en_registro", "registrado"),
        zero("n_contratos"), zero("n_entidades"), F.coalesce("valor", F.lit(0.0)).alias("valor"), "primera", "ultima", zero("n_ofertas"), zero("n_procesos"), zero("n_adjudicados"),
    )


@query(
    f"""WITH c AS (SELECT codigo_entidad, count(*) AS n_contratos, count(DISTINCT codigo_proveedor) AS n_proveedores, CAST(sum(valor_del_contrato) FILTER (WHERE CAST(valor_del_contrato AS DOUBLE) <= 1e12) AS DOUBLE) AS valor, {_DAY('min(fecha_firma)')} AS primera, {_DAY('max(fecha_firma)')} AS ultima,
      round(avg(CASE WHEN {_MODALITY('modalidad_de_contratacion')} = 'Directa' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) + 1e-7, 4) AS parte_directa FROM {_CONTRACTS} WHERE codigo_entidad IS NOT NULL GROUP BY 1),
    p AS (SELECT codigo_entidad, count(*) AS n_procesos, count(*) FILTER (WHERE adjudicado) AS n_adjudicados FROM {_TENDERS} WHERE codigo_entidad IS NOT NULL GROUP BY 1),
    e AS (SELECT upper(trim(codigo_entidad)) AS codigo_entidad, min({SQL_CLEAN('nombre_entidad')}) AS nombre, min({SQL_NORM('nombre_entidad')}) AS nombre_norm, min({SQL_DIGITS('nit_entidad')}) AS nit, min({SQL_NORM('orden_entidad')}) AS orden, min({SQL_NORM('departamento')}) AS departamento, min({SQL_NORM('ciudad')}) AS ciudad,
      bool_or(esta_activa) AS activa, max(n_contratos_hist) AS n_contratos_hist, max(n_procesos_hist) AS n_procesos_hist, {_DAY('max(fecha_actualizacion)')} AS actualizada, bool_and(fecha_baja IS NOT NULL) AS baja FROM {_BUYERS} GROUP BY 1),
    k AS (SELECT codigo_entidad FROM c UNION SELECT codigo_entidad FROM p UNION SELECT codigo_entidad FROM e)
    SELECT codigo_entidad, coalesce(nombre, 'SIN REGISTRO') AS nombre, nombre_norm, nit, orden, departamento, ciudad, coalesce(activa, false) AS esta_activa, coalesce(baja, false) AS dada_de_baja, e.codigo_entidad IS NOT NULL AS registrada, n_contratos_hist, n_procesos_hist, actualizada,
    coalesce(n_contratos, 0) AS n_contratos, coalesce(n_proveedores, 0) AS n_proveedores, coalesce(valor, 0) AS valor, primera, ultima, parte_directa, coalesce(n_procesos, 0) AS n_procesos, coalesce(n_adjudicados, 0) AS n_adjudicados
    FROM k LEFT JOIN c USING (codigo_entidad) LEFT JOIN p USING (codigo_entidad) LEFT JOIN e USING (codigo_entidad)"""
)
def entity_dim_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every buyer of any table with its registry data, activity and flags."""
    key = "codigo_entidad"
    direct = F.avg(F.when(modality("modalidad_de_contratacion") == "Directa", 1.0).otherwise(0.0))
    c = base._frame(spark, sf_dir, "contratos", "id_contrato", CONTRACT).where(f"{key} is not null").groupBy(key).agg(
        F.count(F.lit(1)).alias("n_contratos"), F.count_distinct("codigo_proveedor").alias("n_proveedores"), F.sum(F.when(amount("valor_del_contrato") <= EXTREME, F.col("valor_del_contrato"))).cast("double").alias("valor"),
        day_id(F.min("fecha_firma")).alias("primera"), day_id(F.max("fecha_firma")).alias("ultima"), casts.displayed(direct).alias("parte_directa"),
    )
    p = base._frame(spark, sf_dir, "procesos", "id_del_proceso", TENDER).where(f"{key} is not null").groupBy(key).agg(F.count(F.lit(1)).alias("n_procesos"), F.count_if("adjudicado").alias("n_adjudicados"))
    e = base._frame(spark, sf_dir, "entidades", key, BUYER).groupBy(F.upper(F.trim(key)).alias(key)).agg(
        F.min(text.cleaned("nombre_entidad")).alias("nombre"), F.min(text.normalised("nombre_entidad")).alias("nombre_norm"), F.min(text.digits("nit_entidad")).alias("nit"), F.min(text.normalised("orden_entidad")).alias("orden"), F.min(text.normalised("departamento")).alias("departamento"), F.min(text.normalised("ciudad")).alias("ciudad"),
        F.bool_or("esta_activa").alias("activa"), F.max("n_contratos_hist").alias("n_contratos_hist"), F.max("n_procesos_hist").alias("n_procesos_hist"), day_id(F.max("fecha_actualizacion")).alias("actualizada"), F.bool_and(F.col("fecha_baja").isNotNull()).alias("baja"), F.lit(True).alias("en_registro"),
    )
    out = c.join(p, key, "full_outer").join(e, key, "full_outer")
    zero, no = lambda n: F.coalesce(n, F.lit(0)).alias(n), lambda n, x: F.coalesce(n, F.lit(False)).alias(x)
    return out.select(
        key, F.coalesce("nombre", F.lit("SIN REGISTRO")).alias("nombre"), "nombre_norm", "nit", "orden", "departamento", "ciudad", no("activa", "esta_activa"), no("baja", "dada_de_baja"), no("en_registro", "registrada"), "n_contratos_hist", "n_procesos_hist", "actualizada",
        zero("n_contratos"), zero("n_proveedores"), F.coalesce("valor", F.lit(0.0)).alias("valor"), "primera", "ultima", "parte_directa", zero("n_procesos"), zero("n_adjudicados"),
    )


@query(
    f"""SELECT tipo, tipo IN ('OBRA', 'INTERVENTORIA', 'CONSULTORIA') AS es_alto_riesgo, count(*) AS contratos FROM (SELECT {SQL_NORM('tipo_de_contrato')} AS tipo FROM {_CONTRACTS}) WHERE tipo IS NOT NULL GROUP BY ALL"""
)
def contract_type_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = base._frame(spark, sf_dir, "contratos", "id_contrato", CONTRACT).groupBy(text.normalised("tipo_de_contrato").alias("tipo")).agg(F.count(F.lit(1)).alias("contratos"))
    return t.where("tipo is not null").withColumn("es_alto_riesgo", F.col("tipo").isin("OBRA", "INTERVENTORIA", "CONSULTORIA"))


@query(
    f"""SELECT e.codigo_entidad, count(c.id_contrato) AS corrientes, CAST(coalesce(sum(c.valor_del_contrato), 0) AS DOUBLE) AS valor FROM (SELECT DISTINCT upper(trim(codigo_entidad)) AS codigo_entidad FROM entidades WHERE codigo_entidad IS NOT NULL) e
    LEFT JOIN {_CONTRACTS} c ON c.codigo_entidad = e.codigo_entidad AND NOT coalesce(CAST(c.valor_del_contrato AS DOUBLE) > 1e12, false) GROUP BY 1"""
)
def buyers_without_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every registered buyer with its contracts, extreme values left out in the condition of the outer join."""
    e = table(spark, sf_dir, "entidades").where("codigo_entidad is not null").select(F.upper(F.trim("codigo_entidad")).alias("codigo_entidad")).distinct()
    c = base._frame(spark, sf_dir, "contratos", "id_contrato", CONTRACT).select(F.col("codigo_entidad").alias("de"), "id_contrato", "valor_del_contrato")
    on = (F.col("codigo_entidad") == F.col("de")) & ~F.coalesce(amount("valor_del_contrato") > EXTREME, F.lit(False))
    return e.join(c, on, "left").groupBy("codigo_entidad").agg(F.count("id_contrato").alias("corrientes"), F.coalesce(F.sum("valor_del_contrato"), F.lit(0)).cast("double").alias("valor"))


@query(
    f"""WITH t AS (SELECT codigo_entidad, count(*) AS n FROM {_CONTRACTS} WHERE codigo_entidad IS NOT NULL GROUP BY 1 ORDER BY n DESC, codigo_entidad LIMIT 40)
    SELECT t.codigo_entidad, n, count(DISTINCT c.codigo_proveedor) AS proveedores FROM t JOIN {_CONTRACTS} c USING (codigo_entidad) GROUP BY 1, 2 ORDER BY proveedores DESC, codigo_entidad LIMIT 6"""
)
def top_of_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the 40 buyers with most contracts the six with most suppliers; the inner report is made before the join."""
    c = base._frame(spark, sf_dir, "contratos", "id_contrato", CONTRACT).where("codigo_entidad is not null").select("codigo_entidad", "codigo_proveedor")
    t = c.groupBy("codigo_entidad").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "codigo_entidad").limit(40)
    out = c.join(F.broadcast(t), "codigo_entidad").groupBy("codigo_entidad", "n").agg(F.count_distinct("codigo_proveedor").alias("proveedores"))
    return out.orderBy(F.desc("proveedores"), "codigo_entidad").limit(6)


_COUNTED = ["contratos", "documents", "entidades", "nodos", "ofertas", "pares", "procesos", "proveedores", "vinculo_2025"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS tabla, count(*) AS filas FROM {t}" for t in _COUNTED))
def table_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table; no column is read, so the counts come from the footers of the files."""
    each = [table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("filas")).select(F.lit(t).alias("tabla"), "filas") for t in _COUNTED]
    return reduce(DataFrame.unionByName, each)


_OWN = f"own AS MATERIALIZED (SELECT codigo_proveedor AS cod, min(id_nodo) AS nodo FROM {base.ACTORS} WHERE codigo_proveedor IS NOT NULL GROUP BY 1)"
_NODE = lambda c: f"coalesce((SELECT nodo FROM own WHERE cod = {c}), 'COD:' || {c})"
_EDGES7 = f"""WITH {_OWN}, c AS MATERIALIZED (SELECT c.*, coalesce(o.nodo, 'COD:' || c.codigo_proveedor) AS nodo FROM {_CONTRACTS} c LEFT JOIN own o ON o.cod = c.codigo_proveedor WHERE c.codigo_proveedor IS NOT NULL),
    b AS MATERIALIZED (SELECT DISTINCT id_del_proceso AS p, coalesce(o.nodo, 'COD:' || codigo_proveedor) AS nodo FROM {_BIDS} LEFT JOIN own o ON o.cod = codigo_proveedor WHERE id_del_proceso IS NOT NULL AND codigo_proveedor IS NOT NULL),
    t AS MATERIALIZED (SELECT id_portafolio AS p, min(codigo_entidad) AS e FROM {_TENDERS} WHERE id_portafolio IS NOT NULL GROUP BY 1),
    w AS (SELECT DISTINCT id_portafolio AS p, coalesce(o.nodo, 'COD:' || codigo_proveedor) AS nodo FROM {_TENDERS} LEFT JOIN own o ON o.cod = codigo_proveedor WHERE id_portafolio IS NOT NULL AND codigo_proveedor IS NOT NULL),
    i AS MATERIALIZED (SELECT p, nodo FROM b UNION SELECT p, nodo FROM w),
    bk AS (SELECT p FROM b GROUP BY p HAVING count(*) BETWEEN 2 AND 100), ik AS (SELECT p FROM i GROUP BY p HAVING count(*) BETWEEN 2 AND 100),
    k AS MATERIALIZED (SELECT DISTINCT canal, valor, id_nodo FROM (SELECT 'correo' AS canal, {SQL_NORM('correo')} AS valor, id_nodo FROM {base.ACTORS} UNION ALL SELECT 'telefono', {SQL_NORM('telefono')}, id_nodo FROM {base.ACTORS}) WHERE valor IS NOT NULL),
    kf AS (SELECT canal, valor FROM k GROUP BY ALL HAVING count(*) BETWEEN 2 AND 20)
    SELECT 'adjudica' AS tipo, 'ENT:' || codigo_entidad AS origen, nodo AS destino, count(*) AS peso, CAST(sum(valor_del_contrato) AS DOUBLE) AS valor, CASE WHEN bool_and(coalesce({_MODALITY('modalidad_de_contratacion')} = 'Directa', false)) THEN 'solo directo' WHEN bool_or(coalesce({_MODALITY('modalidad_de_contratacion')} = 'Directa', false)) THEN 'mixto' ELSE 'con competencia' END AS detalle
      FROM c WHERE codigo_entidad IS NOT NULL AND NOT coalesce(CAST(valor_del_contrato AS DOUBLE) > 1e12, false) GROUP BY 2, 3
    UNION ALL SELECT 'se_presenta_a', i.nodo, 'ENT:' || t.e, count(*), NULL, CASE WHEN bool_or(b.p IS NOT NULL) THEN 'con oferta' ELSE 'solo inscrito' END FROM i JOIN t USING (p) LEFT JOIN b ON b.p = i.p AND b.nodo = i.nodo WHERE t.e IS NOT NULL GROUP BY 2, 3
    UNION ALL SELECT 'integra', origen, destino, count(*), NULL, min(detalle) FROM vinculo_2025 WHERE tipo = 'integra' AND origen <> destino GROUP BY 2, 3
    UNION ALL SELECT 'representado_por', id_nodo, 'RL:' || {SQL_DOCUMENT('doc_rep_legal')}, 1, NULL, min(nombre_rep_legal) FROM {base.ACTORS} WHERE {SQL_DOCUMENT('doc_rep_legal')} IS NOT NULL GROUP BY 2, 3
    UNION ALL SELECT 'co_oferta', x.nodo, y.nodo, count(*), NULL, NULL FROM b x JOIN bk USING (p) JOIN b y ON y.p = x.p AND x.nodo < y.nodo GROUP BY 2, 3
    UNION ALL SELECT 'co_presentacion', x.nodo, y.nodo, count(*), NULL, NULL FROM i x JOIN ik USING (p) JOIN i y ON y.p = x.p AND x.nodo < y.nodo GROUP BY 2, 3
    UNION ALL SELECT 'comparte_contacto', x.id_nodo, y.id_nodo, count(*), NULL, min(x.canal) FROM k x JOIN kf USING (canal, valor) JOIN k y ON y.canal = x.canal AND y.valor = x.valor AND x.id_nodo < y.id_nodo GROUP BY 2, 3"""


def together(rows: DataFrame, keys: list[str], most: int, *extra) -> DataFrame:
    """Pairs of nodes that stand under the same key, for keys of 2 to ``most`` nodes, with the number of keys.

    ``rows`` has the keys and ``nodo``, each combination once. Larger keys link nobody by definition of the edge, so a key
    gives at most ``most`` squared rows.
    """
    fit = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("k")).where(F.col("k").between(2, most)).drop("k")
    few = rows.join(fit, keys, "left_semi")
    pairs = few.withColumnRenamed("nodo", "origen").join(few.withColumnRenamed("nodo", "destino"), keys).where("origen < destino")
    return pairs.groupBy("origen", "destino").agg(F.count(F.lit(1)).alias("peso"), *extra)


@query(_EDGES7)
def network_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven kinds of edges between actors, buyers and representatives.

    Accounts stand for their actor where there is one. Co-bidding and co-registration take tenders of 2 to 100 actors,
    shared contacts values of 2 to 20, as the edges are defined.
    """
    actors = base.actors(spark, sf_dir)
    own = actors.where("codigo_proveedor is not null").groupBy(F.col("codigo_proveedor").alias("cod")).agg(F.min("id_nodo").alias("n"))
    node = F.coalesce("n", F.concat(F.lit("COD:"), "codigo_proveedor")).alias("nodo")
    named = lambda df: df.where("codigo_proveedor is not null").join(own, F.col("codigo_proveedor") == F.col("cod"), "left")
    columns = ["tipo", "origen", "destino", "peso", "valor", "detalle"]
    none = F.lit(None)

    def kind(name: str, df: DataFrame, **more) -> DataFrame:
        filled = {"valor": none.cast("double"), "detalle": none.cast("string")} | more
        return df.withColumns({"tipo": F.lit(name)} | {k: v for k, v in filled.items() if k not in df.columns}).select(*columns)

    direct = F.coalesce(modality("modalidad_de_contratacion") == "Directa", F.lit(False))
    c = named(base._frame(spark, sf_dir, "contratos", "id_contrato", CONTRACT)).where("codigo_entidad is not null").where(~F.coalesce(amount("valor_del_contrato") > EXTREME, F.lit(False)))
    c = c.select(F.concat(F.lit("ENT:"), "codigo_entidad").alias("origen"), node.alias("destino"), "valor_del_contrato", direct.alias("d")).groupBy("origen", "destino")
    how = F.when(F.bool_and("d"), "solo directo").when(F.bool_or("d"), "mixto").otherwise("con competencia")
    awards = c.agg(F.count(F.lit(1)).alias("peso"), F.sum("valor_del_contrato").cast("double").alias("valor"), how.alias("detalle"))
    tenders = base._frame(spark, sf_dir, "procesos", "id_del_proceso", TENDER).where("id_portafolio is not null").withColumnRenamed("id_portafolio", "p")
    bids = named(base._frame(spark, sf_dir, "ofertas", "id_oferta", BID).where("id_del_proceso is not null")).select(F.col("id_del_proceso").alias("p"), node).distinct()
    won = named(tenders).select("p", node).distinct()
    entered = bids.withColumn("oferta", F.lit(True)).unionByName(won.withColumn("oferta", F.lit(False))).groupBy("p", "nodo").agg(F.bool_or("oferta").alias("oferta"))
    buyer = tenders.groupBy("p").agg(F.min("codigo_entidad").alias("e")).where("e is not null")
    goes = entered.join(buyer, "p").groupBy(F.col("nodo").alias("origen"), F.concat(F.lit("ENT:"), "e").alias("destino"))
    goes = goes.agg(F.count(F.lit(1)).alias("peso"), F.when(F.bool_or("oferta"), "con oferta").otherwise("solo inscrito").alias("detalle"))
    member = table(spark, sf_dir, "vinculo_2025").where("tipo = 'integra' and origen <> destino").groupBy("origen", "destino").agg(F.count(F.lit(1)).alias("peso"), F.min("detalle").alias("detalle"))
    doc = text.valid_document("doc_rep_legal")
    stands = actors.select(F.col("id_nodo").alias("origen"), doc.alias("d"), "nombre_rep_legal").where("d is not null").groupBy("origen", F.concat(F.lit("RL:"), "d").alias("destino"))
    stands = stands.agg(F.lit(1).cast("long").alias("peso"), F.min("nombre_rep_legal").alias("detalle"))
    reach = actors.select(F.col("id_nodo").alias("nodo"), text.normalised("correo").alias("correo"), text.normalised("telefono").alias("telefono")).unpivot("nodo", ["correo", "telefono"], "canal", "valor").where("valor is not null").distinct()
    parts = [
        kind("adjudica", awards), kind("se_presenta_a", goes), kind("integra", member), kind("representado_por", stands), kind("co_oferta", together(bids, ["p"], 100)),
        kind("co_presentacion", together(entered.select("p", "nodo"), ["p"], 100)), kind("comparte_contacto", together(reach, ["canal", "valor"], 20, F.min("canal").alias("detalle"))),
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    f"""SELECT 'RL:' || doc AS id_nodo, doc AS documento, max(nombre) AS nombre, {SQL_NORM('max(nombre)')} AS nombre_canonico, count(*) AS actores FROM
    (SELECT DISTINCT {SQL_DOCUMENT('doc_rep_legal')} AS doc, id_nodo, {SQL_CLEAN('nombre_rep_legal')} AS nombre FROM {base.ACTORS}) WHERE doc IS NOT NULL GROUP BY doc"""
)
def representative_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legal representatives by document, with the number of actors that each represents."""
    a = base.actors(spark, sf_dir).select(text.valid_document("doc_rep_legal").alias("documento"), "id_nodo", text.cleaned("nombre_rep_legal").alias("nombre")).where("documento is not null")
    g = a.groupBy("documento").agg(F.max("nombre").alias("nombre"), F.count(F.lit(1)).alias("actores"))
    return g.select(F.concat(F.lit("RL:"), "documento").alias("id_nodo"), "documento", "nombre", text.normalised("nombre").alias("nombre_canonico"), "actores")


@query(
    f"""WITH e AS (SELECT upper(trim(codigo_entidad)) AS codigo_entidad, min({SQL_CLEAN('nombre_entidad')}) AS nombre, min({SQL_DIGITS('nit_entidad')}) AS documento, min({SQL_NORM('orden_entidad')}) AS orden FROM {_BUYERS} GROUP BY 1)
    SELECT 'ENT:' || codigo_entidad AS id_nodo, documento, nombre, {SQL_NORM('nombre')} AS nombre_canonico, orden, count(*) AS contratos, CAST(sum(valor_del_contrato) AS DOUBLE) AS valor, count(DISTINCT codigo_proveedor) AS proveedores
    FROM e JOIN (SELECT codigo_entidad, valor_del_contrato, codigo_proveedor FROM {_CONTRACTS}) c USING (codigo_entidad) GROUP BY ALL"""
)
def buyer_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered buyers that have contracts; contracts are added up before the join."""
    e = base._frame(spark, sf_dir, "entidades", "codigo_entidad", BUYER).groupBy(F.upper(F.trim("codigo_entidad")).alias("codigo_entidad")).agg(
        F.min(text.cleaned("nombre_entidad")).alias("nombre"), F.min(text.digits("nit_entidad")).alias("documento"), F.min(text.normalised("orden_entidad")).alias("orden")
    )
    c = base._frame(spark, sf_dir, "contratos", "id_contrato", CONTRACT).where("codigo_entidad is not null").groupBy("codigo_entidad")
    c = c.agg(F.count(F.lit(1)).alias("contratos"), F.sum("valor_del_contrato").cast("double").alias("valor"), F.count_distinct("codigo_proveedor").alias("proveedores"))
    return e.join(c, "codigo_entidad").select(F.concat(F.lit("ENT:"), "codigo_entidad").alias("id_nodo"), "documento", "nombre", text.normalised("nombre").alias("nombre_canonico"), "orden", "contratos", "valor", "proveedores")


_TYPES = """CASE WHEN es_grupo THEN 'union temporal' WHEN persona THEN 'persona natural' WHEN codigo IS NOT NULL THEN 'persona juridica' ELSE 'sin cuenta' END"""


@query(
    f"""WITH s AS (SELECT upper(trim(codigo_proveedor)) AS codigo, bool_or(coalesce(es_grupo, false)) AS es_grupo, bool_or({_PERSON}) AS persona FROM {_SUPPLIERS} GROUP BY 1),
    u AS (SELECT DISTINCT origen AS id_nodo FROM vinculo_2025 WHERE tipo = 'integra' AND origen IS NOT NULL)
    SELECT tipo, count(*) AS actores, count(*) FILTER (WHERE matricula) AS con_matricula, count(*) FILTER (WHERE sector) AS con_sector, count(*) FILTER (WHERE documento) AS con_documento FROM
    (SELECT CASE WHEN u.id_nodo IS NOT NULL THEN 'union temporal' ELSE {_TYPES} END AS tipo, fecha_matricula IS NOT NULL AS matricula, ciiu1 IS NOT NULL AS sector, {SQL_DOCUMENT('documento')} IS NOT NULL AS documento FROM {base.ACTORS} a LEFT JOIN s ON s.codigo = a.codigo_proveedor LEFT JOIN u USING (id_nodo)) GROUP BY tipo"""
)
def actor_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actors by kind (venture, person, company, without account) with what the registry knows of them."""
    s = base._frame(spark, sf_dir, "proveedores", "codigo_proveedor", SUPPLIER).groupBy(F.upper(F.trim("codigo_proveedor")).alias("codigo")).agg(F.bool_or(F.coalesce("es_grupo", F.lit(False))).alias("es_grupo"), F.bool_or(natural_person()).alias("persona"))
    u = table(spark, sf_dir, "vinculo_2025").where("tipo = 'integra' and origen is not null").select(F.col("origen").alias("ut")).distinct()
    a = base.actors(spark, sf_dir).join(s, F.col("codigo_proveedor") == F.col("codigo"), "left").join(u, F.col("id_nodo") == F.col("ut"), "left")
    kind = F.when(F.col("ut").isNotNull() | F.col("es_grupo"), "union temporal").when(F.col("persona"), "persona natural").when(F.col("codigo").isNotNull(), "persona juridica").otherwise("sin cuenta")
    has = lambda c: F.count_if(c.isNotNull())
    return a.groupBy(kind.alias("tipo")).agg(F.count(F.lit(1)).alias("actores"), has(F.col("fecha_matricula")).alias("con_matricula"), has(F.col("ciiu1")).alias("con_sector"), has(text.valid_document("documento")).alias("con_documento"))


_FEATURE_SQL = f"""WITH {components_sql(AWARD_PAIRS, 'comp')}, {_CRI}, lim AS (SELECT quantile_cont(round(cri + 1e-12, 9), 0.9) AS p90 FROM s), d AS (SELECT id, count(*) AS grado, sum(w) AS fuerza FROM {_SIDES(AWARD_PAIRS)} GROUP BY 1),
    tam AS (SELECT c, count(*) AS n FROM comp GROUP BY c), gig AS (SELECT c FROM tam ORDER BY n DESC, c LIMIT 1),
    kk AS (SELECT codigo_proveedor, CAST(sum(valor_del_contrato) AS DOUBLE) AS v, round(avg(coalesce(dias_adicionados, 0)) + 1e-7, 4) AS adicion, count(DISTINCT year(fecha_firma)) AS anios FROM {base.CONTRACTS} WHERE codigo_proveedor IS NOT NULL GROUP BY 1)
    SELECT a.id_nodo, s.n AS n_contratos, s.e AS n_entidades, round(log10(greatest(v, 0) + 1) + 1e-7, 4) AS log_valor, round(log10(s.n + 1) + 1e-7, 4) AS log_n, round(CAST(s.e AS DOUBLE) / s.n + 1e-7, 4) AS reparto, adicion, anios, coalesce(grado, 0) AS grado, coalesce(fuerza, 0) AS fuerza,
    round(k.solo + 1e-7, 4) AS solo, round(k.directa + 1e-7, 4) AS directa, round(k.minima + 1e-7, 4) AS minima, round(cri + 1e-7, 4) AS cri, round(cri + 1e-12, 9) >= p90 - 1e-9 AS riesgo_alto, coalesce(tam.n, 0) AS componente, coalesce(comp.c = (SELECT c FROM gig), false) AS en_gigante
    FROM {base.ACTORS} a JOIN s USING (codigo_proveedor) JOIN k USING (codigo_proveedor) JOIN kk USING (codigo_proveedor) LEFT JOIN d ON d.id = a.id_nodo LEFT JOIN comp ON comp.id = a.id_nodo LEFT JOIN tam ON tam.c = comp.c, lim"""


def feature_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = cri(spark, sf_dir).withColumn("r", F.round(F.col("cri") + 1e-12, 9))
    k = base.contracts(spark, sf_dir).where("codigo_proveedor is not null").groupBy("codigo_proveedor").agg(
        F.sum("valor_del_contrato").cast("double").alias("v"), casts.displayed(F.avg(F.coalesce("dias_adicionados", F.lit(0)))).alias("adicion"), F.count_distinct(F.year("fecha_firma")).alias("anios")
    )
    p = award_pairs(spark, sf_dir)
    d, comp = graph.degrees(p), labelled_components(p)
    limit = s.agg(F.percentile("r", F.lit(0.9)).alias("p90"))
    rows = base.actors(spark, sf_dir).select("id_nodo", "codigo_proveedor").join(s, "codigo_proveedor").join(k, "codigo_proveedor").join(d.withColumnRenamed("id", "id_nodo"), "id_nodo", "left").join(comp.withColumnRenamed("id", "id_nodo"), "id_nodo", "left")
    return rows.crossJoin(F.broadcast(limit))


@query(_FEATURE_SQL)
def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract, index and network features of each actor with contracts, and its label: an index in the top tenth."""
    show = lambda c, n: casts.displayed(c).alias(n)
    return feature_frame(spark, sf_dir).select(
        "id_nodo", F.col("n").alias("n_contratos"), F.col("e").alias("n_entidades"), show(F.log10(F.greatest("v", F.lit(0.0)) + 1), "log_valor"), show(F.log10(F.col("n") + 1), "log_n"), show(F.col("e").cast("double") / F.col("n"), "reparto"), "adicion", "anios",
        F.coalesce("grado", F.lit(0)).alias("grado"), F.coalesce("fuerza", F.lit(0.0)).alias("fuerza"), show(F.col("solo"), "solo"), show(F.col("directa"), "directa"), show(F.col("minima"), "minima"), show(F.col("cri"), "cri"),
        (F.col("r") >= F.col("p90") - 1e-9).alias("riesgo_alto"), F.coalesce("tamano", F.lit(0)).alias("componente"), F.coalesce("gigante", F.lit(False)).alias("en_gigante"),
    )
