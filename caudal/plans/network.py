"""Network of buyers, suppliers, joint ventures and representatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caudal.functions import casts, text
from caudal.operators import graph
from caudal.plans import base
from caudal.plans.registry import query
from caudal.plans.warehouse import SQL_DOCUMENT, SQL_NORM, bidders, contacts
from caudal.session import table

#: Sectors and names of banks and insurers, which don't count in triangles (fixed values).
FINANCE_SECTORS = ["64", "65", "66"]
FINANCE_NAMES = "SEGURO|ASEGURADORA|FIDUCIARIA|BANCO|COMPANIA DE SEGUROS|CORREDORES DE SEGUROS"


def finance(sector: str = "ciiu1", name: str = "nombre"):
    return F.coalesce(F.left(F.col(sector), F.lit(2)).isin(FINANCE_SECTORS), F.lit(False)) | F.coalesce(F.upper(name).rlike(FINANCE_NAMES), F.lit(False))


_FINANCE = f"(coalesce(left(ciiu1, 2) IN ('64', '65', '66'), false) OR coalesce(regexp_matches(upper(nombre), '{FINANCE_NAMES}'), false))"
_PAIRS = "(SELECT least(origen, destino) AS a, greatest(origen, destino) AS b, CAST(sum(coalesce(peso, 1)) AS DOUBLE) AS w FROM vinculo_2025 WHERE {where} origen <> destino GROUP BY 1, 2)"
AWARD_PAIRS = _PAIRS.format(where="tipo = 'adjudica' AND")
ALL_PAIRS = _PAIRS.format(where="")
_SIDES = lambda p: f"(SELECT a AS id, b AS other, w FROM {p} UNION ALL SELECT b, a, w FROM {p})"


def award_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.undirected(table(spark, sf_dir, "vinculo_2025").where("tipo = 'adjudica'"), "origen", "destino", "peso")


@query(f"SELECT id, count(*) AS grado, sum(w) AS fuerza FROM {_SIDES(AWARD_PAIRS)} GROUP BY id")
def degree_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(award_pairs(spark, sf_dir))


def _pagerank_sql(rounds: int) -> str:
    parts = [f"s AS MATERIALIZED (SELECT id, other, w / sum(w) OVER (PARTITION BY id) AS share FROM {_SIDES(AWARD_PAIRS)})", "n AS (SELECT CAST(count(DISTINCT id) AS DOUBLE) AS n FROM s)", "r0 AS (SELECT DISTINCT id, 1 / n AS rank FROM s, n)"]
    for i in range(rounds):
        parts.append(f"r{i + 1} AS MATERIALIZED (SELECT s.other AS id, 0.15::DOUBLE / any_value(n.n) + 0.85::DOUBLE * sum(r.rank * s.share) AS rank FROM s JOIN r{i} r USING (id), n GROUP BY 1)")
    return f"WITH {', '.join(parts)} SELECT id, round(rank * 1e6 + 1e-7, 4) AS rank FROM r{rounds}"


@query(_pagerank_sql(8))
def pagerank_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks after eight rounds, in millionths."""
    r = graph.pagerank(award_pairs(spark, sf_dir), rounds=8, exact_rounds=True)
    return r.select("id", casts.displayed(F.col("rank") * 1e6).alias("rank"))


@query()
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Converged ranks."""
    return graph.pagerank(award_pairs(spark, sf_dir))


_LINKS = _PAIRS.format(where="tipo IN ('integra', 'comparte_contacto') AND")


@query(
    f"""WITH RECURSIVE p AS MATERIALIZED {_LINKS}, s AS MATERIALIZED (SELECT a AS id, b AS other FROM p UNION ALL SELECT b, a FROM p),
    r(id, c) AS (SELECT DISTINCT id, id FROM s UNION SELECT s.other, r.c FROM r JOIN s USING (id) WHERE r.c < s.other)
    SELECT id, min(c) AS componente FROM r GROUP BY id"""
)
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "vinculo_2025").where(F.col("tipo").isin("integra", "comparte_contacto"))
    return graph.components(graph.undirected(v, "origen", "destino", "peso"))


@query()
def community_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of the award network by label propagation."""
    return graph.communities(award_pairs(spark, sf_dir))


@query(
    f"""WITH p AS {AWARD_PAIRS}, l AS (SELECT id, left(right(id, 2), 1) AS c FROM {_SIDES('p')} GROUP BY ALL), m AS (SELECT sum(w) AS m FROM p),
    i AS (SELECT x.c, sum(w) AS l FROM p JOIN l x ON x.id = a JOIN l y ON y.id = b WHERE x.c = y.c GROUP BY 1), d AS (SELECT c, sum(w) AS d FROM {_SIDES('p')} JOIN l USING (id) GROUP BY 1)
    SELECT count(*) AS comunidades, round(sum(coalesce(l, 0) / m - pow(d / (2 * m), 2)) + 1e-7, 4) AS modularidad FROM d LEFT JOIN i USING (c), m"""
)
def modularity_given_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modularity of a given labelling (here by a digit of the id)."""
    p = award_pairs(spark, sf_dir)
    labels = graph.degrees(p).select("id", F.left(F.right("id", F.lit(2)), F.lit(1)).alias("c"))
    m = graph.modularity(p, labels, "c")
    return m.select("comunidades", casts.displayed(F.col("modularidad")).alias("modularidad"))


def components_sql(pairs: str, name: str, rounds: int = 24) -> str:
    """CTEs that end in ``name`` (id, c): the smallest id of each component, for graphs of up to ``rounds`` links across."""
    parts = [f"{name}_s AS MATERIALIZED (SELECT a AS id, b AS other FROM {pairs} UNION ALL SELECT b, a FROM {pairs})", f"{name}_0 AS (SELECT DISTINCT id, id AS c FROM {name}_s)"]
    for i in range(rounds):
        last = name if i == rounds - 1 else f"{name}_{i + 1}"
        parts.append(f"{last} AS MATERIALIZED (SELECT s.id, least(min(o.c), min(l.c)) AS c FROM {name}_s s JOIN {name}_{i} o ON o.id = s.other JOIN {name}_{i} l ON l.id = s.id GROUP BY s.id)")
    return ", ".join(parts)


def labelled_components(pairs: DataFrame) -> DataFrame:
    """``id, componente_id, tamano, gigante``: the component of each vertex, its size and whether it is the largest (ties: smallest id)."""
    c = graph.components(pairs)
    size = c.groupBy("componente").agg(F.count(F.lit(1)).alias("tamano"))
    top = size.agg(F.min(F.struct((-F.col("tamano")).alias("n"), "componente")).alias("t")).select(F.col("t.componente").alias("mayor"))
    named = size.crossJoin(F.broadcast(top)).select("componente", "tamano", (F.col("componente") == F.col("mayor")).alias("gigante"))
    return c.join(named, "componente").select("id", F.col("componente").alias("componente_id"), "tamano", "gigante")


@query(
    f"""WITH {components_sql(AWARD_PAIRS, 'comp')}, t AS (SELECT c, count(*) AS n FROM comp GROUP BY c) SELECT count(*) AS componentes, max(n) AS gigante, round(max(n) / CAST(sum(n) AS DOUBLE) + 1e-7, 4) AS parte_gigante, count(*) FILTER (WHERE n = 2) AS parejas FROM t"""
)
def topology_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the award network and the largest of them."""
    size = graph.components(award_pairs(spark, sf_dir)).groupBy("componente").agg(F.count(F.lit(1)).alias("n"))
    return size.agg(F.count(F.lit(1)).alias("componentes"), F.max("n").alias("gigante"), casts.displayed(F.max("n").cast("double") / F.sum("n")).alias("parte_gigante"), F.count_if(F.col("n") == 2).alias("parejas"))


@query()
def topology_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of communities of the award network and their modularity."""
    p = award_pairs(spark, sf_dir)
    return graph.modularity(p, graph.communities(p), "comunidad")


@query(
    f"""WITH p AS {AWARD_PAIRS}, d AS (SELECT id, count(*) AS g FROM {_SIDES('p')} GROUP BY 1)
    SELECT (SELECT count(*) FROM d) AS nodos, (SELECT count(*) FROM p) AS aristas, (SELECT count(*) FROM d WHERE id LIKE 'ENT:%') AS compradores,
    round(2.0::DOUBLE * (SELECT count(*) FROM p) / ((SELECT count(*) FROM d) * ((SELECT count(*) FROM d) - 1)) + 1e-9, 7) AS densidad, round(avg(g) + 1e-7, 4) AS grado_medio, max(g) AS grado_max FROM d"""
)
def topology_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = award_pairs(spark, sf_dir)
    d = graph.degrees(p).agg(F.count(F.lit(1)).alias("nodos"), F.count_if(F.col("id").startswith("ENT:")).alias("compradores"), casts.displayed(F.avg("grado")).alias("grado_medio"), F.max("grado").alias("grado_max"))
    density = F.round(2.0 * F.col("aristas") / (F.col("nodos") * (F.col("nodos") - 1)) + 1e-9, 7)
    return d.crossJoin(p.agg(F.count(F.lit(1)).alias("aristas"))).withColumn("densidad", density)


_TRI = f"""exc AS (SELECT DISTINCT id_nodo FROM {base.ACTORS} WHERE {_FINANCE}),
    adj AS (SELECT DISTINCT origen AS entidad, destino AS actor FROM vinculo_2025 WHERE tipo = 'adjudica' AND origen IS NOT NULL AND destino NOT IN (SELECT id_nodo FROM exc)),
    inte AS (SELECT DISTINCT origen AS ut, destino AS socio FROM vinculo_2025 WHERE tipo = 'integra' AND origen <> destino AND origen NOT IN (SELECT id_nodo FROM exc) AND destino NOT IN (SELECT id_nodo FROM exc)),
    tri AS (SELECT a.entidad, i.ut, i.socio FROM inte i JOIN adj a ON a.actor = i.ut JOIN adj d ON d.entidad = a.entidad AND d.actor = i.socio)"""


def triangles_of(spark: SparkSession, sf_dir: str, excluded: DataFrame | None) -> DataFrame:
    from caudal.operators.skew import risk_triangles

    v = table(spark, sf_dir, "vinculo_2025").where(F.col("tipo").isin("adjudica", "integra") & F.col("origen").isNotNull() & F.col("destino").isNotNull())
    if excluded is not None:
        v = v.join(excluded, v["destino"] == excluded["id_nodo"], "left_anti").join(excluded, v["origen"] == excluded["id_nodo"], "left_anti")
    return risk_triangles(v, "tipo", "origen", "destino")


@query(f"WITH {_TRI} SELECT entidad, ut, socio FROM tri")
def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buyer, joint venture and member, banks and insurers left out."""
    return triangles_of(spark, sf_dir, base.actors(spark, sf_dir).where(finance()).select("id_nodo").distinct())


@query(f"WITH {_TRI} SELECT count(*) AS triangulos, count(DISTINCT entidad) AS entidades, count(DISTINCT ut) AS uts, count(DISTINCT socio) AS socios FROM tri")
def triangle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triangles(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("triangulos"), F.count_distinct("entidad").alias("entidades"), F.count_distinct("ut").alias("uts"), F.count_distinct("socio").alias("socios")
    )


@query(
    f"""WITH {_TRI}, c AS (SELECT DISTINCT id_nodo FROM {base.ACTORS} WHERE left(ciiu1, 2) IN ('64', '65', '66')),
    t2 AS (SELECT a.entidad, i.origen AS ut, i.destino AS socio FROM (SELECT DISTINCT origen, destino FROM vinculo_2025 WHERE tipo = 'integra' AND origen <> destino AND origen NOT IN (SELECT id_nodo FROM c) AND destino NOT IN (SELECT id_nodo FROM c)) i
    JOIN (SELECT DISTINCT origen AS entidad, destino AS actor FROM vinculo_2025 WHERE tipo = 'adjudica' AND origen IS NOT NULL AND destino IS NOT NULL) a ON a.actor = i.origen
    JOIN (SELECT DISTINCT origen AS entidad, destino AS actor FROM vinculo_2025 WHERE tipo = 'adjudica') d ON d.entidad = a.entidad AND d.actor = i.destino)
    SELECT 'sector o nombre' AS criterio, count(*) AS triangulos FROM tri UNION ALL SELECT 'solo sector', count(*) FROM t2"""
)
def exclusion_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles under two ways to tell banks and insurers."""
    a = base.actors(spark, sf_dir)
    sector = a.where(F.left("ciiu1", F.lit(2)).isin(FINANCE_SECTORS)).select("id_nodo").distinct()
    n = F.count(F.lit(1)).alias("triangulos")
    one = triangles(spark, sf_dir).agg(n).select(F.lit("sector o nombre").alias("criterio"), "triangulos")
    return one.unionByName(triangles_of(spark, sf_dir, sector).agg(n).select(F.lit("solo sector").alias("criterio"), "triangulos"))


@query("SELECT tipo, count(*) AS filas, count(DISTINCT (origen, destino)) AS pares, count(DISTINCT origen) AS origenes, count(DISTINCT destino) AS destinos, count(*) FILTER (WHERE origen = destino) AS lazos FROM vinculo_2025 GROUP BY tipo")
def edge_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "vinculo_2025").groupBy("tipo").agg(
        F.count(F.lit(1)).alias("filas"), F.count_distinct(F.struct("origen", "destino")).alias("pares"), F.count_distinct("origen").alias("origenes"), F.count_distinct("destino").alias("destinos"), F.count_if(F.col("origen") == F.col("destino")).alias("lazos")
    )


@query(
    f"""WITH p AS (SELECT DISTINCT least(origen, destino) AS a, greatest(origen, destino) AS b, tipo FROM vinculo_2025 WHERE tipo IN ('adjudica', 'integra') AND origen <> destino),
    n AS (SELECT id, CASE WHEN bool_or(id LIKE 'ENT:%') THEN 'entidad' WHEN bool_or(k = 'ut') THEN 'ut' WHEN bool_or(k = 'socio') THEN 'socio' ELSE 'proveedor' END AS clase FROM
    (SELECT origen AS id, CASE WHEN tipo = 'integra' THEN 'ut' END AS k FROM vinculo_2025 WHERE tipo IN ('adjudica', 'integra') AND origen <> destino
     UNION ALL SELECT destino, CASE WHEN tipo = 'integra' THEN 'socio' END FROM vinculo_2025 WHERE tipo IN ('adjudica', 'integra') AND origen <> destino) GROUP BY id)
    SELECT clase, count(*) AS nodos FROM n GROUP BY clase"""
)
def tripartite_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of each vertex by precedence: buyer, joint venture, member, other supplier."""
    v = table(spark, sf_dir, "vinculo_2025").where(F.col("tipo").isin("adjudica", "integra")).where("origen <> destino")
    group = F.col("tipo") == "integra"
    rank = lambda side, k: F.struct(F.col(side).alias("id"), F.when(F.col(side).startswith("ENT:"), 0).when(group, k).otherwise(3).alias("k"))
    each = v.select(F.explode(F.array(rank("origen", 1), rank("destino", 2))).alias("e")).groupBy("e.id").agg(F.min("e.k").alias("k"))
    name = F.element_at(F.array(*map(F.lit, ["entidad", "ut", "socio", "proveedor"])), F.col("k") + 1)
    return each.groupBy(name.alias("clase")).agg(F.count(F.lit(1)).alias("nodos"))


_EGO = f"""p AS MATERIALIZED {ALL_PAIRS}, s AS MATERIALIZED {_SIDES('p')}, c AS (SELECT id FROM s WHERE id LIKE 'DOC:%' GROUP BY id ORDER BY count(*) DESC, id LIMIT 1),
    h1 AS MATERIALIZED (SELECT other AS id FROM s JOIN c USING (id)), n AS MATERIALIZED (SELECT id FROM c UNION SELECT id FROM h1 UNION SELECT other FROM s JOIN h1 USING (id)),
    e AS MATERIALIZED (SELECT a, b, w FROM p WHERE a IN (SELECT id FROM n) AND b IN (SELECT id FROM n)), d AS MATERIALIZED (SELECT id, count(*) AS g FROM (SELECT a AS id FROM e UNION ALL SELECT b FROM e) GROUP BY 1),
    t AS MATERIALIZED (SELECT x.a AS u, x.b AS v, y.b AS w FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b), tt AS (SELECT id, count(*) AS t FROM (SELECT u AS id FROM t UNION ALL SELECT v FROM t UNION ALL SELECT w FROM t) GROUP BY 1),
    q AS (SELECT dx.g AS gx, dy.g AS gy FROM e JOIN d dx ON dx.id = a JOIN d dy ON dy.id = b)"""


@query(
    f"""WITH {_EGO} SELECT (SELECT id FROM c) AS centro, (SELECT count(*) FROM n) AS nodos, (SELECT count(*) FROM e) AS aristas, (SELECT count(*) FROM n WHERE id LIKE 'ENT:%') AS compradores, (SELECT count(*) FROM n WHERE id LIKE 'RL:%') AS representantes, (SELECT sum(w) FROM e) AS peso, (SELECT max(w) FROM e) AS peso_max,
    (SELECT count(DISTINCT id) FROM h1) AS vecinos, round(2.0::DOUBLE * (SELECT count(*) FROM e) / ((SELECT count(*) FROM n) * ((SELECT count(*) FROM n) - 1)) + 1e-7, 6) AS densidad, round(avg(g) + 1e-7, 4) AS grado_medio, round(count(*) FILTER (WHERE g = 1) / CAST(count(*) AS DOUBLE) + 1e-7, 4) AS hojas_parte, count(*) FILTER (WHERE g = 1) AS hojas, max(g) AS grado_max, (SELECT count(*) FROM t) AS triangulos,
    round(coalesce(3.0::DOUBLE * (SELECT count(*) FROM t) / nullif(sum(g * (g - 1) / 2.0::DOUBLE), 0), 0) + 1e-7, 4) AS transitividad,
    round(avg(CASE WHEN g < 2 THEN 0 ELSE coalesce(t, 0) / (g * (g - 1) / 2.0::DOUBLE) END) + 1e-7, 4) AS agrupamiento,
    (SELECT round(corr(x, y) + 1e-7, 4) FROM (SELECT CAST(gx AS DOUBLE) AS x, CAST(gy AS DOUBLE) AS y FROM q UNION ALL SELECT gy, gx FROM q)) AS asortatividad FROM d LEFT JOIN tt USING (id)"""
)
def ego_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surroundings, two links wide, of the actor with most neighbours: size, leaves, triangles, clustering, assortativity."""
    p = graph.undirected(table(spark, sf_dir, "vinculo_2025"), "origen", "destino", "peso")
    s = graph.both_ways(p)
    center = s.where(F.col("id").startswith("DOC:")).groupBy("id").agg(F.count(F.lit(1)).alias("g")).orderBy(F.desc("g"), "id").limit(1).select(F.col("id").alias("centro"))
    near = s.join(F.broadcast(center), s["id"] == center["centro"]).select(F.col("other").alias("id"))
    second = s.join(near.distinct(), "id").select(F.col("other").alias("id"))
    n = near.unionByName(second).unionByName(center.select(F.col("centro").alias("id"))).distinct()
    e = p.join(n, p["a"] == n["id"], "left_semi").join(n, F.col("b") == n["id"], "left_semi")
    d = graph.degrees(e).select("id", F.col("grado").alias("g"))
    t = graph.triangles(e)
    tt = t.select(F.explode(F.array("x", "y", "z")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("t"))
    w = F.col("g") * (F.col("g") - 1) / 2.0
    each = d.join(tt, "id", "left").agg(
        F.count_if(F.col("g") == 1).alias("hojas"), F.max("g").alias("grado_max"), F.avg("g").alias("media"), F.count(F.lit(1)).alias("vertices"), (F.coalesce(F.sum("t"), F.lit(0)) / 3).cast("long").alias("triangulos"),
        casts.displayed(F.coalesce(F.try_divide(F.sum(F.coalesce("t", F.lit(0))).cast("double"), F.sum(w)), F.lit(0.0))).alias("transitividad"),
        casts.displayed(F.avg(F.when(F.col("g") < 2, 0.0).otherwise(F.coalesce("t", F.lit(0)) / w))).alias("agrupamiento"),
    )
    ends = e.join(d.select(F.col("id").alias("a"), F.col("g").alias("gx")), "a").join(d.select(F.col("id").alias("b"), F.col("g").alias("gy")), "b")
    ends = ends.select(F.explode(F.array(F.struct(F.col("gx").alias("x"), F.col("gy").alias("y")), F.struct(F.col("gy").alias("x"), F.col("gx").alias("y")))).alias("q"))
    r = ends.agg(casts.displayed(F.corr(F.col("q.x").cast("double"), F.col("q.y").cast("double"))).alias("asortatividad"))
    each = each.withColumns({"grado_medio": casts.displayed(F.col("media")), "hojas_parte": casts.displayed(F.col("hojas") / F.col("vertices"))}).drop("media", "vertices")
    kinds = n.agg(F.count_if(F.col("id").startswith("ENT:")).alias("compradores"), F.count_if(F.col("id").startswith("RL:")).alias("representantes"))
    weight = e.agg(F.sum("w").alias("peso"), F.max("w").alias("peso_max"))
    size = n.agg(F.count(F.lit(1)).alias("k")).crossJoin(e.agg(F.count(F.lit(1)).alias("m"))).select(casts.displayed(2.0 * F.col("m") / (F.col("k") * (F.col("k") - 1)), 6).alias("densidad"))
    first = near.agg(F.count_distinct("id").alias("vecinos"))
    center = center.crossJoin(kinds).crossJoin(weight).crossJoin(size).crossJoin(first)
    return center.crossJoin(n.agg(F.count(F.lit(1)).alias("nodos"))).crossJoin(e.agg(F.count(F.lit(1)).alias("aristas"))).crossJoin(each).crossJoin(r)


def _core_sql(pairs: str, k: int, rounds: int = 60) -> str:
    parts = [f"e0 AS MATERIALIZED (SELECT * FROM {pairs})"]
    for i in range(rounds):
        parts.append(f"d{i} AS MATERIALIZED (SELECT id FROM (SELECT a AS id FROM e{i} UNION ALL SELECT b FROM e{i}) GROUP BY id HAVING count(*) >= {k}), e{i + 1} AS MATERIALIZED (SELECT * FROM e{i} WHERE a IN (SELECT id FROM d{i}) AND b IN (SELECT id FROM d{i}))")
    return f"WITH {', '.join(parts)} SELECT a, b, w FROM e{rounds}"


@query(_core_sql(_PAIRS.format(where="tipo IN ('co_oferta', 'co_presentacion', 'integra') AND"), 3))
def dense_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges among actors that have at least three neighbours within the core."""
    v = table(spark, sf_dir, "vinculo_2025").where("tipo in ('co_oferta', 'co_presentacion', 'integra')")
    return graph.k_core(graph.undirected(v, "origen", "destino", "peso"), 3)


@query(
    f"""WITH p AS {AWARD_PAIRS}, d AS (SELECT id, count(*) AS g FROM {_SIDES('p')} GROUP BY 1), o AS (SELECT id, g, row_number() OVER (ORDER BY g DESC, id) AS i, sum(g) OVER (ORDER BY g DESC, id ROWS UNBOUNDED PRECEDING) AS s FROM d)
    SELECT g AS grado, max(i) AS actores, round(max(s) / CAST((SELECT sum(g) FROM d) AS DOUBLE) + 1e-7, 4) AS cuota FROM o GROUP BY g"""
)
def lorenz_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of all links held by the actors of at least each degree; ordered over degrees, not over actors."""
    g = graph.degrees(award_pairs(spark, sf_dir)).groupBy(F.col("grado")).agg(F.count(F.lit(1)).alias("k"))
    w = Window.orderBy(F.desc("grado")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    links = F.col("k") * F.col("grado")
    return g.select("grado", F.sum("k").over(w).alias("actores"), casts.displayed(F.sum(links).over(w).cast("double") / F.sum(links).over(whole)).alias("cuota"))


@query(
    f"""WITH {components_sql(AWARD_PAIRS, 'comp')}, gig AS (SELECT c FROM comp GROUP BY c ORDER BY count(*) DESC, c LIMIT 1), cer AS (SELECT id FROM comp WHERE c <> (SELECT c FROM gig)), {_TRI}, t AS (SELECT DISTINCT x AS id FROM (SELECT ut AS x FROM tri UNION ALL SELECT socio FROM tri)), c AS (SELECT DISTINCT x AS id FROM (SELECT origen AS x FROM vinculo_2025 WHERE tipo = 'comparte_contacto' UNION ALL SELECT destino FROM vinculo_2025 WHERE tipo = 'comparte_contacto') WHERE x IS NOT NULL),
    v AS (SELECT DISTINCT origen, destino FROM vinculo_2025 WHERE tipo = 'representado_por' AND origen IS NOT NULL AND destino IS NOT NULL), r AS (SELECT DISTINCT origen AS id FROM v WHERE destino IN (SELECT destino FROM v GROUP BY destino HAVING count(*) > 1))
    SELECT id_nodo, CAST(id_nodo IN (SELECT id FROM t) AS INTEGER) AS t, CAST(id_nodo IN (SELECT id FROM c) AS INTEGER) AS c, CAST(id_nodo IN (SELECT id FROM r) AS INTEGER) AS r, CAST(id_nodo IN (SELECT id FROM cer) AS INTEGER) AS a,
    (CAST(id_nodo IN (SELECT id FROM cer) AS INTEGER) + CAST(id_nodo IN (SELECT id FROM t) AS INTEGER) + CAST(id_nodo IN (SELECT id FROM c) AS INTEGER) + CAST(id_nodo IN (SELECT id FROM r) AS INTEGER)) / 4.0::DOUBLE AS senal FROM {base.ACTORS}"""
)
def red_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangle, shared contact, shared representative and closed component (not the giant one) of each actor, with their mean."""
    v = table(spark, sf_dir, "vinculo_2025")
    ends = lambda df, a, b: df.select(F.explode(F.array(a, b)).alias("id")).where("id is not null").distinct()
    t = ends(triangles(spark, sf_dir), "ut", "socio").withColumn("t", F.lit(1))
    c = ends(v.where("tipo = 'comparte_contacto'"), "origen", "destino").withColumn("c", F.lit(1))
    by = v.where("tipo = 'representado_por' and origen is not null and destino is not null").select("origen", "destino").distinct()
    many = by.groupBy("destino").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("destino")
    r = by.join(many, "destino", "left_semi").select(F.col("origen").alias("id")).distinct().withColumn("r", F.lit(1))
    a = base.actors(spark, sf_dir).select(F.col("id_nodo"), F.col("id_nodo").alias("id"))
    closed = labelled_components(award_pairs(spark, sf_dir)).where("not gigante").select("id", F.lit(1).alias("a"))
    out = a.join(t, "id", "left").join(c, "id", "left").join(r, "id", "left").join(closed, "id", "left").na.fill(0, ["t", "c", "r", "a"])
    return out.select("id_nodo", "t", "c", "r", "a", ((F.col("t") + F.col("c") + F.col("r") + F.col("a")) / 4.0).alias("senal"))


_CORE = f"SELECT destino AS id FROM vinculo_2025 WHERE tipo = 'integra' AND destino IS NOT NULL UNION SELECT origen FROM vinculo_2025 WHERE tipo = 'integra' AND origen IS NOT NULL UNION SELECT 'COD:' || codigo_proveedor FROM {base.BIDS} WHERE codigo_proveedor IS NOT NULL"


def core(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "vinculo_2025").where("tipo = 'integra'")
    members = v.select(F.explode(F.array("origen", "destino")).alias("id")).where("id is not null")
    bidding = base.bids(spark, sf_dir).where("codigo_proveedor is not null").select(F.concat(F.lit("COD:"), "codigo_proveedor").alias("id"))
    return members.unionByName(bidding).distinct()


@query(_CORE)
def network_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joint ventures, their members and all bidders."""
    return core(spark, sf_dir)


@query(
    f"""SELECT c.id_contrato FROM {base.CONTRACTS} c LEFT JOIN ({_CORE}) n ON n.id = 'COD:' || c.codigo_proveedor
    WHERE c.fecha_firma BETWEEN DATE '2025-01-01' AND DATE '2025-12-31' AND NOT (coalesce({SQL_NORM('c.tipo_de_contrato')}, '') = 'PRESTACION DE SERVICIOS' AND NOT coalesce(c.es_grupo, false) AND n.id IS NULL)"""
)
def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts of 2025, without service contracts of single suppliers outside the network core."""
    c = base.contracts(spark, sf_dir).where(F.col("fecha_firma").between(F.lit("2025-01-01").cast("date"), F.lit("2025-12-31").cast("date")))
    n = core(spark, sf_dir)
    c = c.join(n, n["id"] == F.concat(F.lit("COD:"), "codigo_proveedor"), "left")
    service = F.coalesce(text.normalised("tipo_de_contrato"), F.lit("")) == "PRESTACION DE SERVICIOS"
    return c.where(~(service & ~F.coalesce("es_grupo", F.lit(False)) & F.col("id").isNull())).select("id_contrato")


@query(
    f"""WITH a AS (SELECT DISTINCT id_portafolio, codigo_proveedor FROM {base.CONTRACTS} WHERE id_portafolio IS NOT NULL AND codigo_proveedor IS NOT NULL),
    b AS (SELECT id_del_proceso AS id_portafolio, codigo_proveedor, count(*) AS ofertas, CAST(min(valor_oferta) AS DOUBLE) AS menor FROM {base.BIDS} WHERE id_del_proceso IS NOT NULL AND codigo_proveedor IS NOT NULL GROUP BY 1, 2),
    k AS (SELECT id_portafolio, codigo_proveedor FROM a UNION SELECT id_portafolio, codigo_proveedor FROM b)
    SELECT id_portafolio, codigo_proveedor, b.ofertas IS NOT NULL AS con_oferta, a.id_portafolio IS NOT NULL AS adjudicado, coalesce(b.ofertas, 0) AS ofertas, menor
    FROM k LEFT JOIN a USING (id_portafolio, codigo_proveedor) LEFT JOIN b USING (id_portafolio, codigo_proveedor)"""
)
def participation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier by tender: bid, awarded, number of bids and lowest bid."""
    keys = ["id_portafolio", "codigo_proveedor"]
    a = base.contracts(spark, sf_dir).select(*keys).na.drop().distinct().withColumn("adjudicado", F.lit(True))
    b = base.bids(spark, sf_dir).withColumnRenamed("id_del_proceso", "id_portafolio").na.drop(subset=keys)
    b = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("ofertas"), F.min("valor_oferta").cast("double").alias("menor"))
    out = a.join(b, keys, "full_outer")
    return out.select(*keys, F.col("ofertas").isNotNull().alias("con_oferta"), F.coalesce("adjudicado", F.lit(False)).alias("adjudicado"), F.coalesce("ofertas", F.lit(0)).alias("ofertas"), "menor")


@query(
    f"""WITH b AS (SELECT id_del_proceso AS p, count(*) AS filas, count(DISTINCT codigo_proveedor) AS oferentes FROM {base.BIDS} WHERE id_del_proceso IS NOT NULL GROUP BY 1)
    SELECT p AS id_portafolio, filas, oferentes, oferentes BETWEEN 2 AND 100 AS apto FROM b"""
)
def process_competition(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base.bids(spark, sf_dir).where("id_del_proceso is not null").groupBy(F.col("id_del_proceso").alias("id_portafolio"))
    return b.agg(F.count(F.lit(1)).alias("filas"), F.count_distinct("codigo_proveedor").alias("oferentes")).withColumn("apto", F.col("oferentes").between(2, 100))


@query(
    f"""SELECT id_del_proceso FROM {base.TENDERS} p WHERE EXISTS (SELECT 1 FROM {base.CONTRACTS} c WHERE c.id_portafolio = p.id_portafolio)"""
)
def semi_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = base.contracts(spark, sf_dir).select("id_portafolio")
    return base.tenders(spark, sf_dir).join(c, "id_portafolio", "left_semi").select("id_del_proceso")


_TYPED = f"""a AS (SELECT 'adjudica' AS tipo, 'ENT:' || codigo_entidad AS origen, 'COD:' || codigo_proveedor AS destino, count(*) AS peso, CAST(sum(valor_del_contrato) AS DOUBLE) AS valor FROM {base.CONTRACTS} WHERE codigo_entidad IS NOT NULL AND codigo_proveedor IS NOT NULL GROUP BY ALL),
    s AS (SELECT 'se_presenta_a', 'COD:' || b.codigo_proveedor, 'ENT:' || p.codigo_entidad, count(*), NULL::DOUBLE FROM (SELECT DISTINCT id_del_proceso, codigo_proveedor FROM {base.BIDS}) b
      JOIN (SELECT DISTINCT id_portafolio, codigo_entidad FROM {base.TENDERS}) p ON p.id_portafolio = b.id_del_proceso WHERE p.codigo_entidad IS NOT NULL AND b.codigo_proveedor IS NOT NULL GROUP BY ALL),
    r AS (SELECT DISTINCT 'representado_por', id_nodo, 'RL:' || {SQL_DOCUMENT('doc_rep_legal')}, 1, NULL::DOUBLE FROM {base.ACTORS} WHERE {SQL_DOCUMENT('doc_rep_legal')} IS NOT NULL)"""


@query(f"WITH {_TYPED} SELECT * FROM a UNION ALL SELECT * FROM s UNION ALL SELECT * FROM r")
def typed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Awards, bids and representations as one edge list with prefixed ids."""
    ent, cod = (lambda c: F.concat(F.lit("ENT:"), c)), (lambda c: F.concat(F.lit("COD:"), c))
    none = F.lit(None).cast("double").alias("valor")
    c = base.contracts(spark, sf_dir).where("codigo_entidad is not null and codigo_proveedor is not null")
    a = c.groupBy("codigo_entidad", "codigo_proveedor").agg(F.count(F.lit(1)).alias("peso"), F.sum("valor_del_contrato").cast("double").alias("valor"))
    a = a.select(F.lit("adjudica").alias("tipo"), ent("codigo_entidad").alias("origen"), cod("codigo_proveedor").alias("destino"), "peso", "valor")
    p = base.tenders(spark, sf_dir).where("id_portafolio is not null and codigo_entidad is not null").select(F.col("id_portafolio").alias("p"), "codigo_entidad").distinct()
    s = bidders(spark, sf_dir).join(p, "p").groupBy("s", "codigo_entidad").agg(F.count(F.lit(1)).alias("peso"))
    s = s.select(F.lit("se_presenta_a").alias("tipo"), cod("s").alias("origen"), ent("codigo_entidad").alias("destino"), "peso", none)
    r = base.actors(spark, sf_dir).select("id_nodo", text.valid_document("doc_rep_legal").alias("d")).where("d is not null").distinct()
    r = r.select(F.lit("representado_por").alias("tipo"), F.col("id_nodo").alias("origen"), F.concat(F.lit("RL:"), "d").alias("destino"), F.lit(1).cast("long").alias("peso"), none)
    return a.unionByName(s).unionByName(r)


@query(
    f"""WITH d AS (SELECT codigo_proveedor FROM {base.CONTRACTS} WHERE codigo_proveedor IS NOT NULL UNION SELECT codigo_proveedor FROM {base.BIDS} WHERE codigo_proveedor IS NOT NULL)
    SELECT n.id_nodo FROM {base.ACTORS} n JOIN d USING (codigo_proveedor) UNION SELECT destino FROM vinculo_2025 v JOIN (SELECT DISTINCT n.id_nodo FROM {base.ACTORS} n JOIN d USING (codigo_proveedor)) x ON x.id_nodo = v.origen WHERE tipo = 'integra' AND destino IS NOT NULL"""
)
def node_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actors with contracts or bids, and the members of those that are joint ventures."""
    d = base.contracts(spark, sf_dir).select("codigo_proveedor").unionByName(base.bids(spark, sf_dir).select("codigo_proveedor")).na.drop()
    own = base.actors(spark, sf_dir).join(d, "codigo_proveedor", "left_semi").select("id_nodo").distinct()
    v = table(spark, sf_dir, "vinculo_2025").where("tipo = 'integra' and destino is not null")
    members = v.join(own, v["origen"] == own["id_nodo"], "left_semi").select(F.col("destino").alias("id_nodo"))
    return own.unionByName(members).distinct()


@query(
    """SELECT paso, n FROM (SELECT 1 AS i, 'todas' AS paso, count(*) AS n FROM contratos UNION ALL SELECT 2, 'contratos', count(DISTINCT id_contrato) FROM contratos
    UNION ALL SELECT 3, 'de 2025', count(DISTINCT id_contrato) FROM contratos WHERE year(fecha_firma) = 2025 UNION ALL SELECT 4, 'con valor', count(DISTINCT id_contrato) FROM contratos WHERE year(fecha_firma) = 2025 AND valor_del_contrato > 0)"""
)
def scope_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left after each filter, from one pass."""
    c = table(spark, sf_dir, "contratos")
    now = F.year("fecha_firma") == 2025
    one = c.agg(
        F.count(F.lit(1)).alias("todas"), F.count_distinct("id_contrato").alias("contratos"), F.count_distinct(F.when(now, F.col("id_contrato"))).alias("de 2025"),
        F.count_distinct(F.when(now & (F.col("valor_del_contrato") > 0), F.col("id_contrato"))).alias("con valor"),
    )
    return one.unpivot([], ["todas", "contratos", "de 2025", "con valor"], "paso", "n")


@query(f"SELECT codigo_entidad, count(*) AS n, CAST(sum(valor_del_contrato) AS DOUBLE) AS valor FROM {base.CONTRACTS} WHERE codigo_entidad IS NOT NULL GROUP BY 1 ORDER BY n DESC, codigo_entidad LIMIT 10")
def top_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = base.contracts(spark, sf_dir).where("codigo_entidad is not null").groupBy("codigo_entidad").agg(F.count(F.lit(1)).alias("n"), F.sum("valor_del_contrato").cast("double").alias("valor"))
    return c.orderBy(F.desc("n"), "codigo_entidad").limit(10)
