"""Queries of the training-data problems, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caudal.llm import bpe, components, langid, mixing, names, survivors
from caudal.session import Stages, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


_ID = "upper(trim({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(160)))"
_GROUPS = f"""WITH RECURSIVE x AS (SELECT {_ID.format(c='unique_id_l')} AS l, {_ID.format(c='unique_id_r')} AS r FROM pares WHERE match_probability >= 0.95 AND NOT isnan(match_probability)),
    s AS MATERIALIZED (SELECT l AS id, r AS other FROM x WHERE l <> '' AND r <> '' AND l <> r UNION SELECT r, l FROM x WHERE l <> '' AND r <> '' AND l <> r),
    t(id, c) AS (SELECT DISTINCT id, id FROM s UNION SELECT s.other, t.c FROM t JOIN s USING (id) WHERE t.c < s.other), g AS (SELECT id AS id_nodo, min(c) AS id_grupo FROM t GROUP BY id)"""
SQL["p2_found"] = f"{_GROUPS} SELECT id_nodo, id_grupo FROM g"
SQL["p2_groups"] = f"{_GROUPS}, n AS (SELECT DISTINCT {_ID.format(c='id_nodo')} AS id_nodo FROM nodos WHERE id_nodo IS NOT NULL) SELECT id_nodo, coalesce(id_grupo, id_nodo) AS id_grupo FROM n FULL JOIN g USING (id_nodo)"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = components.consolidate(
        table(spark, sf_dir, "pares"), "unique_id_l", "unique_id_r", "match_probability", 0.95
    )
    return groups.select(F.col("id").alias("id_nodo"), F.col("group").alias("id_grupo"))


@query
def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of ``nodos`` and every linked id with its group; unlinked records are groups of one."""
    groups = components.consolidate(
        table(spark, sf_dir, "pares"),
        "unique_id_l",
        "unique_id_r",
        "match_probability",
        0.95,
        table(spark, sf_dir, "nodos"),
        "id_nodo",
    )
    return groups.select(F.col("id").alias("id_nodo"), F.col("group").alias("id_grupo"))


#: Vocabulary file of the public tokenizer; set CAUDAL_TOKENIZER where it lies elsewhere.
TOKENIZER = os.environ.get("CAUDAL_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")


@query
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode(table(spark, sf_dir, "documents"), "text", ["doc_id"], TOKENIZER)


def _mixed(spark: SparkSession, sf_dir: str, whole_corpus: bool = False) -> tuple[DataFrame, DataFrame]:
    sized = bpe.encode(table(spark, sf_dir, "documents"), "text", ["doc_id", "source"], TOKENIZER, None, "n_tokens")
    sized = Stages(spark, "mix").cut(sized, "sized")
    total = sized.agg(F.sum("n_tokens")).first()[0] or 0 if whole_corpus else None
    plan = mixing.plan(sized, table(spark, sf_dir, "mezcla_objetivo"), total)
    return mixing.mix(sized, "doc_id", plan), plan


@query
def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and repetitions of the largest mix that meets the target weights."""
    return _mixed(spark, sf_dir)[0]


@query
def p7_mix_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and repetitions of a mix as large as the corpus: sources at their cap are clamped, others take over."""
    return _mixed(spark, sf_dir, True)[0]


@query
def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source in that mix."""
    return mixing.shares(*_mixed(spark, sf_dir))


@query
def p7_shares_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a mix as large as the corpus, in which small sources reach their cap and others take over."""
    return mixing.shares(*_mixed(spark, sf_dir, True))


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", "codigo_entidad", "source")


@query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing and wrong labels with the right language, and the languages of mixed texts."""
    return langid.label_cases(_languages(spark, sf_dir), "doc_id")


@query
def p8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every document."""
    return _languages(spark, sf_dir).select("doc_id", "declarada", "lang", "confianza")


@query
def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every passage, with its place in the text."""
    return _languages(spark, sf_dir).select("doc_id", F.posexplode("pasajes").alias("pasaje", "p")).select("doc_id", "pasaje", "p.*")


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records whose differently written names mean the same buyer or person."""
    buyers = names.variant_pairs(names.link_buyers(table(spark, sf_dir, "entidades")))
    people = names.variant_pairs(names.link_representatives(table(spark, sf_dir, "nodos")))
    fields = lambda df, f: df.select(F.lit(f).alias("campo"), "clave_a", "clave_b")
    return fields(buyers, "nombre_entidad").unionByName(fields(people, "nombre_rep_legal"))


@query
def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every named record with the group of its name."""
    buyers = names.link_buyers(table(spark, sf_dir, "entidades")).withColumn("campo", F.lit("nombre_entidad"))
    people = names.link_representatives(table(spark, sf_dir, "nodos")).withColumn("campo", F.lit("nombre_rep_legal"))
    return buyers.unionByName(people).select("campo", "clave", "nivel", "grupo")


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code, NIT and number of contracts of each buyer that stands under several codes."""
    entities = table(spark, sf_dir, "entidades")
    return survivors.chosen_buyers(entities, names.link_buyers(entities))


@query
def p1_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record built for each such buyer from the most probable values, with their probabilities."""
    entities = table(spark, sf_dir, "entidades")
    return survivors.surviving_buyers(entities, names.link_buyers(entities))
