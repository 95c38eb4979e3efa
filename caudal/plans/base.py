"""The cleaned tables that the other plans start from, as frames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caudal.operators.references import first_delivery, levelled_reference
from caudal.session import table

CONTRACT = ["codigo_entidad", "codigo_proveedor", "id_portafolio", "nombre_rep_legal", "tipo_de_contrato", "modalidad_de_contratacion", "fecha_firma", "fecha_inicio", "fecha_fin", "valor_del_contrato", "dias_adicionados", "es_grupo"]
TENDER = ["id_portafolio", "codigo_entidad", "codigo_proveedor", "fecha_publicacion", "precio_base", "proveedores_unicos_respuesta", "adjudicado", "modalidad_de_contratacion"]
BID = ["id_del_proceso", "codigo_proveedor", "fecha_registro", "valor_oferta"]
SUPPLIER = ["nombre_proveedor", "nit_proveedor", "es_grupo", "tipo_empresa", "departamento", "correo", "telefono", "fecha_creacion"]
BUYER = ["nit_entidad", "nombre_entidad", "orden_entidad", "departamento", "ciudad", "n_contratos_hist", "n_procesos_hist"]
NODE = ["documento", "nombre", "tipo_nodo", "codigo_proveedor", "nombre_rep_legal", "doc_rep_legal", "departamento", "ciudad", "correo", "telefono", "ciiu1", "fecha_matricula"]
REFERENCES = {"codigo_entidad", "codigo_proveedor", "id_portafolio", "id_del_proceso"}


def _frame(spark: SparkSession, sf_dir: str, name: str, key: str, columns: list[str]) -> DataFrame:
    first = first_delivery(table(spark, sf_dir, name), key, "fecha_carga", columns)
    return first.select(key, "fecha_carga", *[levelled_reference(F.col(c)).alias(c) if c in REFERENCES and c != key else c for c in columns])


def _sql(name: str, key: str, columns: list[str]) -> str:
    ref = lambda c: f"CASE WHEN regexp_matches({c}, '[0-9]') THEN upper(trim({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) END AS {c}"
    out = ", ".join(ref(c) if c in REFERENCES and c != key else c for c in columns)
    order = ", ".join(f"{c} NULLS FIRST" for c in columns)
    return f"(SELECT {key}, fecha_carga, {out} FROM (SELECT * FROM {name} WHERE {key} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY fecha_carga NULLS LAST, {order}) = 1))"


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, sf_dir, "contratos", "id_contrato", CONTRACT)


def tenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, sf_dir, "procesos", "id_del_proceso", TENDER)


def bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, sf_dir, "ofertas", "id_oferta", BID)


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, sf_dir, "proveedores", "codigo_proveedor", SUPPLIER)


def buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, sf_dir, "entidades", "codigo_entidad", BUYER)


def actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, sf_dir, "nodos", "id_nodo", NODE)


CONTRACTS = _sql("contratos", "id_contrato", CONTRACT)
TENDERS = _sql("procesos", "id_del_proceso", TENDER)
BIDS = _sql("ofertas", "id_oferta", BID)
SUPPLIERS = _sql("proveedores", "codigo_proveedor", SUPPLIER)
BUYERS = _sql("entidades", "codigo_entidad", BUYER)
ACTORS = _sql("nodos", "id_nodo", NODE)
