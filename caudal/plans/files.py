"""Round trips through the readers, writers and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caudal.plans.registry import query
from caudal.session import Stages, table
from caudal.sources import readers, sinks
from caudal.streaming import ingest

OFFERS = readers.Dataset(
    {"id_oferta": ("ID Oferta", "text"), "id_del_proceso": ("ID Proceso", "text"), "fecha_registro": ("Fecha", "date"), "valor_oferta": ("Valor", "decimal"), "invitacion_directa": ("Invitacion", "boolean")},
    ("id_oferta",),
)
_SENTINELS = "('NO DEFINIDO', 'NO PROVISTO', 'NO APLICA', 'NO ADJUDICADO', 'SIN DESCRIPCION', 'SIN DESCRIPCIÓN', 'NO INFORMADO', 'N/A', 'NA', '-', '')"
_TEXT = lambda c: f"CASE WHEN upper(trim({c})) NOT IN {_SENTINELS} THEN trim({c}) END AS {c}"
_OFFERS = f"SELECT {_TEXT('id_oferta')}, {_TEXT('id_del_proceso')}, strftime(fecha_registro, '%Y-%m-%d') AS fecha_registro, CAST(valor_oferta AS DOUBLE) AS valor_oferta, invitacion_directa FROM ofertas"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "ofertas")
    flag = F.when(F.col("invitacion_directa"), "Si").when(~F.col("invitacion_directa"), "No")
    return o.select(
        F.col("id_oferta").alias("ID Oferta"), F.col("id_del_proceso").alias("ID Proceso"), F.concat(F.col("fecha_registro").cast("string"), F.lit("T00:00:00")).alias("Fecha"),
        F.concat(F.lit("$"), F.format_number("valor_oferta", 2)).alias("Valor"), flag.alias("Invitacion"), F.lit("x").alias("Otra"),
    )


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("fecha_registro", F.col("fecha_registro").cast("string")).withColumn("valor_oferta", F.col("valor_oferta").cast("double"))


@query(_OFFERS)
def ndjson_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bids written as lines of JSON and read through a declared schema."""
    path = f"{Stages(spark, 'files').root}/ndjson"
    _raw(spark, sf_dir).write.json(path)
    return _shown(readers.read_ndjson(spark, path, OFFERS))


@query(_OFFERS)
def parquet_union_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through two Parquet tables whose columns come in another order."""
    root = Stages(spark, "files").root
    raw = _raw(spark, sf_dir)
    first = F.pmod(F.xxhash64("ID Oferta", "ID Proceso"), F.lit(2)) == 0
    sinks.write_parquet(raw.where(first), f"{root}/a")
    sinks.write_parquet(raw.where(~first).select(*reversed(raw.columns)), f"{root}/b", rows_per_file=100_000)
    return _shown(readers.read_parquets(spark, [f"{root}/a", f"{root}/b"]).select(*OFFERS.projection()))


@query("SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS dia, count(*) AS n FROM events GROUP BY ALL")
def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events taken in by a stream that ends when all files are read, counted by day."""
    root = f"{Stages(spark, 'stream').root}/{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    ingest.ingest(spark, sf_dir, schema, "parquet", f"{root}/table", f"{root}/state", "events.parquet")
    counts = ingest.windowed_counts(spark.read.schema(schema).parquet(f"{root}/table"), "ts", "event_type", "1 day", "1 day")
    return counts.select("event_type", F.date_format("desde", "yyyy-MM-dd").alias("dia"), "n")
