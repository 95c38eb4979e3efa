"""Files that keep arriving, as streams that end when all present ones are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def ingest(spark: SparkSession, folder: str, schema: StructType, fmt: str, out: str, state: str, glob: str | None = None, files_per_batch: int = 1000) -> None:
    """Appends files not yet read to the table ``out``; ``state`` remembers them, so a run can be repeated or resumed."""
    reader = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    q = reader.load(folder).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def windowed_counts(events: DataFrame, time: str, by: str, size: str, late: str) -> DataFrame:
    """Counts of each window and key; rows later than ``late`` are left out when the frame is a stream."""
    w = F.window(time, size)
    return events.withWatermark(time, late).groupBy(w, by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("desde"), by, "n")
