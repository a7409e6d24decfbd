"""Reading and writing as Structured Streaming: files are read as they arrive, rows written batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillet.options import DEFAULT, DYNAMIC_DEFAULT, ENDINGS, Options
from quillet.schema import Schema
from quillet.sources import reader, writer


def text_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """(source, text) of files as they arrive, each a whole text."""
    files = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_per_batch).load(path)
    return files.select(F.input_file_name().alias("source"), F.regexp_replace("value", "^\ufeff", "").alias("text"))


def read_static_stream(spark: SparkSession, path: str, schema: Schema, o: Options = DEFAULT) -> DataFrame:
    return reader.read_static(text_stream(spark, path), schema, o)


def read_dynamic_stream(spark: SparkSession, path: str, o: Options = DYNAMIC_DEFAULT) -> DataFrame:
    return reader.read_dynamic(text_stream(spark, path), o)


def write_stream(df: DataFrame, schema: Schema, path: str, checkpoint: str, o: Options = DEFAULT, once: bool = True) -> StreamingQuery:
    """Each batch goes to a folder of its own under ``path``, so that a batch that is done again replaces itself. ``stop()`` cancels."""

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.select(writer.line(schema, o).alias("value"))
        rows = writer._with_header(rows, writer.header_line(schema.names, o), o.write_header)
        rows.write.mode("overwrite").text(f"{path}/batch={number}", lineSep=ENDINGS[o.write_ending])

    stream = df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()
