"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillet.plans import Dynamic, Static
from quillet.queries import queries
from quillet.schema import Schema
from quillet.sources import reader, writer

SF_DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
HEADLINE = ("encode_cell", "write_lines_static", "roundtrip_static", "roundtrip_quoted", "header_reorder", "comments_interleaved", "extra_column_include", "dynamic_get", "dynamic_to_struct", "parse_int", "parse_double", "parse_datetime", "strict_read", "stitched_records", "files_large", "dynamic_write_maps")
#: Rows and columns of the wide-row read and write.
WIDE_ROWS, WIDE_COLUMNS = 200_000, 36


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes", "16m")
        # the JVM does not compile methods beyond this size: rather one projection after the other
        .config("spark.sql.codegen.hugeMethodLimit", "8000").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(df) -> float:
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - began


def wide(spark: SparkSession) -> dict[str, float]:
    """Typed and untyped reading, and writing, of wide rows in memory, as rows a second."""
    kinds = [("int", "long", "double", "string", "bool", "datetime")[i % 6] for i in range(WIDE_COLUMNS)]
    value = {"int": F.col("id").cast("int"), "long": F.col("id") * 977, "double": F.col("id") / 8, "string": F.concat(F.lit('a "b", '), "id"), "bool": F.col("id") % 2 == 0, "datetime": F.timestamp_seconds(F.col("id") * 60)}
    schema = Schema.of(**{f"c{i}": k for i, k in enumerate(kinds)})
    rows = spark.range(0, WIDE_ROWS, 1, 64).select("id", *(value[k].alias(f"c{i}") for i, k in enumerate(kinds))).cache()
    rows.count()
    texts = writer.to_text(rows.withColumn("part", F.floor(F.col("id") / 500)), schema, ["id"], group=["part"]).select(F.col("part").cast("string").alias("source"), "text").repartition(64).cache()
    texts.count()
    out = {"wide_write": timed(writer.lines(rows, schema).select("line")), "wide_read_static": timed(Static(schema).read(texts)), "wide_read_dynamic": timed(Dynamic().read(texts)), "wide_records": timed(reader.read_records(texts))}
    rows.unpersist()
    texts.unpersist()
    return out


def main() -> None:
    spark, times = session(), {}
    known = queries()
    for name in HEADLINE:
        known[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()  # compiled and read once
        times[name] = round(timed(known[name](spark, SF_DIR)), 3)
    wide(spark)
    times |= {k: round(v, 3) for k, v in wide(spark).items()}
    rates = {f"{k}_rows_per_sec": round(WIDE_ROWS / times[k]) for k in ("wide_write", "wide_read_static", "wide_read_dynamic")}
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(re.sub(r".*sf", "", SF_DIR) or 0), "rates": rates}))


if __name__ == "__main__":
    main()
