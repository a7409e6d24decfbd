"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read again as the next one's input.

language_id       documents go whose language is undetermined or predicted with a score under ``MIN_SCORE``
ngram_join        of documents linked by similar shingle sets, the one with the smallest doc_id stays
decontamination   documents go of whose words a twentieth or more lies in windows of the benchmark
pii               personal data in the text gives way to its kind in brackets; n_chars follows
pieces            the ids of the text, their number, and whether they decode to the text

All but the last return the columns of their input, extra ones too. In the second stage each different row is looked at by
itself, whatever its doc_id: rows that share an id, or have none, go only with a group of similar texts. Of a group the row with the smallest doc_id stays, null
after all others, and of rows that share it the one with the smallest hash; rows equal in all columns are one. Null texts go in the first stage. The
last stage's own columns (ids, n_ids, round_trip) replace any of those names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.llm.common import if_small, stage
from quillet.llm.decontam import find_contamination, summary
from quillet.llm.langid import UNDETERMINED, fit, identify
from quillet.llm.ngram_join import jaccard_components
from quillet.llm.pieces import encode
from quillet.llm.pii import find_pii

MIN_SCORE = 0.5
#: The name of a stage's own column: unlike any of a table's.
_OWN = "__stage__"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = identify(docs, fit(docs), into=_OWN)
    return found.where((F.col(f"{_OWN}.lang") != UNDETERMINED) & (F.col(f"{_OWN}.score") >= MIN_SCORE)).drop(_OWN)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # a row's name is what it holds: rows of one name are equal
    row = F.xxhash64(*(F.col(c) for c, kind in docs.dtypes if "map<" not in kind))
    named = docs.withColumn(_OWN, row)
    found = jaccard_components(named, key=_OWN).select(_OWN, "component_id").distinct()
    best = named.select(_OWN, F.struct(F.col("doc_id").isNull(), "doc_id", _OWN).alias("order")).groupBy(_OWN).agg(F.min("order").alias("order"), F.count(F.lit(1)).alias("rows"))
    best = best.join(found, _OWN).groupBy("component_id").agg(F.min(F.struct("order", "rows")).alias("best"))
    kept = stage(best.select(F.col(f"best.order.{_OWN}").alias(_OWN), F.col("best.rows").alias("rows")), "kept")
    # texts stay where they are, but for those of equal rows, of which one is left
    once, often = (named.join(if_small(stage(kept.where(f"rows {x} 1").select(_OWN), "names")), _OWN, "left_semi") for x in "=>")
    return once.union(often.dropDuplicates([_OWN])).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), into=_OWN)
    return found.where(~summary(F.col(_OWN))["contaminated"]).drop(_OWN)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = find_pii(docs, into=_OWN, redacted="text").drop(_OWN)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = docs.drop("ids", "n_ids", "round_trip")
    found = encode(docs, model, into="ids", check="round_trip")
    return found.select(*docs.columns, "ids", F.size("ids").cast("long").alias("n_ids"), "round_trip")


STAGES = [("language_id", language_id), ("ngram_join", ngram_join), ("decontamination", decontamination), ("pii", pii), ("pieces", pieces)]

#: Classifiers, bootstrapping and pieces can't be said in SQL: tests hold the rows against plainer code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
