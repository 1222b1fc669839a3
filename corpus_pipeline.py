"""A corpus run: quality, near duplicates, decontamination, mixing, token output.

Every stage is a function of (spark, docs, sf_dir). All but the last return the
columns of ``documents``; each is written and read again before the next starts.
Ids name documents: rows that repeat an id stay or go together. Columns beside
those of ``documents`` are dropped at once, whatever their names. A null text is
an empty one: it is scored, links with nothing, holds no item, has no words to
mix (so it goes there) and codes as the end id alone. Very long texts are worked
on whole. Ties go to the smallest id. Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.cotrain import fit_quality, with_quality
from freshet.llm.decontam import drop_contaminated
from freshet.llm.mixing import WEIGHTS, mix
from freshet.llm.ngram_join import jaccard_components
from freshet.llm.scratch import Scratch
from freshet.llm.tokenbin import token_output

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    docs = docs.select(COLUMNS)
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_quality(docs, model).where("accepted").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each component of the n-gram join."""
    docs = docs.select(COLUMNS)
    kept = jaccard_components(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = kept.select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    docs = docs.select(COLUMNS)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, by target weights, once each; a text that a budget cuts ends there."""
    docs = docs.select(COLUMNS)
    chosen = mix(docs, share_num=9, share_den=10, max_epochs=1, seed=20, weights=WEIGHTS)
    chosen = chosen.groupBy(F.col("doc_id").alias("chosen_id")).agg(F.max("taken").alias("taken"), F.max("n_tokens").alias("whole"))
    found = docs.join(chosen, F.col("doc_id").eqNullSafe(F.col("chosen_id")))
    space = r"\x20\x09-\x0D"
    pattern = F.concat(F.lit(rf"^(?:[{space}]*+[^{space}]++){{0,"), F.col("taken").cast("string"), F.lit("}+"))
    text = F.when(F.col("taken") < F.col("whole"), F.regexp_substr("text", pattern)).otherwise(F.col("text"))
    cut = F.when(F.col("taken") < F.col("whole"), F.char_length("new").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("new", text).select("doc_id", F.col("new").alias("text"), "lang", "source", cut.alias("n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token shards of what is left, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_output(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mixed),
    ("tokens", tokens),
]

#: Neither the classifier nor the tokenizer can be stated in SQL; tests hold each stage and the run against brute force,
#: the classifier's against its own model applied row by row.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
