"""A corpus pipeline: language, repeated lines, near copies, benchmark passages, packing.

Each stage takes what the one before has kept, as Parquet, and all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.llm.common import release, shared_path, written
from symgraph.llm.decontam import without_leaks
from symgraph.llm.lang_crf import in_language
from symgraph.llm.line_dedup import line_dedup
from symgraph.llm.packing import pack
from symgraph.llm.passages import without_passages
from symgraph.llm.simhash import one_of_each


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language, which becomes their `lang`; texts without one go."""
    release(spark)
    return in_language(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines, then of 51 words or more anywhere, are cut out of texts; `n_chars` follows; texts of which nothing is left go."""
    release(spark)
    out = written(line_dedup(docs, "__lines", "__removed"), "without-lines")
    out = without_passages(out, "__words")
    out = out.where(F.col("text").isNull() | (F.col("text") != "") | ((F.col("__removed") == 0) & (F.col("__words") == 0)))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, of similarity 0.8 or more by five-word shingles, stays."""
    release(spark)
    return one_of_each(docs, words=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    release(spark)
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    release(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("decontamination", decontamination), ("packing", packing)]

#: No SQL: the language model and the tokenizer are not expressible; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over `documents`, each written and read again.

    Every stage frees the working tables of the one before, so the stages' own results are not among those.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        path = shared_path(spark, f"stage-{name}", held=False)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
