"""The registered queries of this subpackage and the SQL that gives their rows, where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_dedup as lines
from . import warc
from .decontam import leaks
from .exact_dedup import exact_dedup
from .lang_crf import identify
from .packing import pack
from .pii import key_of, pseudonymized
from .simhash import near_groups
from .suffix_dedup import suffix_dedup
from .toxicity import score


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents")).drop("kept")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "documents"), words=4, most_bits=4)


def op4_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.line_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op7_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymized(_table(spark, sf_dir, "documents"), key_of(spark)).select("doc_id", "text", "n_found", "n_replaced")


def op10_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.with_place(warc.archive_pages(_table(spark, sf_dir, "pages")))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "place")


QUERIES = {"op1_language_crf": op1_language_crf, "op2_suffix_dedup": op2_suffix_dedup, "op3_simhash_near_dedup": op3_simhash_near_dedup, "op4_mixture_packing": op4_mixture_packing, "op5_line_dedup": op5_line_dedup, "op6_exact_dedup": op6_exact_dedup, "op7_qgram_decontamination": op7_qgram_decontamination, "op8_toxicity_cnn": op8_toxicity_cnn, "op9_feistel_pseudonyms": op9_feistel_pseudonyms, "op10_warc_index": op10_warc_index}

ORACLE_SQL = {
    "op10_warc_index": warc.ORACLE,
    "op5_line_dedup": lines.ORACLE,
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
}
