"""Corpus pipeline: documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``, which has the columns of the
documents table: doc_id, text, lang, source, n_chars. All but the last return those columns; each
result is written and read again before the next stage. Null texts count as empty throughout.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.bpe import bpe_encode
from cadenza.llm.common import row_key, stored
from cadenza.llm.language_id import language_id
from cadenza.llm.line_dedup import line_dedup
from cadenza.llm.mixing import mix_sources, with_topic
from cadenza.llm.near_dedup import near_dedup
from cadenza.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in no language, or in none clearly, go; ``lang`` becomes the language found."""
    learn = F.col("lang").isNotNull()
    found = language_id(docs, learn, ambiguous_below=0.02, keep=[F.col(c) for c in COLUMNS if c not in ("lang", "text")], with_text=True)
    return found.where("lang_pred <> 'und' AND NOT ambiguous").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go, however short, documents that lose all their words with them."""
    left = line_dedup(docs, least_words=1).withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return left.where(r"n_dropped = 0 OR text RLIKE '[^\\x20\\x09-\\x0D]'").select(*COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """Decisions are about rows, whose ids may be null or repeated: a key of id and text joins them back."""
    k1, k2 = row_key("doc_id", "text")
    return docs.withColumns({"_k1": k1, "_k2": k2})


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates at five words and 0.8, the least id stays; of several texts with that id, or without any id, one."""
    kept = near_dedup(docs, with_key=True).where("leader").select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"))
    return _keyed(docs).join(kept, ["_k1", "_k2"], "left_semi").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources, languages and topics are brought to tempered token shares; seven tenths of the tokens stay, or as much less as the shares take."""
    cells = stored(with_topic(_keyed(docs), keep=("doc_id", "source", "lang", "_k1", "_k2")), "topics")
    kept = mix_sources(cells, keep_share=0.7).select("_k1", "_k2")
    return _keyed(docs).join(kept, ["_k1", "_k2"], "left_semi").select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (u32, little-endian), ids_sha256, decoded_sha256."""
    return bpe_encode(docs, tokenizer_path("word_bpe_49k.json"), keep=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("bpe", encoding_stage),
]
#: SQL expresses neither the classifier nor the raking; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
