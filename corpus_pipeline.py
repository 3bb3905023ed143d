"""The corpus pipeline: documents through five operators, one table after another.

Every stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and
returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.llm.bpe import encode_decode
from tidewright.llm.common import cut, drop
from tidewright.llm.decontaminate import FIELDS, scan_documents
from tidewright.llm.exact_dedup import exact_duplicates
from tidewright.llm.language_id import UNKNOWN, held_out, identify, learn
from tidewright.llm.near_dedup import near_duplicates
from tidewright.llm.queries import tokenizer_path


def _own(docs: DataFrame, new: set[str]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns named as in ``new`` out of the way, and the columns that give ``docs`` back."""
    moved = {c: f"_own{k}_{c}" for k, c in enumerate(docs.columns) if c in new}
    return docs.withColumnsRenamed(moved), [F.col(moved.get(c, c)).alias(c) for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; null texts and texts without a letter go, and all if no row has a language.

    Every row is judged by itself, so repeated rows stay; null ids and languages do too.  Extra columns pass, also
    those that have the names of the operator's.
    """
    free, own = _own(docs, {"lang_pred", "score"})
    named = identify(free, learn(docs.where(~held_out("doc_id"))))
    return named.where(F.col("lang_pred") != UNKNOWN).select(*own)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, with the least id (an id beats a null one).

    Null counts as the empty text, so one row of all null and empty texts stays.  Of rows of one id whose texts are
    equal but for white space the least row stays, in the order of the columns, nulls first.  Extra columns pass.
    """
    free, own = _own(docs, {"_name", "_place", "_h"})
    # the operator's text_sha256, and with it the id: rows of one name are repeats
    digest = F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)
    name = lambda digest: F.concat_ws(" ", digest, F.col("doc_id").cast("string")).alias("_name")
    place = Window.partitionBy("_name").orderBy(*free.columns)
    once = free.select("*", name(digest)).withColumn("_place", F.row_number().over(place)).where("_place = 1")
    marked = exact_duplicates(docs).where("kept").select(name(F.col("text_sha256")))
    return once.join(marked, "_name", "left_semi").select(*own)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of one document of each group of near copies, the one with the least id.

    Rows of one id are one document and share its fate; those without words (null, empty or blank texts) are linked
    with nothing and stay.  Rows with a null id stay.  Extra columns pass.
    """
    free, own = _own(docs, {"_bare"})
    bare = ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    judged = near_duplicates(docs).where("kept and doc_id is not null")
    marked = judged.select("doc_id", (F.col("n_shingles") == 0).alias("_bare")).distinct()
    left = free.withColumn("_bare", bare).join(marked, ["doc_id", "_bare"], "left_semi").select(*own)
    return left.unionByName(docs.where("doc_id is null"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passages, by the operator's rule.

    Every row is judged by itself: null and empty texts and all rows beside an empty benchmark stay, and so do
    repeated rows.  Extra columns pass, also those that have the names of the operator's.
    """
    free, own = _own(docs, {f.name for f in FIELDS})
    found = scan_documents(free, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~F.col("contaminated")).select(*own)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document's token ids, and the digests of ids and decoded text.

    Null counts as the empty text, which has no ids.  One row in, one row out.  Extra columns go; of those with the
    result's names the operator's values count.
    """
    coded = encode_decode(docs, tokenizer_path("byte_bpe_50k.json"), with_text=False)
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: Cross-parsing and byte-pair merges have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table before the next stage, and goes when the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
            if before is not None:
                drop(before)
            before = docs
    return docs
