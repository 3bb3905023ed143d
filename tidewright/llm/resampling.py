"""Quality classifier by importance resampling.

Texts are bags of hashed words and word pairs.  Two generative models, each a
smoothed distribution over the hash buckets, describe the target (documents
labelled good) and the raw corpus (all documents).  A document's log weight is
the sum of log(target / raw) over its n-grams; adding Gumbel noise and taking
the top k draws k documents without replacement by those weights.

The cut-off of the top k is found by counting: keys become order-preserving
integers, and 16 bits at a time the bucket that holds the k-th key is found
from grouped counts, so nothing is sorted or gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm.common import annotate, cut, small_batches
from tidewright.llm.words import batches, mix, times, word_hashes

BUCKETS = 1 << 16
#: Bound of the target model's sample: labelled documents, by hash of their id.
TARGET_DOCUMENTS = 20_000
SEED = 20_240_601
TEMPERATURE = 1.0


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs, text by text, and their counts."""
    words, counts = word_hashes(texts)
    n = len(words)
    pairs = np.zeros(n, np.uint64)
    pairs[:-1] = mix(words[:-1] * times(3) + words[1:])
    ends = np.cumsum(counts)
    whole = np.ones(n, bool)
    whole[ends[counts > 0] - 1] = False  # no pair begins at a text's last word
    ids = np.stack([words, pairs], axis=1) % np.uint64(BUCKETS)
    keep = np.stack([np.ones(n, bool), whole], axis=1)
    return ids[keep].astype(np.int64), np.maximum(2 * counts - 1, 0)


def bucket_counts(docs: DataFrame, target_ids: list[int], id_col: str, text_col: str) -> np.ndarray:
    """Counts by bucket (raw, target) over all of ``docs``: one fixed-size row set a task."""
    held = docs.sparkSession.sparkContext.broadcast(frozenset(target_ids))

    def run(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BUCKETS, 2), np.int64)
        for rows in found:
            texts, ids = rows["text"].tolist(), rows["id"].tolist()
            for part in batches(texts):
                at, n = grams(texts[part])
                total[:, 0] += np.bincount(at, minlength=BUCKETS)
                good = np.repeat(np.fromiter((i in held.value for i in ids[part]), bool, len(n)), n)
                total[:, 1] += np.bincount(at[good], minlength=BUCKETS)
        some = np.flatnonzero(total[:, 0])
        yield pd.DataFrame({"bucket": some.astype(np.int32), "raw": total[some, 0], "target": total[some, 1]})

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counted = (
        rows.mapInPandas(run, "bucket int, raw long, target long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
        .toPandas()  # BUCKETS rows at most
    )
    out = np.zeros((BUCKETS, 2), np.int64)
    out[counted["bucket"].to_numpy()] = counted[["raw", "target"]].to_numpy()
    return out


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """log(target / raw) by bucket, both smoothed by one count over the raw model.

    The target's missing counts follow the raw distribution, so buckets that
    the target sample is too small to show are neutral.  Without target
    documents all ratios are zero.
    """
    raw = (counts[:, 0] + 1) / (counts[:, 0].sum() + BUCKETS)
    size = counts[:, 1].sum()
    prior = BUCKETS
    target = (counts[:, 1] + prior * raw) / (size + prior)
    return np.log(target) - np.log(raw)


def sortable(x: Column) -> Column:
    """A double as a long of the same order in [0, 2^63), fine enough to tell noise apart."""
    return ((F.signum(x) * F.log1p(F.abs(x)) + 64.0) * float(1 << 55)).cast("long")


def kth_largest(keys: DataFrame, col: str, k: int) -> int | None:
    """The k-th largest of a long column in [0, 2^63), by grouped counts of 16 bits at a time."""
    prefix = None
    for shift in (48, 32, 16, 0):
        rows = keys if prefix is None else keys.where(F.shiftright(col, shift + 16) == prefix)
        found = rows.groupBy(F.shiftright(F.col(col), shift).alias("p")).count().collect()  # 2^16 rows at most
        for r in sorted(found, key=lambda r: -r["p"]):
            if k <= r["count"]:
                prefix = r["p"]
                break
            k -= r["count"]
        else:
            return None
    return prefix


def resample(
    docs: DataFrame,
    target: DataFrame,
    share: float,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_documents: int = TARGET_DOCUMENTS,
    temperature: float = TEMPERATURE,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_grams, log_weight, gumbel_key, kept.

    ``target`` holds ids of good documents.  ``kept`` marks the
    ceil(share * rows) greatest keys, all rows that tie with the last of them
    included; the Gumbel noise is a function of id and seed.  Null and empty
    texts have no n-grams and weight 0; rows with a null id share one noise;
    repeated rows get equal keys.  Without target rows all weights are 0.
    Other columns are ignored; an empty table gives an empty result.
    """
    chosen = (
        target.select(F.col(id_col).alias("id"))
        .where("id is not null")
        .distinct()
        .orderBy(F.xxhash64("id"), "id")
        .limit(target_documents)
        .collect()
    )
    counts = bucket_counts(docs, [r["id"] for r in chosen], id_col, text_col)
    held = docs.sparkSession.sparkContext.broadcast(log_ratios(counts))

    def make():
        ratios = held.value

        def kernel(texts: list[str | None]) -> list[list]:
            sizes, sums = [], []
            for part in batches(texts):
                at, n = grams(texts[part])
                some = np.flatnonzero(n)
                total = np.zeros(len(n))
                # a sum for each text by itself, so it doesn't depend on the texts beside it
                total[some] = np.add.reduceat(ratios[at], (np.cumsum(n) - n)[some]) if len(some) else 0.0
                sizes += n.tolist()
                sums += total.round(9).tolist()
            return [sizes, sums]

        return kernel

    fields = [T.StructField("n_grams", T.LongType()), T.StructField("log_weight", T.DoubleType())]
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    noise = -F.log(-F.log(uniform)) * F.lit(float(temperature))
    scored = annotate(base, ["text"], fields, make, keep=["doc_id"]).withColumn("gumbel_key", F.col("log_weight") + noise)
    keyed = cut(scored.withColumn("key", sortable(F.col("gumbel_key"))), "weights")
    k = int(np.ceil(share * keyed.count()))
    least = kth_largest(keyed, "key", k) if k else None
    kept = F.lit(False) if least is None else F.col("key") >= least
    return keyed.select("doc_id", "n_grams", "log_weight", "gumbel_key", kept.alias("kept"))
