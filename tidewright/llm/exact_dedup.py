"""Exact deduplication by content-defined chunk recipes.

A text is normalised and cut where a rolling hash of its last 32 bytes has a
given form, so equal passages give equal chunks wherever they stand.  Chunks
are deduplicated by their bytes: a chunk's identifier is its 64-bit hash,
verified to name one byte string only (where it names several, the string
itself becomes the identifier).  Texts are equal exactly when their ordered
identifier lists are, so grouping moves lists of numbers and every long text
is moved once at most, as distinct chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm.common import annotate, cut, small_batches, tidy, with_hash
from tidewright.llm.words import GOLDEN, mix

#: Chunk bytes: least, about the mean beyond the least, most.
LEAST, MEAN, MOST = 256, 2048, 16384


def normalise(text: str | None) -> bytes:
    """UTF-8 of ``text`` with each run of ASCII white space as one space; null is empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    buf = np.frombuffer(raw, np.uint8)
    gap = (buf == 0x20) | ((buf >= 0x09) & (buf <= 0x0D))
    keep = ~gap
    keep[:1] = True
    keep[1:] |= ~gap[:-1]
    return np.where(gap, np.uint8(0x20), buf)[keep].tobytes()


def chunks(raw: bytes) -> list[bytes]:
    """Content-defined chunks of UTF-8 ``raw``; cuts fall between characters."""
    n = len(raw)
    if n <= LEAST:
        return [raw] if n else []
    buf = np.frombuffer(raw, np.uint8)
    rolled = (mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN) >> np.uint64(32)).astype(np.uint32)[buf]
    for width in (1, 2, 4, 8, 16):  # after these, bits come from the last 32 bytes
        moved = rolled[width:] + (rolled[:-width] << np.uint32(width))
        rolled = np.concatenate((rolled[:width], moved))
    starts = (buf & 0xC0) != 0x80  # of characters
    at = np.flatnonzero((rolled[:-1] >> np.uint32(32 - MEAN.bit_length() + 1) == 0) & starts[1:]) + 1
    cuts, last = [], 0
    for c in [*at.tolist(), n]:
        while c - last > MOST:
            forced = last + MOST
            while not starts[forced]:
                forced -= 1
            cuts.append(forced)
            last = forced
        if c - last >= LEAST or c == n:
            cuts.append(c)
            last = c
    return [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]


def _hash(chunk: bytes) -> int:
    import xxhash

    x = xxhash.xxh3_64_intdigest(chunk)
    return x - (1 << 64) if x >> 63 else x


def _recipes(several: set[int] | None):
    """Kernel: text digest and ordered identifiers; texts stand for hashes in ``several``."""

    def make():
        def kernel(texts: list[str | None]) -> list[list]:
            digests, lists, named = [], [], []
            for t in texts:
                raw = normalise(t)
                parts = chunks(raw)
                hashes = [_hash(c) for c in parts]
                digests.append(hashlib.sha256(raw).hexdigest())
                lists.append(hashes)
                named.append([c.decode("utf-8", "surrogatepass") for c, h in zip(parts, hashes) if h in several] if several else [])
            return [digests, lists, named]

        return kernel

    return make


def _chunk_rows(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in found:
        parts = [c for t in rows["text"] for c in chunks(normalise(t))]
        yield pd.DataFrame({"h": pd.Series([_hash(c) for c in parts], dtype="int64"), "chunk": pd.Series(parts, dtype=object)})


def _collided(texts: DataFrame) -> set[int]:
    """Hashes that name several chunks: distinct chunks by their bytes, counted by hash."""
    distinct = texts.mapInPandas(lambda found: tidy(_chunk_rows(found)), "h long, chunk binary").distinct()
    twice = distinct.groupBy("h").count().where("count > 1").select("h")
    # of n distinct chunks about n^2 / 2^65 pairs collide: few even at 10^11 chunks
    return {r["h"] for r in twice.collect()}


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after replacing each run of ASCII white
    space by one space; null counts as empty.  Of equal texts the row with the
    least id stays (an id beats a null one); of rows with that same id one row
    stays.  Other columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    several = _collided(base.select("text"))
    fields = [
        T.StructField("text_sha256", T.StringType()),
        T.StructField("recipe", T.ArrayType(T.LongType())),
        T.StructField("named", T.ArrayType(T.StringType())),
    ]
    made = annotate(base, ["text"], fields, _recipes(several), keep=["id"])
    recipes = cut(made.select("id", "text_sha256", F.struct("recipe", "named").alias("recipe")), "recipes")
    # rows of one id and text: a number tells them apart; such groups are as small as an id's rows
    numbered = recipes.groupBy("recipe", "id", "text_sha256").agg(F.count("*").alias("rows"))
    groups = numbered.groupBy("recipe").agg(F.min("id").alias("keep_id"), F.sum("rows").alias("group_size"))
    joined = with_hash(numbered, "recipe").join(with_hash(groups, "recipe"), ["recipe", "_h"])
    out = joined.select("id", "keep_id", "group_size", "text_sha256", "rows")
    first = F.col("id").eqNullSafe(F.col("keep_id"))
    return out.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("rows")))).select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        (first & (F.col("k") == 1)).alias("kept"),
        "text_sha256",
    )
