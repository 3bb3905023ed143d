"""Near-duplicate groups: SuperMinHash, banding, verification, union-find.

1. One pass over the texts makes each document's shingle set size, a SHA-256
   digest of its words and the bucket keys of its bands.  Documents of equal
   words form a class; the least ``doc_id`` stands for it, so copies never meet
   pair by pair.  Those that share a bucket get a wider signature, of one byte a
   place, and their texts are put in a table.
2. Every bucket links its members to its least member (a star, not all pairs).
   Sizes and signature bytes prune the links; only then texts are joined to
   them, and the links are confirmed on the shingles themselves.  They give
   first components.
3. A bucket whose members are still in several components is searched in full:
   members outside its largest component against all members.  Signature bytes,
   compared in blocks, find the pairs of different components that may be
   similar; texts go only to the tiles of ``BLOCK_MEMBERS`` by
   ``BLOCK_MEMBERS`` members that hold such a pair, where pairs already
   connected are skipped.
4. Components of all confirmed links.

No bucket is capped or skipped: a link is missed only when a pair shares no
band, with probability (1 - 0.75^4)^36 = 1e-6 at the threshold itself, or when
its signatures agree in ``SIGMAS`` standard deviations less of their places
than those of a pair at the threshold do on average (3e-8; ``sigmas=None``
prunes nothing by signatures).  Candidates are found by 64-bit shingle hashes,
links stand on the shingles themselves.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm.common import annotate, cut, drop, small_batches, tidy, with_hash
from tidewright.llm.components import UnionFind, connected_components
from tidewright.llm.superminhash import (
    SHINGLE,
    band_keys,
    batches,
    jaccard_at_least,
    shingle_sets,
    signature_bytes,
    signatures,
)

#: Documents of one file of a table, at least: small inputs make few files.
FILE_DOCUMENTS = 5_000
BANDS, ROWS = 36, 4
PLACES = BANDS * ROWS
PERCENT = 75
#: Places of the wider signatures, and standard deviations of the estimate that pruning by signatures allows.
WIDE_PLACES, SIGMAS = 512, 5.5
#: Members, and shingles, of one side of a tile in which texts are compared.
BLOCK_MEMBERS, BLOCK_SHINGLES = 256, 2_000_000
#: Blocks of one side whose signatures are compared at a time.
WIDE = 64
#: Shingle hashes that a task keeps for sets it meets again.
CACHE_SHINGLES = 4_000_000


def words(text: str | None) -> list[bytes]:
    """Words of a text: runs without ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def digest(ws: list[bytes]) -> bytes:
    """SHA-256 of the word sequence."""
    return hashlib.sha256(b" ".join(ws)).digest()


def shingles(ws: list[bytes]) -> set[tuple[bytes, ...]]:
    """The distinct shingles themselves; the whole sequence of fewer words; none without words."""
    if len(ws) < SHINGLE:
        return {tuple(ws)} if ws else set()
    return set(zip(*[ws[k:] for k in range(SHINGLE)], strict=False))


def similar(a: set, b: set, percent: int) -> bool:
    """Whether 100 * |a n b| >= percent * |a u b|; an empty set is similar to none."""
    if not a or not b or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def least_agreement(percent: int, places: int, sigmas: float | None) -> float:
    """Share of equal signature places below which a pair is taken to be under the threshold."""
    j = percent / 100
    return 0.0 if sigmas is None else max(0.0, j - sigmas * (j * (1 - j) / places) ** 0.5)


def _sketch(places: int):
    def make():
        def kernel(texts: list[str | None]) -> list[list]:
            return [[b for part in batches(texts) for b in signature_bytes(signatures(*shingle_sets(texts[part]), places))]]

        return kernel

    return make


def _sign(places: int, bands: int, rows: int):
    def make():
        def kernel(texts: list[str | None]) -> list[list]:
            sizes, marks, keys = [], [], []
            for part in batches(texts):
                elements, n = shingle_sets(texts[part])
                sizes += n.tolist()
                keys += list(band_keys(signatures(elements, n, places), bands, rows).view(np.int64))
                marks += [digest(words(t)) for t in texts[part]]
            return [sizes, marks, keys]

        return kernel

    return make


def _agreeing(estimate: float):
    """Pairs whose signatures agree in a share of ``estimate`` at least."""

    def run(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in found:
            if len(rows):
                a, b = (np.frombuffer(b"".join(rows[k]), np.uint8).reshape(len(rows), -1) for k in ("sig_u", "sig_v"))
                rows = rows[(a == b).mean(axis=1) >= estimate]
            yield rows[["u", "du", "v", "dv"]]

    return run


def _confirm(percent: int):
    """Links whose shingles reach the threshold; rows come sorted by their first end."""

    def run(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, set()
        for rows in found:
            good = []
            for u, du, t, s in zip(rows["u"], rows["du"], rows["text_u"], rows["text_v"], strict=True):
                if (u, du) != last:
                    last, held = (u, du), shingles(words(t))
                good.append(similar(held, shingles(words(s)), percent))
            yield rows.loc[good, ["u", "v"]]

    return run


def _tidied(run):
    return lambda found: tidy(run(found))


class _Sets:
    """Hashed sets of recently met documents."""

    def __init__(self) -> None:
        self.held: OrderedDict[tuple[int, int], np.ndarray] = OrderedDict()
        self.size = 0

    def get(self, names: list[tuple[int, int]], texts: list[str | None]) -> dict[tuple[int, int], np.ndarray]:
        found = {i: self.held[i] for i in names if i in self.held}
        todo = {i: t for i, t in zip(names, texts, strict=True) if i not in found}
        new, rest = list(todo), list(todo.values())
        for part in batches(rest):
            elements, n = shingle_sets(rest[part])
            for i, s in zip(new[part], np.split(elements, np.cumsum(n)[:-1]), strict=True):
                found[i] = self.held[i] = s
                self.size += len(s)
        while self.size > CACHE_SHINGLES and len(self.held) > 1:
            self.size -= len(self.held.popitem(last=False)[1])
        return found


def _runs(found: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of each run of equal keys of sorted rows, across batches."""
    held: list[dict[str, np.ndarray]] = []
    last = None
    for rows in found:
        if not len(rows):
            continue
        cols = {c: rows[c].to_numpy() for c in rows.columns}
        new = np.zeros(len(rows) - 1, bool)
        for k in keys:
            new |= cols[k][1:] != cols[k][:-1]
        starts = [0, *(np.flatnonzero(new) + 1).tolist(), len(rows)]
        for a, b in zip(starts, starts[1:], strict=False):
            key = tuple(cols[k][a] for k in keys)
            if held and key != last:
                yield held[0] if len(held) == 1 else {c: np.concatenate([h[c] for h in held]) for c in held[0]}
                held = []
            held.append({c: v[a:b] for c, v in cols.items()})
            last = key
    if held:
        yield held[0] if len(held) == 1 else {c: np.concatenate([h[c] for h in held]) for c in held[0]}


#: Places compared first, and pairs compared at a time.
FIRST_PLACES, PAIRS = 64, 1 << 14


def _near(xs: dict[str, np.ndarray], ys: dict[str, np.ndarray], percent: int, sigmas: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (place in ``xs``, place in ``ys``, agreement) of different components that may be similar."""
    a, b = (np.frombuffer(b"".join(v["sig"]), np.uint8).reshape(len(v["sig"]), -1) for v in (xs, ys))
    places = a.shape[1]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, (1 << 21) // max(1, len(b)))
    for at in range(0, len(a), step):
        size, other = xs["size"][at : at + step, None], ys["size"][None, :]
        fits = (xs["comp"][at : at + step, None] != ys["comp"][None, :]) & (100 * np.minimum(size, other) >= percent * np.maximum(size, other))
        left, right = np.nonzero(fits)
        left += at
        for k in range(0, len(left), PAIRS):
            x, y = left[k : k + PAIRS], right[k : k + PAIRS]
            for first, last in ((0, min(FIRST_PLACES, places)), (0, places)):
                share = (a[x, first:last] == b[y, first:last]).mean(axis=1)
                good = share >= least_agreement(percent, last - first, sigmas)
                x, y, share = x[good], y[good], share[good]
            found.append((x, y, share))
    if not found:
        none = np.empty(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(v) for v in zip(*found, strict=True))


def _sides(group: dict[str, np.ndarray], one: int, other: int) -> tuple[dict, dict]:
    """Rows of all roles but ``one``, and but ``other``."""
    return tuple({c: v[group["role"] != r] for c, v in group.items()} for r in (one, other))


_TILE = "bucket long, i int, j int, id long, d long, comp long, size long, role int, sig binary"


def _promising(percent: int, sigmas: float | None):
    """Members of a wide block that the tiles (i, j) need: both ends of every pair that may be similar."""

    def run(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: list[pd.DataFrame] = []
        rows = 0
        for group in _runs(found, ["bucket", "wide_i", "wide_j"]):
            everyone, outside = _sides(group, 1, 0)
            x, y, _ = _near(outside, everyone, percent, sigmas)
            if not len(x):
                continue
            i, j = outside["f"][x], everyone["f"][y]
            for side, at, role in ((outside, x, 1), (everyone, y, 0)):
                at = np.unique(np.stack([i, j, at], axis=1), axis=0)
                cols = {c: side[c][at[:, 2]] for c in ("bucket", "id", "d", "comp", "size", "sig")}
                made.append(pd.DataFrame(cols | {"i": at[:, 0], "j": at[:, 1], "role": role}))
                rows += len(at)
            if rows > 4096:
                yield pd.concat(made)[[c.split()[0] for c in _TILE.split(", ")]]
                made, rows = [], 0
        if made:
            yield pd.concat(made)[[c.split()[0] for c in _TILE.split(", ")]]

    return run


def _search_tiles(percent: int, sigmas: float | None):
    """Links between components in a tile."""

    def run(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = _Sets()
        for group in _runs(found, ["bucket", "i", "j"]):
            names = list(zip(group["id"].tolist(), group["d"].tolist(), strict=True))
            texts = dict(zip(names, group["text"], strict=True))
            have = sets.get(names, list(group["text"]))
            everyone, outside = _sides(group, 1, 0)
            own, all_ids = (list(zip(v["id"].tolist(), v["d"].tolist(), strict=True)) for v in (outside, everyone))
            x, y, share = _near(outside, everyone, percent, sigmas)
            order = np.lexsort((-share, x))
            links, out, last, held = UnionFind(), [], -1, set()
            for k, m in zip(x[order].tolist(), y[order].tolist(), strict=True):
                a, b = int(outside["comp"][k]), int(everyone["comp"][m])
                if links.find(a) == links.find(b) or not jaccard_at_least(have[own[k]], have[all_ids[m]], percent):
                    continue
                if k != last:
                    last, held = k, shingles(words(texts[own[k]]))
                if similar(held, shingles(words(texts[all_ids[m]])), percent):
                    links.union(a, b)
                    out.append((own[k][0], all_ids[m][0]))
            if out:
                yield pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return run


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = PERCENT,
    sigmas: float | None = SIGMAS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are runs of non-white-space with A-Z lower-cased; a document's set is
    its distinct 5-word shingles, or its whole word sequence if it has fewer
    words.  Null and empty texts have an empty set and are linked with nothing.
    Rows that share an id are one document, so they are linked.  A null id has
    a null component and is kept.  Other columns are ignored; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("d", F.xxhash64("text"))
    fields = [
        T.StructField("n_shingles", T.LongType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("keys", T.ArrayType(T.LongType())),
    ]
    signed = cut(annotate(base, ["text"], fields, _sign(PLACES, BANDS, ROWS), keep=["id", "d"]), "signed")
    files = 1 + signed.count() // FILE_DOCUMENTS
    known = signed.where("id is not null and n_shingles > 0")
    classes = cut(known.groupBy("digest").agg(F.min("id").alias("cid")).coalesce(files), "classes")
    hashed = with_hash(classes, "digest")
    # rows of one id with several texts: each text's class, tied together
    several = known.groupBy("id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a != b").select("id")
    apart = with_hash(known.select("id", "digest").join(several, "id"), "digest").join(hashed, ["digest", "_h"]).select("id", "cid")
    low = apart.groupBy("id").agg(F.min("cid").alias("low"))
    ties = apart.join(low, "id").where("cid != low").select(F.col("low").alias("u"), F.col("cid").alias("v"))
    # one text (id, d) stands for a class
    standing = (
        known.join(classes.select("digest", F.col("cid").alias("id")), ["digest", "id"], "left_semi")
        .groupBy("digest", "id")
        .agg(F.min("d").alias("d"), F.first("keys").alias("keys"), F.first("n_shingles").alias("size"))
    )
    rows = standing.select(F.explode("keys").alias("bucket"), "id", "d", "size")
    crowded = rows.groupBy("bucket").agg(F.min(F.struct("id", "d", "size")).alias("hub"), F.count("*").alias("n")).where("n > 1")
    met = with_hash(rows, "bucket").join(with_hash(crowded.select("bucket", "hub"), "bucket"), ["bucket", "_h"])
    members = cut(met.drop("_h").coalesce(files), "members")
    mine = base.join(members.select("id", "d").distinct(), ["id", "d"], "left_semi").dropDuplicates(["id", "d"])
    texts = cut(annotate(mine, ["text"], [T.StructField("sig", T.BinaryType())], _sketch(WIDE_PLACES)).coalesce(files), "texts")
    sigs = texts.select("id", "d", "sig")

    fits = F.lit(100) * F.least("size", "hub.size") >= F.lit(percent) * F.greatest("size", "hub.size")
    stars = members.where((F.col("id") != F.col("hub.id")) & fits).select(
        F.col("hub.id").alias("u"), F.col("hub.d").alias("du"), F.col("id").alias("v"), F.col("d").alias("dv")
    )
    sides = stars.distinct().join(sigs.toDF("v", "dv", "sig_v"), ["v", "dv"]).join(sigs.toDF("u", "du", "sig_u"), ["u", "du"])
    least = least_agreement(percent, WIDE_PLACES, sigmas)
    edges = cut(sides.mapInPandas(_tidied(_agreeing(least)), "u long, du long, v long, dv long").coalesce(files), "edges")
    read = texts.select("id", "d", "text")
    paired = (
        edges.join(read.toDF("v", "dv", "text_v"), ["v", "dv"])
        .join(read.toDF("u", "du", "text_u"), ["u", "du"])
        .select("u", "du", "text_u", "text_v", "v")
        .sortWithinPartitions("u", "du")
    )
    links = cut(paired.mapInPandas(_tidied(_confirm(percent)), "u long, v long").union(ties).coalesce(files), "links")
    first = connected_components(links)
    more = _leftover(members, first, texts, percent, sigmas, files)
    final = connected_components(links.union(more))
    named = classes.join(final.withColumnRenamed("id", "cid"), "cid", "left").select(
        "digest", F.coalesce("component", "cid").alias("component_id")
    )
    named = cut(with_hash(named, "digest").coalesce(files), "named")
    drop(classes, members, texts, edges, links, first, more, final)
    out = with_hash(signed.select("id", "n_shingles", "digest"), "digest").join(named, ["digest", "_h"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(
        F.when(F.col("id").isNotNull(), F.col("component_id"))
    )
    return out.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def _leftover(members: DataFrame, first: DataFrame, texts: DataFrame, percent: int, sigmas: float | None, files: int) -> DataFrame:
    """Links between components inside the buckets that hold several, as a table."""
    named = members.join(first, "id", "left").select(
        "bucket", "id", "d", "size", F.coalesce("component", "id").alias("comp")
    )
    parts = named.groupBy("bucket", "comp").agg(
        F.count("*").alias("n"), F.sum("size").alias("size"), F.bit_xor(F.xxhash64("id", "d")).alias("digest")
    )
    split = (
        parts.groupBy("bucket")
        .agg(
            F.count("*").alias("comps"),
            F.sum("n").alias("n"),
            F.sum("size").alias("size"),
            F.max(F.struct("n", "size", "comp")).alias("main"),
            F.bit_xor("digest").alias("digest"),
        )
        .where("comps > 1")
    )
    # buckets with the same members are searched once
    once = split.groupBy("digest", "n", "size").agg(F.min_by(F.struct("bucket", "main"), "bucket").alias("one"))

    def blocks(n, size):
        return F.greatest(F.ceil(n / BLOCK_MEMBERS), F.ceil(size / BLOCK_SHINGLES), F.lit(1)).cast("int")

    wanted = once.select(
        "one.bucket",
        F.col("one.main.comp").alias("main"),
        blocks(F.col("n"), F.col("size")).alias("nb"),
        blocks(F.col("n") - F.col("one.main.n"), F.col("size") - F.col("one.main.size")).alias("sb"),
    )
    full = named.join(wanted, "bucket").join(texts.select("id", "d", "sig"), ["id", "d"])
    spread = lambda n: F.pmod(F.xxhash64("id", "d"), n).cast("int")
    single = (F.col("nb") == 1) & (F.col("sb") == 1)
    outside = F.col("comp") != F.col("main")
    span = lambda n: F.sequence(F.lit(0), F.floor((n - 1) / WIDE).cast("int"))
    wide = lambda f: F.floor(f / WIDE).cast("int")
    carried = ["id", "d", "comp", "size", "sig"]
    as_any = full.select(
        "bucket", F.explode(span(F.col("sb"))).alias("wide_i"), wide(spread(F.col("nb"))).alias("wide_j"),
        spread(F.col("nb")).alias("f"), *carried, F.when(single & outside, 2).otherwise(0).alias("role"),
    )
    as_outside = full.where(outside & ~single).select(
        "bucket", wide(spread(F.col("sb"))).alias("wide_i"), F.explode(span(F.col("nb"))).alias("wide_j"),
        spread(F.col("sb")).alias("f"), *carried, F.lit(1).alias("role"),
    )
    # a number of partitions of its own: they are light to move and heavy to compare
    dealt = max(4 * files, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tasks = (
        as_any.union(as_outside)
        .repartition(dealt, "bucket", "wide_i", "wide_j")
        .sortWithinPartitions("bucket", "wide_i", "wide_j")
    )
    tiles = cut(tasks.mapInPandas(_tidied(_promising(percent, sigmas)), _TILE).coalesce(files), "tiles")
    found = (
        tiles.join(texts.select("id", "d", "text"), ["id", "d"])
        .repartition(dealt, "bucket", "i", "j")
        .sortWithinPartitions("bucket", "i", "j")
        .mapInPandas(_tidied(_search_tiles(percent, sigmas)), "u long, v long")
    )
    links = cut(found.coalesce(files), "more-links")
    drop(tiles)
    return links
