"""Benchmark decontamination with one Aho-Corasick automaton.

Items and texts are normalised alike: A-Z lower-cased, words are runs of
digits, a-z and non-ASCII.  Every window of 13 consecutive item words (a
shorter item is one window) gives a pattern over word numbers: the shortest
beginning that no other window shares, so the automaton has a few nodes per
item word, not 13.  A text is scanned once whatever the number of windows;
where a beginning occurs, the rest of its window is compared with the item's
words.  Hits are word places, mapped back to character offsets of the original
text.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm.common import annotate, cut, drop, once_a_process

WINDOW = 13
#: Benchmark bytes that are broadcast and held by one automaton: about 45 bytes of memory each.  What a benchmark
#: has beyond makes further passes over the documents, each with one such automaton.
AUTOMATON_BYTES = 8 << 20
_BASE = 0x10FFFE
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
#: Every ASCII byte that is no word's becomes a space; A-Z becomes a-z.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def spans(text: str, hit: list[int]) -> list[tuple[int, int]]:
    """Character ranges of the original text that runs of hit words cover."""
    wanted, out, last = set(hit), [], -2
    for k, m in enumerate(_WORD.finditer(text)):
        if k in wanted:
            if last == k - 1:
                out[-1] = (out[-1][0], m.end())
            else:
                out.append((m.start(), m.end()))
            last = k
    return out


def distinct_windows(numbers: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For windows ``numbers[start : start + size]``: a number of its content, and the length of its pattern.

    Patterns are the shortest beginnings that no window of other content shares; the whole window if there is none.
    """
    most = int(sizes.max(initial=0))

    def deeper(group: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
        """Numbers of the beginnings one word longer; windows that have ended stay by themselves."""
        word = np.where(sizes[at] > depth, numbers[np.minimum(starts[at] + depth, len(numbers) - 1)] + 1, 0)
        return np.unique(group * (int(numbers.max(initial=0)) + 2) + word, return_inverse=True)[1]

    everyone = np.arange(len(starts))
    content = np.zeros(len(starts), np.int64)
    for depth in range(most):
        content = deeper(content, everyone, depth)
    length = sizes.copy()
    at, group = everyone, np.zeros(len(starts), np.int64)
    for depth in range(most):
        group = deeper(group, at, depth)
        low, high = np.full(group.max(initial=-1) + 1, len(starts)), np.full(group.max(initial=-1) + 1, -1)
        np.minimum.at(low, group, content[at])
        np.maximum.at(high, group, content[at])
        alone = low[group] == high[group]
        length[at[alone]] = np.minimum(depth + 1, sizes[at[alone]])
        at, group = at[~alone], group[~alone]
        if not len(at):
            break
    return content, length


class Scanner:
    """The automaton over the windows of ``items`` [(name, words)]."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        import ahocorasick

        vocab: dict[bytes, int] = {}
        for _, ws in items:
            for w in ws:
                vocab.setdefault(w, len(vocab))
        self.wide = len(vocab) > _BASE  # then a word takes two symbols
        code = (lambda i: chr(1 + i // _BASE) + chr(1 + i % _BASE)) if self.wide else (lambda i: chr(1 + i))
        self.step, self.none = (2, "\0\0") if self.wide else (1, "\0")
        self.code = {w: code(i) for w, i in vocab.items()}
        self.names = [name for name, _ in items]
        numbers = np.array([vocab[w] for _, ws in items for w in ws], np.int64)
        self.words = "".join([self.code[w] for _, ws in items for w in ws])
        lengths = np.array([len(ws) for _, ws in items], np.int64)
        begins = np.cumsum(lengths) - lengths
        counts = np.where(lengths > 0, np.maximum(lengths - window, 0) + 1, 0)
        owner = np.repeat(np.arange(len(items)), counts)
        starts = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + begins[owner]
        sizes = np.minimum(window, lengths[owner])
        content, prefix = distinct_windows(numbers, starts, sizes)
        pairs = np.unique(content * len(items) + owner) if len(owner) else owner
        self.owners = pairs % max(1, len(items))  # of window content c: owners[edge[c] : edge[c + 1]]
        self.edge = np.searchsorted(pairs // max(1, len(items)), np.arange(content.max(initial=-1) + 2))
        first = np.unique(content, return_index=True)[1]
        self.start, self.size = starts[first].tolist(), sizes[first].tolist()
        self.prefix = prefix[first].tolist()
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        step = self.step
        for c, (at, n) in enumerate(zip(self.start, self.prefix, strict=True)):
            self.automaton.add_word(self.words[at * step : (at + n) * step], c)
        self.some = bool(self.start)
        if self.some:
            self.automaton.make_automaton()

    def scan(self, ws: list[bytes]) -> tuple[set[int], set[str]]:
        """Places of hit words, and the items whose windows occur."""
        hit: set[int] = set()
        found: set[int] = set()
        if self.some and ws:
            step, words = self.step, self.words
            text = "".join(map(self.code.get, ws, repeat(self.none)))
            for at, c in self.automaton.iter(text):
                end, odd = divmod(at + 1, step)
                if odd:
                    continue
                begin, size, place = end - self.prefix[c], self.size[c], self.start[c]
                if text.startswith(words[place * step : (place + size) * step], begin * step):
                    hit.update(range(begin, begin + size))
                    found.add(c)
        return hit, {self.names[o] for c in found for o in self.owners[self.edge[c] : self.edge[c + 1]]}


def scan_documents(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items, items_sha256, hit_spans, contaminated.

    ``items`` are the names of items with occurring windows, sorted as strings;
    ``hit_spans`` are character ranges of the original text.  Contaminated: at
    least one hit and 20 * n_hit >= n_words.  Null and empty texts have no
    words and are clean; null or empty items have no windows; a null item id
    reads as ``null``; rows of one item id are one item, repeated rows count
    once.  Columns with the new names are replaced, others pass; one row in,
    one row out; empty tables are allowed on both sides.
    """
    spark = docs.sparkSession
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("name"), F.col(item_text_col).alias("text")
    ).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = -(-size // AUTOMATON_BYTES) or 1
    held, names = "_held", "_names"
    while {held, names} & set(docs.columns):
        held, names = f"_{held}", f"_{names}"
    so_far, before = docs, None
    for k in range(passes):
        mine = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(passes)) == k) if passes > 1 else items
        # at most about AUTOMATON_BYTES of text, and one automaton in a worker
        rows = sorted((r["name"], r["text"]) for r in mine.distinct().collect())
        block = (uuid.uuid4().hex, spark.sparkContext.broadcast(rows))
        earlier = [held, names] if k else [F.lit(None).cast("array<int>"), F.lit(None).cast("array<string>")]
        if k == passes - 1:
            keep = [c for c in docs.columns if c not in (held, names)]
            return annotate(so_far, [text_col, *earlier], FIELDS, _finished(block, window), keep=keep)
        fields = [T.StructField(held, T.ArrayType(T.IntegerType())), T.StructField(names, T.ArrayType(T.StringType()))]
        so_far = cut(annotate(so_far, [text_col, *earlier], fields, _hits(block, window)), "scanned")
        if before is not None:
            drop(before)
        before = so_far
    raise AssertionError("there is a last pass")


def _scanner(block: tuple, window: int) -> Scanner:
    """The block's automaton: made once by a worker, which holds one at a time."""
    name, items = block
    return once_a_process((name, window), lambda: Scanner([(n, words(t)) for n, t in items.value], window), "scanner")


def _hits(block, window: int):
    """Kernel: word places and items found so far and by this block."""

    def make():
        scanner = _scanner(block, window)

        def kernel(texts: list[str | None], held: list, names: list) -> list[list]:
            found = [scanner.scan(words(t)) for t in texts]
            places = [sorted(h.union(old or ())) for (h, _), old in zip(found, held, strict=True)]
            return [places, [sorted(i.union(old or ())) for (_, i), old in zip(found, names, strict=True)]]

        return kernel

    return make


_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("items_sha256", T.StringType()),
    T.StructField("hit_spans", T.ArrayType(_SPAN)),
    T.StructField("contaminated", T.BooleanType()),
]


def _finished(block, window: int):
    """Kernel of the last pass: the result's fields."""

    def make():
        scanner = _scanner(block, window)

        def kernel(texts: list[str | None], held: list, names: list) -> list[list]:
            out: list[list] = [[] for _ in FIELDS]
            for t, places, items in zip(texts, held, names, strict=True):
                ws = words(t)
                hit, own = scanner.scan(ws)
                hit.update(places or ())
                listed = sorted(own.union(items or ()))
                row = (
                    len(ws),
                    len(hit),
                    len(listed),
                    listed,
                    hashlib.sha256(",".join(listed).encode("utf-8", "surrogatepass")).hexdigest(),
                    [{"start": a, "end": b} for a, b in spans(t, sorted(hit))] if hit else [],
                    bool(hit) and 20 * len(hit) >= len(ws),
                )
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return out

        return kernel

    return make
