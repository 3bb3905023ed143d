"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language knows every substring of it.
A text is parsed, per language, into the longest phrases that the language's
automaton holds; naming a phrase of a sample of N symbols takes log2(N) bits,
so ``phrases * log2(N) / symbols`` is a cross entropy and the language with
the least wins.

The automata are compiled to one sparse table: transitions of a state start at
its offset, rows are laid over one another where they leave room, and each
entry names the state it belongs to.  So memory grows with the samples, not
with the alphabet, and a step is one look-up.  All texts of a batch are parsed
in lockstep by vector look-ups for all languages at once.

Long texts are parsed by segments at the same time, each as if a phrase began
with it, and then joined without a trace: from where the phrase before really
ends phrases are followed one by one until one begins where the segment's own
parse has one too; from there on both are the same.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm.common import annotate, once_a_process
from tidewright.llm.words import batches

#: The labelled sample: whole documents a language, by hash of their id; those of up to so many bytes come first.
SAMPLE_DOCUMENTS, SAMPLE_BYTES = 24, 4096
#: Symbols of a long text that one row of the lockstep parse takes.
SEGMENT = 1024
UNKNOWN = "und"
_POINTS = 0x110000


def symbols(text: str) -> np.ndarray:
    """Code points of lower-cased ``text``; each run of non-letters is one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_letters()[points], points, np.uint32(0x20))
    keep = points != 0x20
    keep[1:] |= points[:-1] != 0x20
    return points[keep]


def _letters() -> np.ndarray:
    """Which code points are letters (Unicode category L)."""
    make = lambda: np.fromiter((chr(c).isalpha() for c in range(_POINTS)), bool, _POINTS)
    return once_a_process(("letters",), make)


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions {symbol: state} of every state of the suffix automaton of ``codes``; 0 is the root."""
    trans, link, length = [{}], [-1], [0]
    last = 0
    for c in codes:
        new = len(trans)
        trans.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in trans[p]:
            trans[p][c] = new
            p = link[p]
        if p >= 0:
            q = trans[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(trans)
                trans.append(dict(trans[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = copy
                while p >= 0 and trans[p].get(c) == q:
                    trans[p][c] = copy
                    p = link[p]
        last = new
    return trans


#: Places tried for a state's row before it goes behind all others, and left slots tried again for a single move.
TRIES, HOLES = 24, 4


def overlay(trans: list[dict[int, int]], width: int) -> tuple[np.ndarray, list[int]]:
    """Entries (state offset << 32 | next state's offset), and each state's offset.

    State s with offset o has its move by symbol c (below ``width``) at o + c; no two states share an offset.  States
    with several moves are placed first, those with one fill the slots between.
    """
    room = 2 * sum(map(len, trans)) + 2 * len(trans) + 4 * width
    used, taken = bytearray(room), bytearray(room)  # slots of entries; offsets
    offset = [0] * len(trans)
    low = high = width  # slots from which to search, and beyond which all are free
    for s in sorted((s for s, m in enumerate(trans) if len(m) > 1), key=lambda s: (-len(trans[s]), s)):
        moves = sorted(trans[s])
        if high + 3 * width > len(used):
            used.extend(bytes(room))
            taken.extend(bytes(room))
        low = used.find(0, low)
        slot = low
        for _ in range(TRIES):
            at = slot - moves[0]
            if not taken[at] and not any([used[at + c] for c in moves]):
                break
            slot = used.find(0, slot + 1)
        else:
            low += 1
            at = high - moves[0]
            while taken[at]:
                at += 1
        offset[s] = at
        taken[at] = 1
        for c in moves:
            used[at + c] = 1
        high = max(high, at + moves[-1] + 1)
    for room_left in (used, taken):
        room_left.extend(bytes(8 * len(trans) + width))
    slot, holes = width - 1, []
    for s, moves in enumerate(trans):
        if len(moves) != 1:
            continue
        (c,) = moves
        for k in range(max(0, len(holes) - HOLES), len(holes)):
            if not taken[holes[k] - c]:
                here = holes.pop(k)
                break
        else:
            slot = here = used.find(0, slot + 1)
            while taken[here - c]:
                holes.append(here)
                slot = here = used.find(0, slot + 1)
        offset[s] = here - c
        taken[here - c] = used[here] = 1
    for s, moves in enumerate(trans):
        if not moves:
            offset[s] = taken.find(0)
            taken[offset[s]] = 1
    table = np.full(max(offset) + width + 1, -1, np.int64)
    for s, moves in enumerate(trans):
        o = offset[s]
        for c, to in moves.items():
            table[o + c] = o << 32 | offset[to]
    return table, offset


def compile_samples(samples: dict[str, np.ndarray]) -> tuple:
    """The parts of a ``CrossParser``: plain arrays, fit for a broadcast."""
    names = sorted(samples)
    points = np.unique(np.concatenate([samples[k] for k in names]))
    code = _codes(points)
    width = len(points) + 1
    tables, roots, fresh, base = [], [], [], 0
    for k in names:
        trans = suffix_automaton(code[samples[k]].tolist())
        table, offset = overlay(trans, width)
        first = np.full(width, offset[0], np.int64)  # a step that begins a new phrase; the root: no phrase goes on
        for c, to in trans[0].items():
            first[c] = offset[to]
        tables.append(np.where(table >= 0, table + (base << 32 | base), -1))
        roots.append(offset[0] + base)
        fresh.append(first + base)
        base += len(table)
    bits = np.array([math.log2(len(samples[k]) + 1) for k in names])
    return names, points, np.concatenate(tables), np.array(roots), np.stack(fresh), bits


def _codes(points: np.ndarray) -> np.ndarray:
    """Number of every code point: 1.. for ``points``, 0 for others."""
    code = np.zeros(_POINTS, np.int32)
    code[points] = np.arange(1, len(points) + 1)
    return code


class CrossParser:
    """Automata of all languages in one table; predicts a language for each text."""

    def __init__(self, names: list[str], points: np.ndarray, table: np.ndarray, roots: np.ndarray, fresh: np.ndarray, bits: np.ndarray) -> None:
        self.names, self.code, self.table, self.roots, self.fresh, self.bits = names, _codes(points), table, roots, fresh, bits

    def _parse(self, codes: np.ndarray, begin: np.ndarray, size: np.ndarray, marks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(phrases begun, state after it) of pieces of ``codes``, a column per language; marks where phrases begin."""
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        state = np.tile(self.roots, (len(begin), 1))
        count = np.zeros(state.shape, np.int64)
        live = np.searchsorted(-size, -np.arange(size.max(initial=0)), side="left")
        for step, n in enumerate(live.tolist()):
            at = begin[:n] + step
            c, now = codes[at], state[:n]
            v = self.table[now + c[:, None]]
            ends = (v >> 32) != now
            begins = ends | (now == self.roots)
            count[:n] += begins
            if marks is not None:
                marks[:, at] = begins.T
            v &= 0xFFFFFFFF
            row, lang = np.nonzero(ends)
            v[row, lang] = self.fresh[lang, c[row]]
            state[:n] = v
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return count[back], state[back]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (array of code points), a column per language."""
        lengths = np.array([len(t) for t in texts], np.int64)
        codes = self.code[np.concatenate(texts)].astype(np.int64) if len(texts) else np.empty(0, np.int64)
        starts = np.cumsum(lengths) - lengths
        out = np.zeros((len(texts), len(self.names)), np.int64)
        short = np.flatnonzero(lengths <= SEGMENT)
        out[short] = self._parse(codes, starts[short], lengths[short], None)[0]
        long = np.flatnonzero(lengths > SEGMENT)
        if len(long):
            out[long] = self._joined(codes, starts[long], starts[long] + lengths[long])
        return out

    def _joined(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Phrases of long texts ``codes[start:end]`` by language."""
        langs = len(self.names)
        pieces = -(-(ends - starts) // SEGMENT)
        first = np.cumsum(pieces) - pieces
        owner = np.repeat(np.arange(len(starts)), pieces)
        begin = starts[owner] + (np.arange(len(owner)) - first[owner]) * SEGMENT
        stop = np.minimum(begin + SEGMENT, ends[owner])
        marks = np.zeros((langs, len(codes)), bool)
        count, state = self._parse(codes, begin, stop - begin, marks)
        # where the phrase that a segment leaves open ends
        leave = np.repeat(stop[:, None], langs, 1)
        row, lang = np.nonzero(state != self.roots)
        now = state[row, lang]
        while len(row):
            at = leave[row, lang]
            inside = at < ends[owner[row]]
            row, lang, now, at = row[inside], lang[inside], now[inside], at[inside]
            v = self.table[now + codes[at]]
            goes = (v >> 32) == now
            row, lang, now = row[goes], lang[goes], v[goes] & 0xFFFFFFFF
            leave[row, lang] += 1
        found = np.zeros((len(starts), langs), np.int64)
        for t in range(len(starts)):
            for k in range(langs):
                x, total = int(starts[t]), 0
                for s in range(first[t], first[t] + pieces[t]):
                    end = int(stop[s])
                    while x < end and not marks[k, x]:
                        x = self._phrase(codes, x, int(ends[t]), k)
                        total += 1
                    if x < end:  # from here on the segment's own parse is the text's
                        own = int(count[s, k])
                        if x > begin[s]:
                            own -= int(np.count_nonzero(marks[k, begin[s] : x]))
                        total += own
                        x = int(leave[s, k])
                found[t, k] = total
        return found

    def _phrase(self, codes: np.ndarray, x: int, end: int, lang: int) -> int:
        """Where the phrase of ``lang`` that begins at ``x`` ends."""
        state, at = int(self.roots[lang]), x
        while at < end:
            v = int(self.table[state + codes[at]])
            if v >> 32 != state:
                break
            state = v & 0xFFFFFFFF
            at += 1
        return max(at, x + 1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        for part in batches(texts):
            coded = [symbols(t or "") for t in texts[part]]
            some = [k for k, c in enumerate(coded) if (c != 0x20).any()]
            if not some:
                continue
            cost = self.phrases([coded[k] for k in some]) * self.bits
            best = cost.argmin(axis=1)
            ranked = np.sort(cost, axis=1)
            score = 1 - ranked[:, 0] / ranked[:, 1] if len(self.names) > 1 else np.ones(len(some))
            for k, b, s in zip(some, best.tolist(), score.tolist(), strict=True):
                names[part.start + k], scores[part.start + k] = self.names[b], s
        return names, scores


def held_out(id_col: str) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text is 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Samples by language from the rows of ``labelled`` with a language and a text.

    Of each language ``SAMPLE_DOCUMENTS`` whole documents by hash of their id,
    those of more than ``SAMPLE_BYTES`` bytes only where there are too few
    others: a bound that does not depend on the table's size.  Equal texts
    count once.  Null languages, ids and texts, and texts without a symbol,
    teach nothing.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    place = Window.partitionBy("lang").orderBy("long", F.xxhash64("id"), "id")
    chosen = (
        rows.select(
            F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), (F.octet_length(text_col) > SAMPLE_BYTES).alias("long")
        )
        .withColumn("k", F.row_number().over(place))
        .where(F.col("k") <= SAMPLE_DOCUMENTS)
        .collect()
    )
    wanted = {(r["lang"], r["id"]) for r in chosen}
    found = (
        rows.where(F.col(id_col).isin(sorted({i for _, i in wanted})))
        .select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .collect()
    )
    texts: dict[str, set[str]] = {}
    for r in found:
        if (r["lang"], r["id"]) in wanted:
            texts.setdefault(r["lang"], set()).add(r["text"])
    space = np.array([0x20], np.uint32)
    samples = {k: [s for t in sorted(v) if len(s := symbols(t))] for k, v in texts.items()}
    return {k: np.concatenate([x for s in v for x in (s, space)]) for k, v in samples.items() if v}


def identify(docs: DataFrame, samples: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1: one less the best cost over the second).

    Null texts and texts without a letter are ``und`` with score 0, and so are
    all texts if nothing was learned; ties go to the first language by name.
    Columns of these names are replaced, others pass; empty tables stay empty.
    """
    held = docs.sparkSession.sparkContext.broadcast(compile_samples(samples) if samples else None)

    def make():
        parser = CrossParser(*held.value) if held.value else None

        def kernel(texts: list[str | None]) -> list[list]:
            if parser is None:
                return [[UNKNOWN] * len(texts), [0.0] * len(texts)]
            return list(parser.predict(texts))

        return kernel

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return annotate(docs, [text_col], fields, make)
