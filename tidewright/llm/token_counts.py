"""Token counts of a unigram model by dynamic programming over a trie.

Distinct pre-tokens are inserted in a trie.  The forward score of a prefix,
the best sum of piece scores that spell it, depends on the prefix alone, so it
is computed once when its node is made and shared by all pre-tokens below;
the node where a pre-token ends stores its number of pieces.

A pre-token is a run of non-white-space with the mark U+2581 before it.  The
vocabulary file holds pieces by rank, not probabilities: scores follow Zipf's
law, ``-ln(rank + 1)`` less the log of the normaliser.  A character that no
piece is costs ``BYTE_SCORE`` and one token per UTF-8 byte.  Among
equal scores the fewer tokens win.
"""

from __future__ import annotations

import math
import re
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewright.llm.common import annotate, once_a_process

MARK = "▁"
BYTE_SCORE = -20.0
ABSENT = object()
#: Nodes of a worker's trie, and pre-tokens remembered, before they are begun anew: about 320 and 150 bytes each.
NODES, TOKENS = 250_000, 500_000
#: Pre-tokens handled at a time, and characters of those that are inserted: at most 80 MB of nodes at a time.
PART, LONGEST = 4096, 64


def zipf_pieces(path: str) -> dict[str, float]:
    """Normal pieces of a SentencePiece file, with Zipf scores by rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    total = math.log(sum(1 / (k + 1) for k in range(len(names))))
    return {p: -math.log(k + 1) - total for k, p in enumerate(names)}


class PrefixTrie:
    """Trie with a forward score and a piece count at every node."""

    def __init__(self, pieces: dict[str, float]) -> None:
        self.reach = max(map(len, pieces), default=1)
        # every ending of a piece; None: no piece itself
        self.ends: dict[str, float | None] = {p[k:]: None for p in pieces for k in range(1, len(p))} | pieces
        self.counts: dict[str, int] = {}  # pre-token: pieces
        self.clear()

    def clear(self) -> None:
        self._uproot()
        self.counts.clear()

    def _uproot(self) -> None:
        self.moves: list[dict[str, int]] = [{}]
        self.score, self.count = [0.0], [0]

    def _step(self, text: str, d: int, score: list[float], count: list[int]) -> tuple[float, int]:
        """Forward score and count of ``text[:d]`` from those of its prefixes; the lists end with that of d - 1."""
        get, best, least = self.ends.get, -math.inf, 0
        for size in range(1, min(self.reach, d) + 1):
            s = get(text[d - size : d], ABSENT)
            known, n = s is not ABSENT, 1
            if s is None or not known:
                if size > 1 and known:
                    continue
                if size > 1:  # no piece ends so, so longer ones aren't pieces
                    break
                n = len(text[d - 1].encode("utf-8", "surrogatepass"))
                s = BYTE_SCORE * n
            s += score[-size]
            n += count[-size]
            if s > best or (s == best and n < least):
                best, least = s, n
            if not known:
                break
        return best, least

    def insert(self, token: str) -> None:
        """Insert a pre-token; only the nodes it doesn't share are computed."""
        text = MARK + token
        path_score, path_count = [0.0], [0]
        moves, node = self.moves, 0
        for d, c in enumerate(text, 1):
            to = moves[node].get(c)
            if to is None:
                s, n = self._step(text, d, path_score, path_count)
                to = moves[node][c] = len(moves)
                moves.append({})
                self.score.append(s)
                self.count.append(n)
            path_score.append(self.score[to])
            path_count.append(self.count[to])
            node = to
        self.counts[token] = path_count[-1]

    def long_count(self, token: str) -> int:
        """Pieces of a pre-token that is not inserted; only the last prefixes are held."""
        text = MARK + token
        score, count = [0.0], [0]
        for d in range(1, len(text) + 1):
            s, n = self._step(text, d, score, count)
            score.append(s)
            count.append(n)
            if len(score) > PART + self.reach:
                del score[: -self.reach], count[: -self.reach]
        return count[-1]

    def total(self, tokens: list[str]) -> int:
        """Pieces of at most ``PART`` pre-tokens."""
        if len(self.counts) > TOKENS:
            self.clear()
        elif len(self.moves) > NODES:
            self._uproot()
        known = self.counts
        rest = set(tokens).difference(known)
        long = {t: self.long_count(t) for t in rest if len(t) > LONGEST}
        for token in rest:
            if token not in long:
                self.insert(token)
        if not long:
            return sum(map(known.__getitem__, tokens))
        return sum([long[t] if t in long else known[t] for t in tokens])

    def count_all(self, texts: list[list[str]]) -> list[int]:
        """Pieces of each text, given as pre-tokens."""
        return [sum([self.total(t[k : k + PART]) for k in range(0, len(t), PART)]) for t in texts]

    def count_text(self, text: str) -> tuple[int, int]:
        """Pre-tokens and pieces of a text; a long one is split a part at a time."""
        if len(text) <= 1 << 20:
            tokens = text.split()
            return len(tokens), self.count_all([tokens])[0]
        found, n, pieces = (m[0] for m in re.finditer(r"\S+", text)), 0, 0
        while part := list(islice(found, PART)):
            n += len(part)
            pieces += self.total(part)
        return n, pieces


def count_tokens(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with n_pretokens and n_tokens.

    Null, empty and blank texts have none.  Columns with the new names are
    replaced, others pass; one row in, one row out; empty tables stay empty.
    """

    def make():
        trie = once_a_process(("trie", path), lambda: PrefixTrie(zipf_pieces(path)))

        def kernel(texts: list[str | None]) -> list[list]:
            found = [trie.count_text(t or "") for t in texts]
            return [[n for n, _ in found], [pieces for _, pieces in found]]

        kernel.done = trie.clear
        return kernel

    fields = [T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())]
    return annotate(docs, [text_col], fields, make)
