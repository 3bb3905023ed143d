"""Byte-level BPE encoding with forced boundaries, and decoding.

A pair of bytes that stands inside no vocabulary token can never be merged
across, so every such pair inside a pre-token is a certain cut.  Fragments
between cuts are short; each is encoded on its own (once, then remembered) and
the ids are concatenated.  The result is that of encoding the whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewright.llm.common import annotate, once_a_process

#: Fixed value: the published pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{s}\p{{L}}\p{{N}}]+|[{s}]+(?![^{s}])|[{s}]+"
#: White space of the pattern, as the tokenizer's own engine has it.
SPACE = r"\t\n\x0b\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Pre-tokens and fragments remembered by a task, each.
REMEMBERED = 350_000
#: Bytes of a fragment beyond which merges are queued.
LONG = 96
NONE = 1 << 62


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Memo(dict):
    """A dict that makes missing values, and starts anew when full."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[key] = self.make(key)
        return value


class ByteBPE:
    """Encoder and decoder for a ``tokenizers`` file of a byte-level BPE."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        model = spec["model"]
        self.ids = {raw(t): i for t, i in model["vocab"].items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        #: Pair of ids to rank and merged id, all packed in whole numbers.
        self.merges = {
            self.ids[a] << 20 | self.ids[b]: k << 20 | self.ids[a + b]
            for k, (a, b) in enumerate((raw(a), raw(b)) for a, b in pairs)
        }
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.prefix = bool(spec["pre_tokenizer"].get("add_prefix_space"))
        self.bytes_of = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.added.items()}
        self.inside = {t[k : k + 2] for t in self.ids for k in range(len(t) - 1)}
        self.split = regex.compile(PATTERN.format(s=SPACE))
        names = sorted(self.added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.fragment = _Memo(self._merge)
        self.token = _Memo(self._pieces)

    def _merge(self, raw: bytes) -> tuple[int, ...]:
        """Ids of one fragment: merges in order of rank, leftmost first."""
        if len(raw) > LONG:
            return self._merge_long(raw)
        ids = [self.byte_ids[b] for b in raw]
        get = self.merges.get
        found = [get(a << 20 | b, NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while found and (best := min(found)) != NONE:
            k = found.index(best)
            ids[k] = new = best & 0xFFFFF
            del ids[k + 1], found[k]
            if k:
                found[k - 1] = get(ids[k - 1] << 20 | new, NONE)
            if k < len(found):
                found[k] = get(new << 20 | ids[k + 1], NONE)
        return tuple(ids)

    def _merge_long(self, raw: bytes) -> tuple[int, ...]:
        """The same for long fragments: a queue of merges over a linked list, O(n log n)."""
        ids: list[int] = [self.byte_ids[b] for b in raw]
        n, get = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(m, k) for k in range(n - 1) if (m := get(ids[k] << 20 | ids[k + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            m, k = heapq.heappop(queue)
            j = after[k]
            if ids[k] < 0 or j >= n or get(ids[k] << 20 | ids[j]) != m:
                continue
            ids[k], ids[j] = m & 0xFFFFF, -1
            after[k] = j = after[j]
            if j < n:
                before[j] = k
                if (m := get(ids[k] << 20 | ids[j])) is not None:
                    heapq.heappush(queue, (m, k))
            if (b := before[k]) >= 0 and (m := get(ids[b] << 20 | ids[k])) is not None:
                heapq.heappush(queue, (m, b))
        return tuple(i for i in ids if i >= 0)

    def fragments(self, raw: bytes) -> list[bytes]:
        """``raw`` cut at every pair of bytes that no token holds."""
        inside, out, at = self.inside, [], 0
        for k in range(1, len(raw)):
            if raw[k - 1 : k + 1] not in inside:
                out.append(raw[at:k])
                at = k
        out.append(raw[at:])
        return out

    def _pieces(self, token: str) -> tuple[int, ...]:
        parts = self.fragments(token.encode("utf-8", "surrogatepass"))
        if len(parts) == 1:
            return self._merge(parts[0])
        return tuple(chain.from_iterable(map(self.fragment.__getitem__, parts)))

    def _plain(self, text: str) -> list[int]:
        if self.prefix and text and not text[0].isspace():
            text = " " + text
        return list(chain.from_iterable(map(self.token.__getitem__, self.split.findall(text))))

    def forget(self) -> None:
        """Free what a task remembered."""
        self.token.clear()
        self.fragment.clear()

    def encode(self, text: str) -> list[int]:
        if self.special is None or not any(t in text for t in self.added):
            return self._plain(text)
        out: list[int] = []
        for k, part in enumerate(self.special.split(text)):
            out += [self.added[part]] if k % 2 else self._plain(part) if part else []
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _kernel(path: str, with_ids: bool, with_text: bool):
    def make():
        bpe = once_a_process(("bpe", path), lambda: ByteBPE(path))
        names = {i: str(i) for i in bpe.bytes_of}

        def kernel(texts: list[str | None]) -> list[list]:
            counts, ids_sha, text_sha, ids_out, text_out = [], [], [], [], []
            for t in texts:
                ids = bpe.encode(t or "")
                back = bpe.decode(ids)
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                ids_out.append(ids if with_ids else None)
                text_out.append(back if with_text else None)
            return [counts, ids_sha, text_sha] + [ids_out] * with_ids + [text_out] * with_text

        kernel.done = bpe.forget
        return kernel

    return make


def encode_decode(
    docs: DataFrame, path: str, text_col: str = "text", with_ids: bool = True, with_text: bool = True
) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256, decoded_sha256, and by choice ``ids`` and ``decoded``.

    ``path`` is a tokenizer file that every executor can read.  A null or empty
    text has no ids and decodes to an empty text.  The string of a special
    token in a text becomes that token.  Columns with the new names are
    replaced, others pass; one row in, one row out; empty tables stay empty.
    """
    fields = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
        *[T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids,
        *[T.StructField("decoded", T.StringType())] * with_text,
    ]
    return annotate(docs, [text_col], fields, _kernel(path, with_ids, with_text))
