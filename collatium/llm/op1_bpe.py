"""Byte-level BPE encoding and decoding with forced boundaries.

A text is split into pre-tokens by the vocabulary's pattern. Two neighbouring bytes that are adjacent inside no
vocabulary token can never be merged across, so every such pair is a certain cut: the fragments between cuts are
encoded on their own and their ids concatenated. Fragments and pre-tokens are remembered in bounded tables.

Nulls count as empty texts; an empty text has no ids, and its decoded text is empty. Special tokens of the vocabulary
are matched in the raw text first, as the library does. Rows are independent, so repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collatium.llm.common import giving_back

try:
    import tokenizers
except ImportError:
    tokenizers = None

#: Remembered pre-tokens and fragments per worker; beyond it a table starts anew.
REMEMBER = 300_000
NEVER = 1 << 62


def byte_chars() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _ranges(points: list[int]) -> str:
    out, start, last = [], None, None
    for p in [*points, None]:
        if start is not None and (p is None or p != last + 1):
            out.append(f"\\U{start:08x}-\\U{last:08x}")
            start = None
        if p is not None and start is None:
            start = p
        last = p
    return "".join(out)


def pretoken_pattern(last: int = sys.maxunicode) -> re.Pattern:
    """The byte-level pre-tokenizer's pattern, with its Unicode classes spelled out for texts of code points up to ``last``."""
    letters, numbers = [], []
    for p in range(last + 1):
        kind = unicodedata.category(chr(p))[0]
        if kind == "L":
            letters.append(p)
        elif kind == "N":
            numbers.append(p)
    white = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    a, n, s = _ranges(letters), _ranges(numbers), _ranges(white)
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{a}]+| ?[{n}]+| ?[^{s}{a}{n}]+|[{s}]+(?![^{s}])|[{s}]+")


class Codec:
    """Encodes texts to ids and ids to texts, from a tokenizer file of the ``tokenizers`` library (byte-level BPE)."""

    def __init__(self, path: str, fast: bool = True):
        """fast: encode fragments with the tokenizers library's BPE model where it is installed, else (and with the same ids) here."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back, model = byte_chars(), spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        of = {bytes(back[c] for c in token): i for token, i in model["vocab"].items() if token not in self.special}
        self.bytes_of = [b""] * (1 + max([*of.values(), *self.special.values()]))
        for token, i in of.items():
            self.bytes_of[i] = token
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.single = [of[bytes([b])] for b in range(256)]
        self.merge = {}
        inside = np.zeros((256, 256), dtype=bool)
        for token in of:
            raw = np.frombuffer(token, dtype=np.uint8)
            inside[raw[:-1], raw[1:]] = True
        #: certain[a * 256 + b]: no vocabulary token has byte a followed by byte b.
        self.certain = (~inside).tobytes()
        for rank, pair in enumerate(model["merges"]):
            a, b = (bytes(back[c] for c in x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.merge.setdefault((of[a], of[b]), (rank + 1) << 20 | of[a + b])  # the order of the ranks, and the new id
        #: Classes without supplementary code points are matched by table, others range by range.
        self.pattern, self.full, self.supplementary = pretoken_pattern(0xFFFF), pretoken_pattern(), re.compile("[\U00010000-\U0010ffff]")
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.model = None
        if fast and tokenizers is not None:
            self.model, self.char_of = tokenizers.Tokenizer.from_file(path).model, {b: c for c, b in back.items()}
        codec = self

        class Known(dict):
            """Two generations: what a full table loses is still found, and kept, if it comes up again."""

            old: dict[str, bytes] = {}

            def __missing__(self, word: str) -> bytes:
                ids = self.old.get(word)
                if ids is None:
                    ids = np.array(codec.word(word.encode()), dtype="<u4").tobytes()
                if len(word) <= 64:
                    if len(self) >= REMEMBER:
                        self.old = dict(self)
                        self.clear()
                    self[word] = ids
                return ids

        self.known = Known()

    def cuts(self, raw: bytes) -> list[bytes]:
        """``raw`` divided at every certain boundary."""
        certain = self.certain
        at = [i for i, (a, b) in enumerate(zip(raw, raw[1:]), 1) if certain[a << 8 | b]]
        return [raw[i:j] for i, j in zip([0, *at], [*at, len(raw)], strict=True)] if at else [raw]

    def word(self, raw: bytes) -> list[int]:
        parts = self.cuts(raw)
        return self.fragment(parts[0]) if len(parts) == 1 else [i for part in parts for i in self.fragment(part)]

    def fragment(self, raw: bytes) -> list[int]:
        """Merges by rank, the leftmost of equal ranks first."""
        if self.model is not None and len(raw) <= 4096:
            return [t.id for t in self.model.tokenize(raw.decode("latin-1").translate(self.char_of))]
        ids = [self.single[b] for b in raw]
        if len(ids) > 48:
            return self._long(ids)
        get = self.merge.get
        while len(ids) > 1:
            found = [get(pair, NEVER) for pair in zip(ids, ids[1:])]
            best = min(found)
            if best == NEVER:
                break
            i = found.index(best)
            ids[i : i + 2] = [best & 0xFFFFF]
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same in O(n log n), with a linked list and a heap."""
        n, get = len(ids), self.merge.get
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or ids[i] != a or j >= n or ids[j] != b:
                continue
            new = m & 0xFFFFF
            ids[i], alive[j], after[i] = new, False, after[j]
            if (k := after[i]) < n:
                before[k] = i
                if m := get((new, ids[k])):
                    heapq.heappush(heap, (m, i, new, ids[k]))
            if (h := before[i]) >= 0 and (m := get((ids[h], new))):
                heapq.heappush(heap, (m, h, ids[h], new))
        return [x for x, live in zip(ids, alive, strict=True) if live]

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        if self.splitter is not None and any(s in text for s in self.special):
            return b"".join(np.array([self.special[p]], dtype="<u4").tobytes() if p in self.special else self._plain(p) for p in self.splitter.split(text) if p)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        pattern = self.full if self.supplementary.search(text) else self.pattern
        return b"".join(map(self.known.__getitem__, pattern.findall(text)))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker process and file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_decode(docs: DataFrame, path: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array<int>) and decoded.

    path: a byte-level BPE file of the tokenizers library, present on every executor. Only these columns are added;
    columns of ``docs`` with one of their names are replaced. There is no shuffle: each text is encoded, and its ids
    decoded, where it is read.
    """
    added = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep_ids
    kept = [c for c in docs.columns if c not in added]
    slim = docs.select(*[F.col(f"`{c}`") for c in kept])
    fields = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "ids": pa.list_(pa.int32()), "decoded": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            cols: dict[str, list] = {c: [] for c in added}
            for value in batch.column(text):
                ids = coder.encode(value.as_py() or "")
                decoded = coder.decode(ids)
                cols["n_tokens"].append(len(ids) // 4)
                cols["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                cols["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if keep_ids:
                    cols["ids"].append(np.frombuffer(ids, dtype="<i4"))
                    cols["decoded"].append(decoded)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(cols[c], fields[c]) for c in added]], names=[*batch.schema.names, *added])

    ddl = ["n_tokens long", "ids_sha256 string", "decoded_sha256 string", "ids array<int>", "decoded string"][: len(added)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields] + ddl)
    return slim.mapInArrow(giving_back(run), schema)
