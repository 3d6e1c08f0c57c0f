"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

Texts are cut into pieces at single blanks, where the pre-tokenizing pattern always parts them; distinct pieces of a
block are encoded once and kept in a bounded cache of the task. A piece is cut by the pattern into pretokens. Each pretoken is a
row of leaves holding ``rank * width + position`` of the pair that starts there; the root of the row's tree is therefore the leftmost
pair of the lowest rank. A merge changes three leaves and walks each up to the root, until no root holds a rank. Rows of one width
run side by side in numpy, a pretoken longer than ``WIDE`` has a tree of its own.

Texts with runs of blanks, or blanks other than space and newline, take the pattern over the whole text. Special tokens
found in a text become their id, as the tokenizer file asks. A null is an empty text with no tokens; rows are judged one by one.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from labelgrid.llm.common import Block, Memo, id_and_text, map_texts

# The pre-tokenizing pattern of the byte-level vocabulary (fixed values), with the blanks of Unicode spelled out.
_S = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
_EDGE = regex.compile(rf"^[{_S}]|[{_S}]$")

WIDE = 64
CACHE = 300_000
_NONE = np.int64(1 << 62)


def byte_letters() -> dict[str, int]:
    """Letters that stand for bytes: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encoder and decoder for a tokenizer file with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.byte_id = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.byte_id[b] = vocab[letter]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.size = np.int64(size)
        keys = np.array([vocab[a] * size + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made
        self.ranks = dict(zip(keys.tolist(), range(len(keys))))
        self.pattern = regex.compile(PATTERN)
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.lengths = np.array([len(x) for x in self.token_bytes], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self.cache, self.units = Memo(CACHE), Memo(CACHE)

    # -- merging -----------------------------------------------------------------------------------------------

    def _pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], -1)

    def merge_rows(self, rows: list[bytes], width: int) -> list[bytes]:
        """Ids of pretokens of at most ``width`` bytes, all trees in step; ``width`` is a power of two."""
        n = len(rows)
        lengths = np.fromiter(map(len, rows), np.int64, n)
        padded = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(n, width)
        symbol = self.byte_id[padded]
        place = np.arange(width)
        after = np.tile(place + 1, (n, 1))
        before = np.tile(place - 1, (n, 1))
        live = place < lengths[:, None]
        tree = np.full((n, 2 * width), _NONE, np.int64)
        rank = self._pair_rank(symbol[:, :-1], symbol[:, 1:])
        tree[:, width : 2 * width - 1] = np.where((rank >= 0) & live[:, 1:], rank * width + place[:-1], _NONE)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2

        def put(who: np.ndarray, where: np.ndarray, value: np.ndarray) -> None:
            node = where + width
            tree[who, node] = value
            while (node := node >> 1)[0] if len(node) else 0:
                tree[who, node] = np.minimum(tree[who, 2 * node], tree[who, 2 * node + 1])

        def pair(who: np.ndarray, at: np.ndarray) -> np.ndarray:
            other = after[who, at]
            inside = other < lengths[who]
            r = self._pair_rank(symbol[who, at], symbol[who, np.minimum(other, width - 1)])
            return np.where(inside & (r >= 0), r * width + at, _NONE)

        who = np.flatnonzero(tree[:, 1] < _NONE) if width > 1 else np.zeros(0, np.int64)
        while len(who):
            root = tree[who, 1]
            at, gone = root % width, None
            gone = after[who, at]
            symbol[who, at] = self.made[root // width]
            live[who, gone] = False
            follow = after[who, gone]
            after[who, at] = follow
            has = follow < lengths[who]
            before[who[has], follow[has]] = at[has]
            put(who, gone, np.full(len(who), _NONE))
            put(who, at, pair(who, at))
            has = before[who, at] >= 0
            if has.any():
                w, p = who[has], before[who[has], at[has]]
                put(w, p, pair(w, p))
            who = who[tree[who, 1] < _NONE]
        flat = symbol[live].astype("<u4").tobytes()
        ends = np.cumsum(live.sum(axis=1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def merge_one(self, row: bytes) -> bytes:
        """Ids of one long pretoken, by a tree of plain integers."""
        n = len(row)
        width = 1 << max(1, (n - 1).bit_length())
        symbol, none = self.byte_id[np.frombuffer(row, np.uint8)].tolist(), 1 << 62
        size, ranks, made = int(self.size), self.ranks, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def leaf(i: int) -> int:
            rank = ranks.get(symbol[i] * size + symbol[after[i]]) if after[i] < n else None
            return none if rank is None else rank * width + i

        tree = [none] * width + [leaf(i) for i in range(n)] + [none] * (width - n)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i: int, value: int) -> None:
            node = i + width
            tree[node] = value
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    return
                tree[node] = least

        while tree[1] < none:
            at = tree[1] % width
            gone = after[at]
            symbol[at] = int(made[tree[1] // width])
            after[at] = after[gone]
            if after[at] < n:
                before[after[at]] = at
            symbol[gone] = -1
            put(gone, none)
            put(at, leaf(at))
            if before[at] >= 0:
                put(before[at], leaf(before[at]))
        return np.array([s for s in symbol if s >= 0], "<u4").tobytes()

    def _learn(self, units: Iterable[str]) -> None:
        """Encode pretokens that the cache lacks, by classes of width."""
        classes: dict[int, list[tuple[str, bytes]]] = {}
        for unit in units:
            raw = unit.encode()
            if len(raw) > WIDE:
                self.units[unit] = self.merge_one(raw)
            else:
                classes.setdefault(1 << (len(raw) - 1).bit_length() if len(raw) > 1 else 1, []).append((unit, raw))
        for width, some in classes.items():
            for i in range(0, len(some), 8192):
                part = some[i : i + 8192]
                ids = self.merge_rows([raw for _, raw in part], width)
                self.units.update(zip((unit for unit, _ in part), ids))

    def _cut(self, text: str) -> list[str | int]:
        """Pretokens and special ids of a text, in order."""
        if self.parts is None or not any(x in text for x in self.special):
            return self.pattern.findall(text)
        out: list[str | int] = []
        for i, part in enumerate(self.parts.split(text)):
            out.extend([self.special[part]] if i % 2 else self.pattern.findall(part))
        return out

    def _ids(self, cut: list[str | int]) -> bytes:
        return b"".join(self.units[u] if isinstance(u, str) else u.to_bytes(4, "little") for u in cut)

    # -- texts -------------------------------------------------------------------------------------------------

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = []
        for text in texts:
            first, *rest = text.replace("\n", " \n").split(" ")
            # The start has no blank before it; no other piece begins with two newlines.
            cut.append(["\n\n" + first, *rest])
        plain: dict[str, list[str | int] | None] = {}
        for piece in self.cache.missing(cut):
            if piece[:2] == "\n\n":
                body, lead = piece[2:], ""
            elif piece[:1] == "\n":
                body, lead = piece[1:], "\n"
            else:
                body, lead = piece, " "
            if (not body and lead) or _EDGE.search(body):
                plain[piece] = None
            else:
                plain[piece] = self._cut(lead + body)
        self._learn(self.units.missing([[u for u in c if isinstance(u, str)] for c in plain.values() if c]))
        for piece, c in plain.items():
            self.cache[piece] = None if c is None else self._ids(c)
        out, get = [], self.cache.get
        for text, pieces in zip(texts, cut):
            try:
                out.append(b"".join(map(get, pieces)))
            except TypeError:
                whole = self._cut(text)
                self._learn(self.units.missing([[u for u in whole if isinstance(u, str)]]))
                out.append(self._ids(whole))
        return out

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Bytes of all tokens in order; an id outside the vocabulary has none."""
        ids = ids[ids < len(self.lengths)].astype(np.int64)
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        where = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.flat[where].tobytes()

    def decode(self, ids: bytes) -> str:
        """Text of packed ids, special tokens included; broken UTF-8 becomes the replacement character."""
        return self.decode_bytes(np.frombuffer(ids, "<u4")).decode("utf-8", "replace")


_loaded: dict[str, ByteBpe] = {}


def tokenizer(path: str) -> ByteBpe:
    """The tokenizer of a file, read once per worker."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (packed little-endian unsigned 32-bit integers) of every row."""

    def run(block: Block, rows: pa.RecordBatch) -> dict:
        ids = tokenizer(path).encode([block.text(i).decode() for i in range(len(block))])
        return {"doc_id": rows.column("doc_id"), "ids": pa.array(ids, pa.binary())}

    return map_texts(id_and_text(docs), run, "doc_id bigint, ids binary")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of every row of packed ids; null ids give an empty text."""

    def run(block: Block, rows: pa.RecordBatch) -> dict:
        bpe = tokenizer(path)
        return {"doc_id": rows.column("doc_id"), "text": pa.array([bpe.decode(block.text(i)) for i in range(len(block))], pa.string())}

    return map_texts(encoded.select("doc_id", "ids"), run, "doc_id bigint, text string", "ids")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded, then decoded from its ids."""

    def run(block: Block, rows: pa.RecordBatch) -> dict:
        bpe = tokenizer(path)
        ids = bpe.encode([block.text(i).decode() for i in range(len(block))])
        return {
            "doc_id": rows.column("doc_id"),
            "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids], pa.string()),
        }

    return map_texts(id_and_text(docs), run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
