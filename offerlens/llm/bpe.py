"""BPE encoding with a segment tree over the ranks of adjacent pairs.

Each piece of text is an array of symbols. A segment tree over it holds, for every
position, the rank of the merge of that symbol with the next one; its root is the
leftmost merge of lowest rank. A merge changes three leaves, so it costs three
updates of logarithmic length, until the root holds no merge. Pieces of one batch
that are equally long (to the next power of two) form a forest: the same step runs
on all their trees at once as array operations. Very long pieces use one tree each.

Texts without white space, of any length, nulls (taken as empty) and repeated rows
are all handled; results equal those of the tokenizers library for vocabularies of
this kind (NFC, lower case, word ends).
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from offerlens.llm.arrow import map_batches, texts
from offerlens.llm.unsettled import unsettled

NONE = np.int64(1) << np.int64(60)
_FOREST_WIDTH = 64
_CACHE_MOST = 400_000
# White space as the vocabulary's normalizer has it.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f"[^{_SPACE}]+")
# Control characters that str.split takes for white space and the normalizer doesn't.
_SPLIT_ONLY = re.compile("[\x1c-\x1f]")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in letters)
    letters |= {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class Encoder:
    """Encodes and decodes with one vocabulary file; keeps results per word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        suffix = model["end_of_word_suffix"] or ""
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._pieces = regex.compile(split.replace(r"[^\s\p{L}", r"[^\p{L}")).findall
        self._added = added
        self._special = re.compile("|".join(map(re.escape, added))) if added else None
        letters = _byte_letters()
        self._inner = np.array([vocab[c] for c in letters], np.int64)
        self._last = np.array([vocab[c + suffix] for c in letters], np.int64)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self._made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self._keys, self._ranks = keys[order], order.astype(np.int64)
        self._by_pair = dict(zip(keys.tolist(), range(len(keys))))
        self._tokens = {i: t for t, i in [*vocab.items(), *added.items()]}
        self._words: dict[str, bytes] = {}
        self._bpe: dict[str, bytes] = {}
        self._path, self._library = path, None

    # pieces ------------------------------------------------------------------
    def _normal(self, chunk: str) -> str:
        if chunk.isascii():
            return chunk.lower()
        return "".join(c.lower() for c in unicodedata.normalize("NFC", chunk))

    def _cut(self, chunk: str) -> list[str]:
        """The pieces of a run without white space. Where it holds code points of a newer
        Unicode version than Python's, the library's own rules say what is a letter."""
        if not unsettled(chunk):
            return self._pieces(self._normal(chunk))
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        normal = self._library.normalizer.normalize_str(chunk)
        return [normal[a:b] for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(normal)]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._ranks[at], NONE)

    def _forest(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Symbols of all pieces of at most ``width`` bytes, their trees side by side."""
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        columns = np.arange(width)
        inside = columns < lengths[:, None]
        symbols = np.zeros((n, width), np.int64)
        symbols[inside] = self._inner[np.frombuffer(b"".join(pieces), np.uint8)]
        rows = np.arange(n)
        ends = np.fromiter((p[-1] for p in pieces), np.int64, n)
        symbols[rows, lengths - 1] = self._last[ends]
        after = np.broadcast_to(columns + 1, (n, width)).copy()
        before = np.broadcast_to(columns - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), NONE, np.int64)
        ranks = self._rank(symbols[:, :-1], symbols[:, 1:])
        mergeable = (columns[1:] < lengths[:, None]) & (ranks < NONE)
        tree[:, width:-1][mergeable] = (ranks * width + columns[:-1])[mergeable]
        for level in range(width.bit_length() - 2, -1, -1):
            low, high = 1 << level, 2 << level
            tree[:, low:high] = np.minimum(tree[:, 2 * low : 2 * high : 2], tree[:, 2 * low + 1 : 2 * high : 2])
        alive = inside.copy()
        live = rows[tree[:, 1] < NONE]
        while len(live):
            root = tree[live, 1]
            at, rank = root % width, root // width
            gone = after[live, at]
            then = after[live, gone]
            symbols[live, at] = self._made[rank]
            alive[live, gone] = False
            after[live, at] = then
            more = then < lengths[live]
            before[live[more], then[more]] = at[more]
            new = np.full(len(live), NONE)
            new[more] = self._leaf(symbols[live[more], at[more]], symbols[live[more], then[more]], at[more], width)
            self._update(tree, live, gone, np.full(len(live), NONE), width)
            self._update(tree, live, at, new, width)
            first = before[live, at]
            some = first >= 0
            own, head = live[some], first[some]
            self._update(tree, own, head, self._leaf(symbols[own, head], symbols[own, at[some]], head, width), width)
            live = live[tree[live, 1] < NONE]
        flat = symbols[alive].astype("<u4").tobytes()
        stops = (np.cumsum(alive.sum(1)) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *stops], stops)]

    def _leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        rank = self._rank(left, right)
        return np.where(rank < NONE, rank * width + at, NONE)

    @staticmethod
    def _update(tree: np.ndarray, rows: np.ndarray, at: np.ndarray, values: np.ndarray, width: int) -> None:
        node = at + width
        tree[rows, node] = values
        while width > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            width >>= 1

    def _long(self, piece: bytes) -> bytes:
        """One piece with a tree of its own."""
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        symbols = self._inner[np.frombuffer(piece, np.uint8)].tolist()
        symbols[-1] = int(self._last[piece[-1]])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks, made, none = self._by_pair.get, self._made.tolist(), int(NONE)

        def leaf(i: int, j: int) -> int:
            rank = ranks(symbols[i] << 32 | symbols[j])
            return none if rank is None else rank * width + i

        tree = [none] * width + [leaf(i, i + 1) for i in range(n - 1)] + [none] * (width - n + 1)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def update(i: int, value: int) -> None:
            node = i + width
            tree[node] = value
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        while tree[1] < none:
            rank, at = divmod(tree[1], width)
            gone = after[at]
            then = after[at] = after[gone]
            symbols[at], symbols[gone] = made[rank], -1
            update(gone, none)
            if then < n:
                before[then] = at
                update(at, leaf(at, then))
            else:
                update(at, none)
            if before[at] >= 0:
                update(before[at], leaf(before[at], at))
        return np.array([s for s in symbols if s >= 0], "<u4").tobytes()

    def _encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if len(p) > _FOREST_WIDTH:
                out[i] = self._long(p)
            else:
                by_width.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(i)
        for width, members in by_width.items():
            step = max(1, (1 << 20) // width)
            for start in range(0, len(members), step):
                part = members[start : start + step]
                for i, ids in zip(part, self._forest([pieces[i] for i in part], width)):
                    out[i] = ids
        return out

    # texts -------------------------------------------------------------------
    def learn(self, chunks: set[str]) -> None:
        """Encode all words of a batch that aren't known yet."""
        if len(self._words) > _CACHE_MOST:
            self._words.clear()
        if len(self._bpe) > _CACHE_MOST:
            self._bpe.clear()
        new = [c for c in chunks if c not in self._words]
        cut = [self._cut(c) for c in new]
        fresh = [p for p in {p for ps in cut for p in ps} if p not in self._bpe]
        self._bpe.update(zip(fresh, self._encode_pieces([p.encode() for p in fresh])))
        known = self._bpe.__getitem__
        self._words.update((c, known(ps[0]) if len(ps) == 1 else b"".join(map(known, ps))) for c, ps in zip(new, cut))

    def _parts(self, text: str) -> list[str | list[str]]:
        """Special tokens as strings, what stands between them as lists of words."""
        if self._special is None or "<|" not in text:
            return [self._chunks(text)]
        parts: list[str | list[str]] = []
        done = 0
        for m in self._special.finditer(text):
            parts += [self._chunks(text[done : m.start()]), m.group()]
            done = m.end()
        return [*parts, self._chunks(text[done:])]

    @staticmethod
    def _chunks(text: str) -> list[str]:
        return _CHUNK.findall(text) if _SPLIT_ONLY.search(text) else text.split()

    def encode_batch(self, batch: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self._parts(t) for t in batch]
        self.learn(set().union(*(p for parts in cut for p in parts if isinstance(p, list))))
        known = self._words.__getitem__
        special = {t: i.to_bytes(4, "little") for t, i in self._added.items()}
        return [b"".join(special[p] if isinstance(p, str) else b"".join(map(known, p)) for p in parts) for parts in cut]

    def decode(self, ids: bytes) -> str:
        """Tokens in order with one space between; the vocabulary has no decoder of
        its own, and special tokens are shown."""
        return " ".join(map(self._tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, built once in each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def with_ids(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded`` of
    every row; a null text has no ids and decodes to the empty text."""
    kind = df.schema[key].dataType.simpleString()

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        model = encoder(path)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = model.encode_batch(texts(batch.column(1)))
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array([model.decode(x) for x in ids], pa.string())], [key, "ids", "decoded"]
            )

        return apply

    return map_batches(df.select(key, text), make, f"`{key}` {kind}, ids binary, decoded string")


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row the number of ids and SHA-256 of ids and of the decoded text; ids are
    made and decoded in one step, so that no token crosses to the JVM."""
    kind = df.schema[key].dataType.simpleString()

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        model = encoder(path)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = model.encode_batch(texts(batch.column(1)))
            return pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(model.decode(x).encode()).hexdigest() for x in ids], pa.string()),
            ], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

        return apply

    return map_batches(df.select(key, text), make, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
