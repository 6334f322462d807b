"""Hierarchical packing of documents into sequences of several lengths.

Every document's ids are cut into full windows of the longest length and a rest. The
rest goes to a tier, the shortest window length that holds it. Tiers are packed from
the longest window down, best fit first; what a window lacks is filled from the
shorter tiers, whole rests first and then one that is cut to fit. So every window
but one of a group is full. That last one is split along the window lengths that
still fit it, and only its end, shorter than the shortest length, is padded.

A group is a run of rows of one input partition with at most ``GROUP_TOKENS`` ids,
so packing shuffles nothing, memory is bounded, a group of copies or a source of any
size is spread like other rows, and a lost task makes the same rows again. Sequences
of equal length are dealt to step groups, longest first and in turns, so that the
groups of a step hold nearly equally many ids.

Null and empty texts hold the end id only. Repeated rows are packed each on its own.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from offerlens.llm.arrow import slices, texts
from offerlens.llm.unsettled import unsettled

LENGTHS = (512, 1024, 2048, 4096)
GROUP_TOKENS = 4 << 20
STEP_GROUPS = 8

Piece = tuple[int, int, int]  # document, start, length


def pack(totals: list[int], lengths: tuple[int, ...] = LENGTHS) -> list[tuple[int, list[Piece]]]:
    """Windows as (length, pieces) that hold each id of each document once."""
    longest = lengths[-1]
    windows: list[tuple[int, list[Piece]]] = []
    tiers: dict[int, list[Piece]] = {n: [] for n in lengths}
    for doc, total in enumerate(totals):
        full = total // longest * longest
        windows += [(longest, [(doc, start, longest)]) for start in range(0, full, longest)]
        if rest := total - full:
            tiers[lengths[bisect_left(lengths, rest)]].append((doc, full, rest))
    # One list of rests for each tier, shortest first; ends are taken off.
    for pieces in tiers.values():
        pieces.sort(key=lambda p: (p[2], -p[0]))
    for i in range(len(lengths) - 1, -1, -1):
        length, own = lengths[i], tiers[lengths[i]]
        lower = [tiers[n] for n in lengths[i::-1]]
        while own:
            first = own.pop()
            window, gap = [first], length - first[2]
            while gap:
                got = _best(lower, gap)
                if got is None:
                    got = _cut(lower, gap)
                    if got is None:
                        break
                window.append(got)
                gap -= got[2]
            if gap:  # nothing is left anywhere: the group's last window
                windows += _split(window, lengths)
            else:
                windows.append((length, window))
    return windows


def _best(lower: list[list[Piece]], gap: int) -> Piece | None:
    """The longest rest that fits, from the longest tier down."""
    for pieces in lower:
        at = bisect_left(pieces, gap + 1, key=lambda p: p[2])
        if at:
            return pieces.pop(at - 1)
    return None


def _cut(lower: list[list[Piece]], gap: int) -> Piece | None:
    """The start of the shortest longer rest; its remainder goes to the tier it fits."""
    for k in range(len(lower) - 1, -1, -1):
        if lower[k]:
            doc, start, size = lower[k].pop(0)
            remainder = (doc, start + gap, size - gap)
            insort(lower[k], remainder, key=lambda p: p[2])
            return doc, start, gap
    return None


def _split(window: list[Piece], lengths: tuple[int, ...]) -> list[tuple[int, list[Piece]]]:
    """A window that can't be filled, as full shorter windows and one padded end."""
    left = sum(p[2] for p in window)
    out: list[tuple[int, list[Piece]]] = []
    rest = list(reversed(window))
    while left:
        length = next((n for n in reversed(lengths) if n <= left), None) or _power(left)
        take, part = length, []
        while take and rest:
            doc, start, size = rest.pop()
            used = min(size, take)
            part.append((doc, start, used))
            take -= used
            if used < size:
                rest.append((doc, start + used, size - used))
        out.append((length, part))
        left -= length - take
    return out


def _power(n: int) -> int:
    return 1 << (n - 1).bit_length()


def steps(windows: list[tuple[int, list[Piece]]], groups: int = STEP_GROUPS) -> list[int]:
    """A step group for each window: windows by falling length, dealt forth and back."""
    order = sorted(range(len(windows)), key=lambda i: (-windows[i][0], i))
    out = [0] * len(windows)
    for turn, i in enumerate(order):
        lap, at = divmod(turn, groups)
        out[i] = at if lap % 2 == 0 else groups - 1 - at
    return out


class WordIds:
    """Ids of texts by the tokenizers library, for vocabularies whose tokens mark the
    ends of words. A text is cut into words by the vocabulary's own pattern; words not
    known yet go through the library, many in one text, and their ids are told apart
    by the ends. Words of letters only, nearly all, are whole pieces of that pattern, so
    they go through the library's model without its pattern. Ids are kept for words and
    for runs without white space, so each is encoded about once, not at each place."""

    # Words and runs kept unless the texts taken at a time have more, the words sent to
    # the library at a time, and the characters taken at a time, few enough for a CPU's
    # caches. A worker keeps words between tasks and stages, so they count in whatever runs
    # after. Those that came back since the last clearing outlive the next one.
    most, step, chars = 200_000, 256, 64 << 10

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._model = Tokenizer.from_file(path)
        self._model.no_truncation()
        self._model.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix = spec["model"]["end_of_word_suffix"]
        steps = spec["pre_tokenizer"]["pretokenizers"]
        split = next(p for p in steps if p["type"] == "Split")
        self._cut = regex.compile(split["pattern"]["Regex"]).findall
        cut = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"} if p is split else p for p in steps]}
        self._letters_model = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": cut, "truncation": None, "padding": None}))
        vocab = self._model.get_vocab()
        self._ends = np.zeros(max(vocab.values()) + 1, bool)
        self._ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self._known: dict[str, bytes] = {}
        self._again: set[str] = set()
        self._letters: dict[str, bool] = {}

    def _encode(self, batch: list[str], model=None) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in (model or self._model).encode_batch_fast(batch, add_special_tokens=False)]

    def _is_letter(self, c: str) -> bool:
        """Whether the library, too, leaves a letter as it is and within its word."""
        if c not in self._letters:
            word = f"a{c}a"
            same = self._model.normalizer.normalize_str(word) == word
            self._letters[c] = same and len(self._model.pre_tokenizer.pre_tokenize_str(word)) == 1
        return self._letters[c]

    def _learn(self, new: list[str]) -> None:
        words = [w for w in new if w.isalpha()]
        odd = {c for c in set("".join(words)) if not self._is_letter(c)}
        if odd:
            words = [w for w in words if odd.isdisjoint(w)]
        self._learn_by(self._letters_model, words)
        if len(words) < len(new):
            whole = set(words)
            self._learn_by(self._model, [w for w in new if w not in whole])

    def _learn_by(self, model, new: list[str]) -> None:
        for start in range(0, len(new), self.step):
            part = new[start : start + self.step]
            ids = self._encode([" ".join(part)], model)[0]
            stops = ((np.flatnonzero(self._ends[ids]) + 1) * 4).tolist()
            if len(stops) != len(part):
                if len(part) == 1:  # the library cuts it into several words
                    self._known[part[0]] = self._encode(part)[0].tobytes()
                else:  # look for the word that it cuts otherwise
                    self._learn_by(model, part[: len(part) // 2])
                    self._learn_by(model, part[len(part) // 2 :])
                continue
            flat = ids.tobytes()
            self._known.update(zip(part, (flat[a:b] for a, b in zip([0, *stops], stops))))

    @staticmethod
    def _plain(text: str) -> bool:
        """Special tokens, separators that only Python knows, letters whose lower case
        hangs on what stands around them, and code points that Python's tables don't
        know need the whole text."""
        split_only = "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
        return not (split_only or unsettled(text) or "<|" in text or "\u03a3" in text or "\u0130" in text)

    def _words(self, chunk: str) -> list[str]:
        """The words of a run without white space; most are letters and a stop."""
        if chunk.isalpha():
            return [chunk]
        if chunk[-1] in ".,!?;:" and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self._cut(chunk)

    def _part(self, batch: list[str]) -> list[bytes]:
        out: dict[int, bytes] = {}
        cut: dict[int, list[str]] = {}
        for i, text in enumerate(batch):
            if self._plain(text):
                cut[i] = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower().split()
            else:
                out[i] = self._encode([text])[0].tobytes()
        needed: set[str] = set().union(*cut.values())
        new = needed.difference(self._known)
        old = needed - new
        words = {c: self._words(c) for c in new if not c.isalpha()}
        fresh = new.difference(words).union(*words.values()).difference(self._known)
        if len(self._known) + len(fresh) + len(words) > self.most:
            kept = old.union(w for ws in words.values() for w in ws if w in self._known)
            if len(self._again) <= self.most // 4 * 3:
                kept |= self._again
            self._known = {w: self._known[w] for w in kept}
            self._again = set()
        self._again |= old
        self._learn(list(fresh))
        known = self._known.__getitem__
        self._known.update([(c, b"".join(map(known, ws))) for c, ws in words.items() if ws != [c]])
        for i, chunks in cut.items():
            out[i] = b"".join(map(known, chunks))
        return [out[i] for i in range(len(batch))]

    def batch(self, batch: list[str]) -> list[bytes]:
        out: list[bytes] = []
        part: list[str] = []
        held = 0
        for text in batch:
            part.append(text)
            held += len(text)
            if held >= self.chars:
                out += self._part(part)
                part, held = [], 0
        return out + self._part(part)


_MODELS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _MODELS:
        _MODELS[path] = WordIds(path)
    return _MODELS[path]


def pack_documents(
    df: DataFrame, path: str, end_id: int = 2, lengths: tuple[int, ...] = LENGTHS,
    group_tokens: int = GROUP_TOKENS, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per piece: the key, ``start``, ``length``, ``ids`` (binary), its
    ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``, ``window`` (the length
    the sequence is padded to) and ``step_group``."""
    kind = df.schema[key].dataType.simpleString()
    names = [key, "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group"]
    types = [None, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    end = int(end_id).to_bytes(4, "little")

    def flush(keys: list, ids: list[bytes], first: int, key_type: pa.DataType) -> tuple[list[pa.RecordBatch], int]:
        totals = [len(x) // 4 for x in ids]
        windows = pack(totals, lengths)
        columns: list[list] = [[] for _ in names]
        for number, ((window, pieces), group) in enumerate(zip(windows, steps(windows))):
            offset = 0
            for doc, start, size in pieces:
                part = ids[doc][4 * start : 4 * (start + size)]
                for column, value in zip(columns, (keys[doc], start, size, part, zlib.crc32(part), totals[doc], first + number, offset, window, group)):
                    column.append(value)
                offset += size
        arrays = [pa.array(c, t or key_type) for c, t in zip(columns, types)]
        batch = pa.RecordBatch.from_arrays(arrays, names)
        return list(slices(iter([batch]))), first + len(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_ids(path)
        sequence = TaskContext.get().partitionId() << 40
        keys: list = []
        ids: list[bytes] = []
        held, key_type = 0, None
        for batch in slices(batches):
            key_type = batch.column(0).type
            for k, x in zip(batch.column(0).to_pylist(), model.batch(texts(batch.column(1)))):
                keys.append(k)
                ids.append(x + end)
                held += len(x) // 4 + 1
                if held >= group_tokens:
                    out, sequence = flush(keys, ids, sequence, key_type)
                    keys, ids, held = [], [], 0
                    yield from out
        if keys:
            out, sequence = flush(keys, ids, sequence, key_type)
            yield from out

    schema = f"`{key}` {kind}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window int, step_group int"
    return df.select(key, text).mapInArrow(run, schema)
