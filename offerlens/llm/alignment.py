"""Alignment of two tokenizers' tokens over the same bytes, by merge paths.

Tokens of A and B that cover a text are two rising lists of byte ends. Merged, they
cut the text into stretches that one token of each covers: each stretch is one link
of two overlapping tokens, and each end that both lists have closes a group.

The lists of all texts of a batch are merged as one. Binary searches along diagonals
of the merge grid divide it into pieces of ``WORK`` ends each, whatever the lengths of
the texts, so one long text is as many pieces as its length asks for. A piece needs
only its two stretches of ends and the end before: it emits its links and the ends at
which both tokens close. A group that goes over the border of two pieces is stitched
there, from the last close of the earlier and the first close of the later one.

How many documents hold a pair of ids linked is counted over all documents: pairs are
made distinct per document, summed per task and then per pair. The counts are sent to
all tasks where there are at most ``PAIRS_SENT`` of them (checked); beyond that, the
pairs of the documents are joined with the counts by pair and salt.

Texts that are null or empty, or whose joined token bytes differ from a space and the
text, have no tokens: zeros and an empty list. Repeated rows are documents of their
own, also in the counts; a null key is a key like others; an empty table gives an
empty one. Only the key and the text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm.arrow import slices, texts
from offerlens.session import checkpoint_folder

WORK = 1 << 15  # ends in a piece of the merge
BATCH_BYTES = 1 << 20  # text encoded at once; the library holds about 100 bytes a token
PAIRS_SENT = 4_000_000  # pairs whose counts are sent to the tasks, 13 bytes each
PAIRS_HELD = 4_000_000  # distinct pairs of documents that a task sums at once
SALTS = 8


# Merging ---------------------------------------------------------------------
def diagonals(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """How many ends of ``a`` and ``b`` lie before each cut of the merge, cuts being
    ``work`` ends apart. Of equal ends that of ``a`` comes first. All cuts are searched
    at once; each depends on nothing but its own diagonal."""
    cuts = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    low, high = np.maximum(0, cuts - len(b)), np.minimum(cuts, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        # The end a[mid] lies before the cut if it isn't behind b's last one there.
        before = np.zeros(len(cuts), bool)
        at = np.flatnonzero(open_)
        before[at] = a[mid[at]] <= b[cuts[at] - mid[at] - 1]
        low, high = np.where(open_ & before, mid + 1, low), np.where(open_ & ~before, mid, high)
    return low, cuts - low


@dataclass(frozen=True)
class Piece:
    """Links of one piece as places in both lists, and places where both close."""

    link_a: np.ndarray
    link_b: np.ndarray
    close_a: np.ndarray
    close_b: np.ndarray


def merge_piece(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> Piece:
    """The stretch ``a[i0:i1]``, ``b[j0:j1]`` of the merge. Beyond it only a[i0 - 1],
    a[i1] and b[j1] count, the neighbours across the cuts."""
    own_a, own_b = a[i0:i1], b[j0:j1]
    ia, ja = np.arange(i0, i1), j0 + np.searchsorted(own_b, own_a, "left")
    jb, ib = np.arange(j0, j1), i0 + np.searchsorted(own_a, own_b, "left")
    # b's end is a stretch of its own unless a has it too: in the piece or just before.
    fresh = np.ones(j1 - j0, bool)
    inside = ib < i1
    fresh[inside] = a[ib[inside]] != own_b[inside]
    if i0 and j1 > j0 and a[i0 - 1] == own_b[0]:
        fresh[0] = False
    both = np.zeros(i1 - i0, bool)
    known = ja < len(b)
    both[known] = b[ja[known]] == own_a[known]
    link_a, link_b = np.concatenate([ia, ib[fresh]]), np.concatenate([ja, jb[fresh]])
    order = np.argsort(link_a + link_b, kind="stable")
    return Piece(link_a[order], link_b[order], ia[both], ja[both])


@dataclass(frozen=True)
class Merge:
    """All links, and for each group the number of tokens up to its end."""

    link_a: np.ndarray
    link_b: np.ndarray
    stop_a: np.ndarray
    stop_b: np.ndarray


def merge(a: np.ndarray, b: np.ndarray, work: int = WORK) -> Merge:
    """The merge of two rising lists with the same last end, piece by piece."""
    i, j = diagonals(a, b, work)
    pieces = [merge_piece(a, b, *x) for x in zip(i[:-1].tolist(), i[1:].tolist(), j[:-1].tolist(), j[1:].tolist())]
    none = np.zeros(0, np.int64)
    # Stitching: a group is what lies between two closes, in whichever pieces they are.
    return Merge(*(
        np.concatenate([none, *(getattr(p, name) for p in pieces)]) + step
        for name, step in (("link_a", 0), ("link_b", 0), ("close_a", 1), ("close_b", 1))
    ))


# Tokens ----------------------------------------------------------------------
# Characters that some library may take for white space, now or in an older Unicode.
_MAYBE_SPACE = frozenset(" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2028\u2029\u202f\u205f\u2060\u3000\ufeff") | {chr(x) for x in range(0x2000, 0x2010)}


def cut_at_spaces(text: str) -> list[str]:
    """The text cut at single spaces between two characters that surely are none; a
    space and a part behind it are tokens of their own in both vocabularies. Other
    white space stays inside its part."""
    parts = text.split(" ")
    if all(p and p[0] not in _MAYBE_SPACE and p[-1] not in _MAYBE_SPACE for p in set(parts)):
        return parts
    out: list[list[str]] = [[parts[0]]]
    for p in parts[1:]:
        before = out[-1][-1]
        if p and before and p[0] not in _MAYBE_SPACE and before[-1] not in _MAYBE_SPACE:
            out.append([p])
        else:
            out[-1].append(p)
    return [" ".join(x) for x in out]


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones
    of Latin-1 for themselves, the others from code point 256 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in set(plain)]
    return {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(rest)}


class Pair:
    """Both vocabularies: ids of texts, bytes of ids, and the ids as decimal text. Parts
    between spaces are encoded once and kept, where no token of either side can reach
    over the space; this is read off the vocabularies."""

    most, long, step = 300_000, 64, 2_048  # parts kept, 0.1 GB; their characters; parts encoded in one text

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(path_a)
        self._a.no_truncation()
        self._a.no_padding()
        self._a.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_alphabet()
        vocab = self._a.get_vocab()
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.bytes_b = []
        for i in range(self._b.get_piece_size()):
            piece = self._b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self._b.is_byte(i) else piece.replace("▁", " ").encode())
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec["pre_tokenizer"] or {}
        self._cuts = (
            spec["normalizer"] is None and cut.get("type") == "ByteLevel" and bool(cut.get("use_regex"))
            and not any("▁" in self._b.id_to_piece(i).lstrip("▁") for i in range(len(self.bytes_b)))
            and [self._b.id_to_piece(i) for i in self._b.encode("a  a")].count("▁") == 1
        )
        self._known: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.sizes_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.sizes_b = np.array([len(x) for x in self.bytes_b], np.int64)
        # Each id followed by what may stand behind it: 0 another id, 1 the end of its side.
        self._names_a = np.array([[f"{i},", f"{i}|"] for i in range(len(self.bytes_a))], object)
        self._names_b = np.array([[f"{i},", f"{i};"] for i in range(len(self.bytes_b))], object)

    @property
    def n_b(self) -> int:
        return len(self.bytes_b)

    def _alone(self, parts: list[str], ids: tuple[dict[str, bytes], dict[str, bytes]]) -> None:
        """Adds the ids of each part with a space before it; parts that the ids don't
        spell get none."""
        found_a = [e.ids for e in self._a.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)]
        found_b = self._b.encode(parts, num_threads=1) if parts else []
        for part, x, y in zip(parts, found_a, found_b):
            want = b" " + part.encode()
            if b"".join(map(self.bytes_a.__getitem__, x)) == want == b"".join(map(self.bytes_b.__getitem__, y)):
                ids[0][part], ids[1][part] = np.array(x, "<i4").tobytes(), np.array(y, "<i4").tobytes()

    def _together(self, parts: list[str], ids: tuple[dict[str, bytes], dict[str, bytes]]) -> None:
        """The same for parts without white space at their ends, many in one text; tokens
        end where parts end."""
        text = " ".join(parts)
        want = b" " + text.encode()
        stops = np.cumsum([len(p.encode()) + 1 for p in parts])
        found = [], []
        for side, sizes, spelling, x in (
            (0, self.sizes_a, self.bytes_a, self._a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids),
            (1, self.sizes_b, self.bytes_b, self._b.encode([text], num_threads=1)[0]),
        ):
            if b"".join(map(spelling.__getitem__, x)) != want:
                return self._alone(parts, ids)
            flat = np.array(x, "<i4")
            at = (4 * (np.searchsorted(np.cumsum(sizes[flat]), stops) + 1)).tolist()
            data = flat.tobytes()
            found[side].extend(data[i:j] for i, j in zip([0, *at], at))
        for own, side in zip(ids, found):
            own.update(zip(parts, side))

    def encode(self, batch: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of each text in both vocabularies; None where they don't spell it."""
        cut = [(cut_at_spaces(t) if self._cuts else [t]) if t else [] for t in batch]
        needed = set().union(*cut)
        if len(self._known[0]) > self.most:
            self._known = tuple({p: side[p] for p in needed & side.keys()} for side in self._known)
        new = needed - self._known[0].keys()
        edged = [p for p in new if not self._cuts or p[0] in _MAYBE_SPACE or p[-1] in _MAYBE_SPACE]
        plain = list(new.difference(edged))
        for start in range(0, len(plain), self.step):
            self._together(plain[start : start + self.step], self._known)
        self._alone(edged, self._known)
        bad = new - self._known[0].keys()
        ids = [side.__getitem__ for side in self._known]
        out = [
            tuple(np.frombuffer(b"".join(map(get, parts)), "<i4").astype(np.int64) for get in ids) if parts and (not bad or bad.isdisjoint(parts)) else None
            for parts in cut
        ]
        for part in [p for p in new if len(p) > self.long]:
            for side in self._known:
                side.pop(part, None)
        return out

    def groups_text(self, a: np.ndarray, b: np.ndarray, stop_a: np.ndarray, stop_b: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``: the ids of each group."""
        if not len(a):
            return ""
        end_a, end_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        end_a[stop_a - 1], end_b[stop_b - 1] = 1, 1
        group_a, group_b = np.searchsorted(stop_a, np.arange(len(a)), "right"), np.searchsorted(stop_b, np.arange(len(b)), "right")
        parts = np.empty(len(a) + len(b), object)
        # A token stands behind its own side and what the other side has in earlier groups.
        parts[np.arange(len(a)) + np.concatenate([[0], stop_b])[group_a]] = self._names_a[a, end_a]
        parts[np.arange(len(b)) + stop_a[group_b]] = self._names_b[b, end_b]
        return "".join(parts.tolist())[:-1]


_PAIRS: dict[tuple[str, str], Pair] = {}


def vocabularies(path_a: str, path_b: str) -> Pair:
    if (path_a, path_b) not in _PAIRS:
        _PAIRS[path_a, path_b] = Pair(path_a, path_b)
    return _PAIRS[path_a, path_b]


@dataclass(frozen=True)
class Aligned:
    """One text: ids of both sides, their links and groups, places counted in the text."""

    a: np.ndarray
    b: np.ndarray
    merge: Merge


_NO_IDS = np.zeros(0, np.int64)
_NOTHING = Aligned(_NO_IDS, _NO_IDS, Merge(_NO_IDS, _NO_IDS, _NO_IDS, _NO_IDS))


def align_batch(pair: Pair, batch: list[str], work: int = WORK) -> list[Aligned]:
    """All texts of a batch in one merge, dealt back to the texts."""
    found = pair.encode(batch)
    own = [x for x in found if x is not None]
    if not own:
        return [_NOTHING] * len(batch)
    # The texts lie one behind the other, so ends rise over all of them.
    a, b = np.concatenate([x for x, _ in own]), np.concatenate([y for _, y in own])
    all_ = merge(np.cumsum(pair.sizes_a[a]), np.cumsum(pair.sizes_b[b]), work)
    stops_a, stops_b = np.cumsum([len(x) for x, _ in own]), np.cumsum([len(y) for _, y in own])
    links = np.searchsorted(all_.link_a, stops_a, "left")
    groups = np.searchsorted(all_.stop_a, stops_a, "right")
    out = []
    at_a = at_b = at_link = at_group = 0
    for (x, y), na, nb, nl, ng in zip(own, stops_a.tolist(), stops_b.tolist(), links.tolist(), groups.tolist()):
        out.append(Aligned(x, y, Merge(
            all_.link_a[at_link:nl] - at_a, all_.link_b[at_link:nl] - at_b, all_.stop_a[at_group:ng] - at_a, all_.stop_b[at_group:ng] - at_b,
        )))
        at_a, at_b, at_link, at_group = na, nb, nl, ng
    rest = iter(out)
    return [next(rest) if x is not None else _NOTHING for x in found]


# Tables ----------------------------------------------------------------------
def align(df: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", work: int = WORK) -> DataFrame:
    """Each document with its tokens and groups: ``a_ids``, ``b_ids``, and for each
    group the number of tokens up to its end, ``a_stops`` and ``b_stops``."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = vocabularies(path_a, path_b)
        for batch in slices(batches, BATCH_BYTES):
            rows = align_batch(pair, texts(batch.column(1)), work)
            lists = [[r.a for r in rows], [r.b for r in rows], [r.merge.stop_a for r in rows], [r.merge.stop_b for r in rows]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.list_(pa.int64())).cast(pa.list_(pa.int32())) for x in lists)],
                [key, "a_ids", "b_ids", "a_stops", "b_stops"],
            )

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, a_ids array<int>, b_ids array<int>, a_stops array<int>, b_stops array<int>")


def _packed(codes: np.ndarray) -> bytes:
    """Rising codes as their steps, equal bytes of all steps together, which the file
    format then presses."""
    return np.ascontiguousarray(np.diff(codes, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i8").reshape(-1))


def _measured(df: DataFrame, path_a: str, path_b: str, key: str, text: str, work: int) -> DataFrame:
    """Each document with a number of its own row, its counts, the digest of its groups,
    and its distinct linked pairs with their times, kept for the second pass."""
    kind = df.schema[key].dataType.simpleString()
    names = ["row", key, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = vocabularies(path_a, path_b)
        number = TaskContext.get().partitionId() << 40
        for batch in slices(batches, BATCH_BYTES):
            columns: list[list] = [[] for _ in names[2:]]
            for r in align_batch(pair, texts(batch.column(1)), work):
                m = r.merge
                codes, times = np.unique(r.a[m.link_a] * pair.n_b + r.b[m.link_b], return_counts=True)
                shown = pair.groups_text(r.a, r.b, m.stop_a, m.stop_b)
                values = (
                    len(r.a), len(r.b), len(m.stop_a), len(m.link_a), hashlib.sha256(shown.encode()).hexdigest() if shown else "",
                    _packed(codes), times.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(),
                )
                for column, value in zip(columns, values):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
            rows = pa.array(np.arange(number, number + batch.num_rows))
            number += batch.num_rows
            yield pa.RecordBatch.from_arrays([rows, batch.column(0), *map(pa.array, columns, kinds)], names)

    return df.select(key, text).mapInArrow(
        run, f"row long, `{key}` {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
    )


def pair_counts(measured: DataFrame, n_b: int) -> DataFrame:
    """``pair`` (a * ``n_b`` + b), ``held`` (documents that hold it linked) and ``best``
    (no pair of the same A id is held by more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def summed() -> pa.RecordBatch:
            codes, counts = np.unique(np.concatenate([_NO_IDS, *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts.astype(np.int64))], ["pair", "held"])

        for batch in slices(batches):
            for data in batch.column(0).to_pylist():
                held.append(_unpacked(data))
                size += len(held[-1])
                if size >= PAIRS_HELD:
                    yield summed()
                    held, size = [], 0
        yield summed()

    counts = measured.select("pairs").mapInArrow(run, "pair long, held long").groupBy("pair").agg(F.sum("held").alias("held"))
    top = counts.groupBy(F.expr(f"pair div {n_b}").alias("a")).agg(F.max("held").alias("top"))
    return counts.withColumn("a", F.expr(f"pair div {n_b}")).join(top, "a").select("pair", "held", (F.col("held") == F.col("top")).alias("best"))


def _sent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The counts as three arrays in order of pairs; only called below ``PAIRS_SENT``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [pa.array([x.to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for x in batch.columns]
            yield pa.RecordBatch.from_arrays(data, ["pair", "held", "best"])

    rows = counts.select("pair", "held", "best").mapInArrow(run, "pair binary, held binary, best binary").collect()
    pair, held, best = (np.concatenate([np.zeros(0, t), *(np.frombuffer(r[c], t) for r in rows)]) for c, t in (("pair", "<i8"), ("held", "<i8"), ("best", "?")))
    order = np.argsort(pair)
    return pair[order], held[order].astype(np.int64), best[order]


def _rated_here(measured: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    sent = measured.sparkSession.sparkContext.broadcast(_sent(counts))
    kept = [c for c in measured.columns if c not in ("row", "pairs", "times")]
    kinds = ", ".join(f"`{c}` {measured.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, held, best = sent.value
        for batch in slices(batches):
            n_best, total = [], []
            for codes, times in zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist()):
                at = np.searchsorted(pair, _unpacked(codes))
                many = np.ascontiguousarray(np.frombuffer(times, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)
                n_best.append(int(many[best[at]].sum()))
                total.append(int(many @ held[at]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(n_best, pa.int64()), pa.array(total, pa.int64())], [*kept, "n_best", "count_sum"])

    return measured.drop("row").mapInArrow(run, f"{kinds}, n_best long, count_sum long")


def _rated_apart(measured: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """The same by a join on pair and salt, for counts of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH_BYTES):
            found = [_unpacked(x) for x in batch.column(1).to_pylist()]
            many = [np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1) for x in batch.column(2).to_pylist()]
            rows = np.repeat(batch.column(0).to_numpy(), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([
                pa.array(rows), pa.array(np.concatenate([_NO_IDS, *found])), pa.array(np.concatenate([_NO_IDS, *many]).astype(np.int64)),
            ], ["row", "pair", "times"])

    links = measured.select("row", "pairs", "times").mapInArrow(run, "row long, pair long, times long").withColumn("salt", F.pmod("row", F.lit(SALTS)))
    salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    sums = links.join(salted, ["pair", "salt"]).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("held")).alias("count_sum"))
    whole = measured.drop("pairs", "times").join(sums, "row", "left").drop("row")
    return whole.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_best", "count_sum")})


def aligned_documents(
    df: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", work: int = WORK, pairs_sent: int = PAIRS_SENT,
) -> DataFrame:
    """One row per document: the key, ``n_a``, ``n_b``, ``n_groups``, ``n_links``,
    ``groups_sha256``, and over its links ``n_best`` (held by most documents of all pairs
    of their A id) and ``count_sum`` (documents that hold the pair)."""
    spark = df.sparkSession
    place = f"{checkpoint_folder(spark)}/alignment-{os.urandom(8).hex()}"
    _measured(df, path_a, path_b, key, text, work).write.option("compression", "zstd").parquet(f"{place}/documents")
    measured = spark.read.parquet(f"{place}/documents")
    pair_counts(measured, vocabularies(path_a, path_b).n_b).write.parquet(f"{place}/pairs")
    counts = spark.read.parquet(f"{place}/pairs")
    rate: Callable[[DataFrame, DataFrame, str], DataFrame] = _rated_here if counts.count() <= pairs_sent else _rated_apart
    return rate(measured, counts, key)
