"""Repeated passages by collinear chaining of shared word seeds.

1. Seeds are the minimizers of a text's k-word runs: of every ``WINDOW`` runs in a row
   the one of least hash, so any shared run of ``K + WINDOW - 1`` words shares a seed.
2. Each seed is joined with its first holder, the least (key, position). A seed that
   a third of all texts hold gives one match for each of them, never pairs.
3. Matches of a text with one first holder are chained in order: a Fenwick tree over
   the holder's positions gives the best predecessor of each match, scored by words
   matched less a cost for the gap.
4. Chains are aligned word by word between their matches and beyond their ends, which
   gives exact borders and the share of equal words, so edited passages are found too.
   Chains also join passages across foreign text; they are taken apart there.
5. A run of aligned passages that covers at least ``LEAST`` words of a text in a row is
   reported, with each passage's first holder; none that lies within another one of the
   same holder.

Only texts in chains travel, packed. Rows without key or text, and texts of fewer
words than ``LEAST``, hold no passage. Repeated rows are one text. Keys are integers.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice
from operator import ne

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm.arrow import lists, map_batches, raw_texts
from offerlens.llm.scratch import Scratch
from offerlens.llm.shingles import rolling, word_hashes, words

K, WINDOW = 6, 16
MARGIN = 64  # words of the holder beyond a chain that travel at first; where they don't do, more follow
AT_ONCE = 32  # words that an extension compares at a time
AHEAD = 8  # words beyond its end that an extension looks at
LEAST, PIECE = 50, 20  # words of a reported run, and of a passage within it
GAP = 0.1  # cost of a skipped word on either side, in matched words
IDENTITY = 0.8
WIDE = 20  # a chain may be taken apart between matches with more unequal words than that
NESTED = 2 << 20  # bytes of a batch of nested numbers


def seeds(text: bytes, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and word positions of a text's minimizers."""
    tokens = word_hashes(text)
    if len(tokens) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = rolling(tokens, k)
    # The first least place of every window, from windows half as wide; places never fall.
    span, width = min(window, len(hashes)), 1
    at, least = np.arange(len(hashes)), hashes
    while width < span:
        step = min(width, span - width)
        less = least[step:] < least[:-step]
        at, least = np.where(less, at[step:], at[:-step]), np.where(less, least[step:], least[:-step])
        width += step
    fresh = np.ones(len(at), bool)
    fresh[1:] = at[1:] != at[:-1]
    return least[fresh], at[fresh]


def seed_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """(seed, doc, at) of every text."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [seeds(t) for t in raw_texts(batch.column(1))]
            lengths = np.fromiter((len(a) for a, _ in found), np.int64, len(found))
            hashes = np.concatenate([h for h, _ in found]) if found else np.zeros(0, np.uint64)
            at = np.concatenate([a for _, a in found]) if found else np.zeros(0, np.int64)
            docs = np.repeat(np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64), lengths)
            return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(docs), pa.array(at.astype(np.int32))], ["seed", "doc", "at"])

        return apply

    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("t")).filter("doc is not null and t is not null")
    return map_batches(rows, make, "seed long, doc long, at int")


class Fenwick:
    """Prefix maxima over ranks, with the place that each came from."""

    def __init__(self, size: int):
        self.best: list[tuple[float, int]] = [(0.0, -1)] * (size + 1)

    def put(self, rank: int, value: float, place: int) -> None:
        rank += 1
        while rank < len(self.best):
            if value > self.best[rank][0]:
                self.best[rank] = (value, place)
            rank += rank & -rank

    def below(self, rank: int) -> tuple[float, int]:
        """The maximum over lesser ranks."""
        out = (0.0, -1)
        while rank > 0:
            if self.best[rank][0] > out[0]:
                out = self.best[rank]
            rank -= rank & -rank
        return out


def chains(matches: list[tuple[int, int]], k: int = K, gap: float = GAP) -> list[list[tuple[int, int]]]:
    """Disjoint chains of matches (own position, other position), best first. With
    cost ``gap`` a word on either side, a predecessor's worth at a match is its score
    plus ``gap`` times its place, less ``gap`` times the match's own place."""
    matches = sorted(set(matches))
    if len(matches) == 1:
        return [matches]
    ranks = sorted({y for _, y in matches})
    tree = Fenwick(len(ranks))
    score, before = [0.0] * len(matches), [-1] * len(matches)
    start = 0
    while start < len(matches):
        stop = start
        while stop < len(matches) and matches[stop][0] == matches[start][0]:
            x, y = matches[stop]
            value, place = tree.below(bisect_left(ranks, y))
            gain = value - gap * (x + y)
            if place >= 0 and gain > 0:
                score[stop], before[stop] = k + gain, place
            else:
                score[stop] = float(k)
            stop += 1
        for i in range(start, stop):
            x, y = matches[i]
            tree.put(bisect_left(ranks, y), score[i] + gap * (x + y), i)
        start = stop
    used = [False] * len(matches)
    out = []
    for i in sorted(range(len(matches)), key=lambda i: (-score[i], i)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(matches[i])
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


LCS_BITS = 1 << 27  # bits of the rows that one traceback holds; longer runs are halved first


def _lcs_rows(a: list[bytes], b: list[bytes]) -> Iterator[int]:
    """For each word of ``a``: the row of the table of longest common subsequences, as
    bits over ``b`` that are 0 where the length grows."""
    at: dict[bytes, int] = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & at.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _grown(row: int, size: int) -> np.ndarray:
    """Lengths for every prefix of ``b``, the empty one first."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-size // 8), "little"), np.uint8), bitorder="little")[:size]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _last_row(a: list[bytes], b: list[bytes]) -> int:
    row = (1 << len(b)) - 1
    for row in _lcs_rows(a, b):
        pass
    return row


def gap_equal(a: list[bytes], b: list[bytes]) -> int:
    """Words in common, in order, of two runs of any length."""
    return len(b) - _last_row(a, b).bit_count() if a and b else 0


def common(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """The places of what ``gap_equal`` counts."""
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > LCS_BITS:
        half = len(a) // 2
        ahead = _grown(_last_row(a[:half], b), len(b))
        back = _grown(_last_row(a[half:][::-1], b[::-1]), len(b))[::-1]
        cut_at = int((ahead + back).argmax())
        return common(a[:half], b[:cut_at]) + [(half + i, cut_at + j) for i, j in common(a[half:], b[cut_at:])]
    rows = [(1 << len(b)) - 1, *_lcs_rows(a, b)]
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i] >> (j - 1) & 1:  # nothing is gained by this word of b
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:  # nor by this word of a
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def _extend(a: list[bytes], b: list[bytes], i: int, j: int, step: int) -> list[tuple[int, int]]:
    """Go on from the words i, j that are equal; up to four changed words, an added or a
    lost one are passed where at least three equal words follow. Returns the pairs of equal words gained."""
    gained: list[tuple[int, int]] = []
    while True:
        if step > 0:
            ahead = min(len(a) - i - 1, len(b) - j - 1, AT_ONCE)
            unequal = list(map(ne, a[i + 1 : i + 1 + ahead], b[j + 1 : j + 1 + ahead]))
        else:
            ahead = min(i, j, AT_ONCE)
            unequal = list(map(ne, a[i - ahead : i][::-1], b[j - ahead : j][::-1]))
        same = (unequal.index(True) if True in unequal else ahead) * step
        gained += zip(range(i + step, i + step + same, step), range(j + step, j + step + same, step))
        i, j = i + same, j + same
        if abs(same) == AT_ONCE:
            continue
        for di, dj in ((1, 1), (1, 0), (0, 1), (2, 2), (3, 3), (4, 4)):
            x, y = i + (1 + di) * step, j + (1 + dj) * step
            u, v = x + step, y + step
            last, other = u + step, v + step
            if 0 <= last < len(a) and 0 <= other < len(b) and a[x] == b[y] and a[u] == b[v] and a[last] == b[other]:
                i, j = x, y
                gained.append((i, j))
                break
        else:
            return gained


def _runs(chain: list[tuple[int, int]], k: int) -> list[list[int]]:
    """A chain's runs of equal words (place in ``a``, place in ``b``, words), apart."""
    out = [[*chain[0], k]]
    for x, y in chain[1:]:
        i, j, n = out[-1]
        if x < i + n or y < j + n:
            if x - y == i - j and x + k > i + n:  # overlaps on the same diagonal
                out[-1][2] = x + k - i
        else:
            out.append([x, y, k])
    return out


Passage = tuple[int, int, int, int, int]


class Alignment:
    """A chain's runs of equal words with what is equal between them."""

    def __init__(self, a: list[bytes], b: list[bytes], chain: list[tuple[int, int]], k: int = K):
        self.a, self.b, self.runs = a, b, _runs(chain, k)
        self.wide: list[tuple[int, int]] = []  # unequal words, run before them
        self.equal = [0, self.runs[0][2]]  # in the runs before, with the gaps between them
        for at, ((i, j, n), (x, y, m)) in enumerate(zip(self.runs, self.runs[1:])):
            same = gap_equal(a[i + n : x], b[j + n : y])
            apart = max(x - i - n, y - j - n) - same
            if apart > WIDE and apart > same:
                self.wide.append((apart, at))
            self.equal.append(self.equal[-1] + same + m)
        self._gained: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def _beyond(self, run: int, step: int) -> list[tuple[int, int]]:
        """Equal words from one end of a run on."""
        if (run, step) not in self._gained:
            i, j, n = self.runs[run]
            last = n - 1 if step > 0 else 0
            self._gained[run, step] = _extend(self.a, self.b, i + last, j + last, step)
        return self._gained[run, step]

    def cut_short(self, before: bool, after: bool) -> bool:
        """Whether an extension came as near to an end of ``b`` as it looks ahead, where
        more words stand before or after ``b``."""
        for (run, step), gained in self._gained.items():
            i, j, n = self.runs[run]
            end = gained[-1][1] if gained else j if step < 0 else j + n - 1
            if before and step < 0 and end < AHEAD or after and step > 0 and end >= len(self.b) - AHEAD:
                return True
        return False

    def whole(self, first: int, last: int) -> Passage:
        """Runs ``first`` to ``last`` as one passage."""
        ahead, beyond = self._beyond(first, -1), self._beyond(last, 1)
        start, other = ahead[-1] if ahead else self.runs[first][:2]
        i, j, n = self.runs[last]
        stop, other_stop = beyond[-1] if beyond else (i + n - 1, j + n - 1)
        gap = self.equal[first + 1] - self.runs[first][2]  # all before the first run
        return start, stop + 1, other, other_stop + 1, self.equal[last + 1] - gap + len(ahead) + len(beyond)

    def parts(self) -> list[Passage]:
        """Passages of equal words enough. The chain is parted at the widest gap as long
        as it holds too few, and where two passages that are long enough each are joined
        only by words that are mostly unequal. What is too unequal without such a gap is
        narrowed to its dense stretches."""
        out: list[Passage] = []
        todo = [(0, len(self.runs) - 1, sorted(self.wide, reverse=True))]
        while todo:
            first, last, wide = todo.pop()
            found = self.whole(first, last)
            enough = _alike(found)
            cuts = wide
            if enough:
                cuts = [(u, at) for u, at in wide if sum(self.runs[at][::2]) - found[0] >= LEAST and found[1] - self.runs[at + 1][0] >= LEAST]
            if cuts:
                at = cuts[0][1]
                todo.append((first, at, [w for w in wide if w[1] < at]))
                todo.append((at + 1, last, [w for w in wide if w[1] > at]))
            elif enough:
                out.append(found)
            else:
                out += dense(self._pairs(first, last))
        return sorted(out)

    def _pairs(self, first: int, last: int) -> list[tuple[int, int]]:
        out = self._beyond(first, -1)[::-1]
        for at in range(first, last + 1):
            i, j, n = self.runs[at]
            out += [(i + d, j + d) for d in range(n)]
            if at < last:
                x, y, _ = self.runs[at + 1]
                out += [(i + n + c, j + n + d) for c, d in common(self.a[i + n : x], self.b[j + n : y])]
        return out + self._beyond(last, 1)


def _alike(p: Passage) -> bool:
    return p[4] >= IDENTITY * max(p[1] - p[0], p[3] - p[2])


def dense(pairs: list[tuple[int, int]]) -> list[Passage]:
    """Maximal stretches of an alignment that hold equal words enough: segments of
    greatest sum where an equal word gains what keeps ``IDENTITY`` with an unequal one,
    then over short edits beyond their ends as far as they stay alike."""
    cost = IDENTITY / (1 - IDENTITY)
    apart = [0] + [max(x - i, y - j) - 1 for (i, j), (x, y) in zip(pairs, pairs[1:])]
    held: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum after
    done: list[tuple[int, int]] = []
    total = 0.0
    for at, gap in enumerate(apart):
        total -= cost * gap
        first, low, total = at, total, total + 1
        while True:
            k = len(held) - 1
            while k >= 0 and held[k][2] >= low:
                k -= 1
            if k < 0:
                done += [h[:2] for h in held]
                held = [(first, at, low, total)]
                break
            if held[k][3] >= total:
                held.append((first, at, low, total))
                break
            first, low = held[k][0], held[k][2]
            del held[k:]
    done += [h[:2] for h in held]
    passage = lambda f, t: (pairs[f][0], pairs[t][0] + 1, pairs[f][1], pairs[t][1] + 1, t - f + 1)
    out = []
    for at, (first, last) in enumerate(done):
        low = done[at - 1][1] + 1 if at else 0
        high = done[at + 1][0] - 1 if at + 1 < len(done) else len(pairs) - 1
        while first > low and apart[first] <= 4 and _alike(passage(first - 1, last)):
            first -= 1
        while last < high and apart[last + 1] <= 4 and _alike(passage(first, last + 1)):
            last += 1
        out.append(passage(first, last))
    return out


def align(a: list[bytes], b: list[bytes], chain: list[tuple[int, int]], k: int = K) -> Passage:
    """Borders (start, end in ``a``; start, end in ``b``; ends exclusive) and the number
    of equal words of a chain."""
    found = Alignment(a, b, chain, k)
    return found.whole(0, len(found.runs) - 1)


def _packed(df: DataFrame, key: str, text: str) -> DataFrame:
    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(pack, raw_texts(batch.column(1))), pa.binary())], ["doc", "blob"])

        return apply

    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("t")).filter("doc is not null and t is not null")
    return map_batches(rows, make, "doc long, blob binary")


def _in_runs(spans: list[tuple]) -> list[tuple]:
    """Of (start, stop, ...) in order, those within covered runs of ``LEAST`` words."""
    out: list[tuple] = []
    run: list[tuple] = []
    end = -1
    for span in spans:
        if run and span[0] > end:
            if end - run[0][0] >= LEAST:
                out += run
            run = []
        end = max(end, span[1]) if run else span[1]
        run.append(span)
    if run and end - run[0][0] >= LEAST:
        out += run
    return out


_SPANS = "array<struct<start:int,stop:int,other:long,other_start:int,other_stop:int,equal:int>>"


def _chained(matches: DataFrame) -> DataFrame:
    """(doc, other, chains): the chains of each text with one holder. A text's
    matches are as many as its seeds, so one row holds them."""
    grouped = matches.groupBy("doc").agg(F.collect_set(F.struct("other", "at", "other_at")).alias("m"))

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            docs, others, found = [], [], []
            rows = zip(*(c.to_numpy(zero_copy_only=False).tolist() for c in batch.column(1).flatten().flatten()))
            for doc, count in zip(batch.column(0).to_pylist(), batch.column(1).value_lengths().to_pylist()):
                by: dict[int, list[tuple[int, int]]] = {}
                for other, at, other_at in islice(rows, count):
                    by.setdefault(other, []).append((at, other_at))
                for other, pairs in by.items():
                    # Also lone seeds: only alignment tells how long a passage is whose
                    # other words are edited too often for seeds.
                    docs.append(doc)
                    others.append(other)
                    found.append([[v for m in c for v in m] for c in chains(pairs)])
            return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(others, pa.int64()), pa.array(found, pa.list_(pa.list_(pa.int32())))], ["doc", "other", "chains"])

        return apply

    return map_batches(grouped, make, "doc long, other long, chains array<array<int>>", NESTED)


def _with_held(chained: DataFrame, blobs: DataFrame, margin: int) -> DataFrame:
    """(doc, other, from, after, chain, held): each chain with its holder's words there and
    ``margin`` more on both sides, so that no whole text travels for a short match, and
    whether more words follow."""
    both = chained.join(blobs.withColumnRenamed("doc", "other"), "other").select("doc", "other", "chains", "blob")
    names = ["doc", "other", "from", "after", "chain", "held"]

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        pack, opened = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple] = []
            last: tuple[bytes, list[bytes]] = (b"", [])
            columns = [lists(c) if pa.types.is_list(c.type) else c.to_pylist() for c in batch.columns]
            for doc, other, found, blob in zip(*columns):
                if last[0] != blob:
                    last = (blob, words(opened(blob)))
                for flat in found:
                    start, stop = max(0, flat[1] - margin), flat[-1] + K + margin
                    out.append((doc, other, start, stop < len(last[1]), flat, pack(b" ".join(last[1][start:stop]))))
            columns = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

        return apply

    return map_batches(both, make, "doc long, other long, from int, after boolean, chain array<int>, held binary", NESTED)


def _aligned(chained: DataFrame, blobs: DataFrame, margin: int) -> DataFrame:
    """Passages of the chains, and for a chain whose passages may go on beyond the margin
    one row with the chain as ``wider`` instead."""
    both = _with_held(chained, blobs, margin).join(blobs, "doc").select("doc", "other", "from", "after", "chain", "held", "blob")
    names = ["doc", "start", "stop", "other", "other_start", "other_stop", "equal", "wider"]

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        opened = zstandard.ZstdDecompressor().decompress

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple] = []
            last: tuple[bytes, list[bytes]] = (b"", [])
            columns = [lists(c) if pa.types.is_list(c.type) else c.to_pylist() for c in batch.columns]
            for doc, other, start, after, flat, held, blob in zip(*columns):
                if last[0] != blob:
                    last = (blob, words(opened(blob)))
                chain = [(x, y - start) for x, y in zip(flat[::2], flat[1::2])]
                found = Alignment(last[1], opened(held).split(), chain)
                parts = found.parts()
                if found.cut_short(start > 0, after):
                    out.append((doc, None, None, other, None, None, None, flat))
                    continue
                out += [(doc, s, e, other, t + start, f + start, equal, None) for s, e, t, f, equal in parts if e - s >= PIECE]
            columns = list(zip(*out)) or [()] * 8
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

        return apply

    kinds = "doc long, start int, stop int, other long, other_start int, other_stop int, equal int, wider array<int>"
    return map_batches(both, make, kinds, NESTED)


def _all_aligned(chained: DataFrame, blobs: DataFrame, steps: Scratch) -> list[DataFrame]:
    """Passages of all chains as written tables. Chains that the margin cut short are
    aligned again with a wider one, up to the ends of their holders."""
    tables, todo, margin = [], chained, MARGIN
    while True:
        found = steps.keep(_aligned(todo, blobs, margin))
        tables.append(found)
        again = found.filter("wider is not null")
        if again.isEmpty():
            return tables
        todo, margin = again.select("doc", "other", F.array("wider").alias("chains")), margin * 8


def _widest(spans: list[dict]) -> list[dict]:
    """Without those that lie within another one of the same holder."""
    reach: dict[int, int] = {}
    out = []
    for x in sorted(spans, key=lambda x: (x["start"], -x["stop"])):
        if x["stop"] > reach.get(x["other"], -1):
            reach[x["other"]] = x["stop"]
            out.append(x)
    return out


def _long_runs(aligned: DataFrame) -> DataFrame:
    """(doc, spans): passages within covered runs of ``LEAST`` words."""
    grouped = aligned.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("start", "stop", "other", "other_start", "other_stop", "equal"))).alias("spans"))

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [
                [x[2] for x in _in_runs([(x["start"], x["stop"], x) for x in _widest(spans)])] for spans in batch.column(1).to_pylist()
            ]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, batch.column(1).type)], ["doc", "spans"])

        return apply

    return map_batches(grouped, make, f"doc long, spans {_SPANS}", NESTED).filter(F.size("spans") > 0)


def repeated_spans(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, spans) of the texts that repeat passages of texts with a lesser key, as a
    written table."""
    steps = Scratch(df.sparkSession, "passages")
    table = steps.keep(seed_table(df, key, text))
    first = table.groupBy("seed").agg(F.min(F.struct("doc", "at")).alias("f"), F.max("doc").alias("last")).filter("f.doc <> last")
    first = first.select("seed", F.col("f.doc").alias("other"), F.col("f.at").alias("other_at"))
    matches = table.join(first, "seed").filter("doc <> other").select("doc", "at", "other", "other_at")
    chained = steps.keep(_chained(matches))
    steps.drop(table)
    needed = chained.select("doc").union(chained.select("other")).distinct()
    blobs = steps.keep(_packed(df, key, text).join(needed, "doc", "left_semi").groupBy("doc").agg(F.min("blob").alias("blob")))
    tables = _all_aligned(chained, blobs, steps)
    steps.drop(chained, blobs)
    passages = reduce(DataFrame.unionAll, tables).filter("wider is null").drop("wider")
    spans = steps.keep(_long_runs(passages))
    steps.drop(*tables)
    return spans


def repeated_passages(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per passage: the key, its words [start_word, end_word), the text that
    first holds it with the words there, and how many words are equal."""
    rows = repeated_spans(df, key, text).select("doc", F.explode("spans").alias("s"))
    return rows.select(
        F.col("doc").alias(key), F.col("s.start").alias("start_word"), F.col("s.stop").alias("end_word"), F.col("s.other").alias(f"first_{key}"),
        F.col("s.other_start").alias("first_start_word"), F.col("s.other_stop").alias("first_end_word"), F.col("s.equal").alias("equal_words"),
    )


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and the white space that follows them."""
    raw = text.encode()
    starts, ends, at = [], [], 0
    for word in raw.split():
        at = raw.index(word, at)
        starts.append(at)
        at += len(word)
        ends.append(at)
    out, done = [], 0
    for start, stop in sorted(spans):
        start, stop = max(0, start), min(stop, len(starts))
        if start >= stop or ends[stop - 1] <= done:
            continue
        out.append(raw[done : max(done, starts[start])])
        done = starts[stop] if stop < len(starts) else len(raw)
    return b"".join([*out, raw[done:]]).decode()


def drop_repeated(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` without repeated passages: each stays where it is held first. Rows with
    nothing left go; rows that repeat nothing stay as they are. A column ``n_chars``
    follows the text."""
    columns = df.columns
    spans = repeated_spans(df, key, text).select(
        F.col("doc").alias("__doc"), F.transform("spans", lambda s: F.array(s["start"], s["stop"])).alias("__spans")
    )
    joined = df.join(spans, F.col(f"`{key}`").cast("long") == F.col("__doc"), "left").drop("__doc").select(*[F.col(f"`{c}`") for c in columns], "__spans")
    at, schema = columns.index(text), df.schema

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            new, keep = [], []
            for t, s in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist()):
                new.append(cut(t, [tuple(x) for x in s]) if s and t else t)
                keep.append(not s or bool(new[-1].strip()))
            out = list(batch.columns[: len(columns)])
            out[at] = pa.array(new, batch.column(at).type)
            if "n_chars" in columns and pa.types.is_integer(batch.column(columns.index("n_chars")).type):
                c = columns.index("n_chars")
                old = batch.column(c).to_pylist()
                out[c] = pa.array([len(t) if s and t is not None else o for t, s, o in zip(new, batch.column(len(columns)).to_pylist(), old)], batch.column(c).type)
            return pa.RecordBatch.from_arrays(out, columns).filter(pa.array(keep, pa.bool_()))

        return apply

    return map_batches(joined, make, schema)
