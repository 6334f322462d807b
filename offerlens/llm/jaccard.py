"""Exact self-join of documents by Jaccard similarity of word shingles, through the
relations between the sets.

1. Texts with equal sets form one class; everything below runs on classes.
2. Each set is ordered by (is the shingle frequent, hash) and indexed by its first
   shingles only, as many as any similar set must meet (prefix filter). Positions
   in that order bound the overlap that is still possible, so an index list is
   skipped wherever sizes or positions rule a pair out.
3. In each index list one set is the pivot. Every set of the list is compared with
   it, which is linear in the list. Sets that a pivot joins share its component.
4. The answers of the others follow from the pivot's: with distance ``1 - J`` being
   a metric, sets whose distances to the pivot differ by more than the threshold's
   can't be similar, and sets of one component need no comparison. Sketches of the
   sets' parities bound their difference from below. What this leaves open is compared
   exactly.

So a group of near copies of any size costs its pivots and a thin rest, never all
of its pairs, and no link is lost. Null, empty and blank texts have no shingles and
link with nothing; repeated rows share a class. A null key gets no component id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.llm.arrow import map_batches, raw_texts
from offerlens.llm.components import roots
from offerlens.llm.scratch import Scratch
from offerlens.llm.shingles import shingle_set

WORDS, PERCENT = 5, 80
TURNS = 1  # rounds of further tries before all that is left is compared
ODD = tuple(f"o{i}" for i in range(8))  # columns of a set's odd sketch, 64 places each
SHARED = 4  # shingles of their prefixes that similar sets share
FREQUENT, HOT = 2, 64  # a shingle in so many prefixes is ordered last; its list is dealt over parts
SALTS = 64  # parts of the list of a hot shingle
MARKS = 24  # bits of each table of shingles: 2 MB, whatever the input


def _pack(text: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(text)


def _open(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _halves(hashes: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(hashes.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def shingled(df: DataFrame, key: str, text: str, words: int = WORDS) -> DataFrame:
    """``key``, the set's size ``n`` and 128-bit fingerprint ``k1``, ``k2``."""
    kind = df.schema[key].dataType.simpleString()

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(t, words) for t in raw_texts(batch.column(1))]
            halves = np.array([_halves(s) for s in sets], np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], [key, "n", "k1", "k2"]
            )

        return apply

    return map_batches(df.select(key, text), make, f"`{key}` {kind}, n long, k1 long, k2 long")


def _each_set(df: DataFrame, text: str, words: int, doubled: frozenset[int], take: Callable[[], tuple[Callable, Callable]], schema: str) -> DataFrame:
    """Run over every different set once in each task. ``take`` gives a function of
    (node, hashes, text) that gathers, and one that turns what a batch gathered into
    columns. A set's node is half of its fingerprint; where two sets of the input share
    that half (``doubled``), it is the other one."""
    names = [c.split()[0] for c in schema.split(", ")]

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        gather, columns = take()
        met: set[int] = set()

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            for raw in raw_texts(batch.column(0)):
                hashes = shingle_set(raw, words)
                if len(hashes):
                    one, two = _halves(hashes)
                    node = two if one in doubled else one
                    if node not in met:
                        if len(met) < 200_000:
                            met.add(node)
                        gather(node, hashes, raw)
            return pa.RecordBatch.from_arrays(columns(), names)

        return apply

    return map_batches(df.select(text), make, schema)


def _prefix(n: int, percent: int) -> int:
    """So many shingles that two similar sets share ``SHARED`` of them, or as many as
    they must share at all."""
    return min(n, n - (percent * n + 99) // 100 + SHARED)


def _counted(n: int, percent: int) -> int:
    """The shingles that are counted for the order: those that may move into the prefix
    when frequent ones before them move back."""
    return min(n, _prefix(n, percent) * 5 // 4 + 2)


def _joined(parts: list[np.ndarray], kind: type) -> pa.Array:
    out = pa.array(np.concatenate(parts) if parts else np.zeros(0, kind))
    parts.clear()
    return out


def _table(counts: DataFrame, least: int) -> np.ndarray:
    """Bits of the shingles that are counted so often, at most ``2 ** (MARKS - 3)`` of
    them: the count asked for rises until so many suffice."""
    by_power = {r["p"]: r["count"] for r in counts.groupBy(F.floor(F.log2("count")).alias("p")).count().collect()}
    while sum(c for p, c in by_power.items() if 2 << p > least) > 1 << (MARKS - 3):
        least *= 2
    bits = counts.filter(F.col("count") >= least).select(F.col("token").bitwiseAND((1 << MARKS) - 1).cast("int").alias("b")).distinct()
    flags = np.zeros(1 << MARKS, np.uint8)
    flags[np.array(bits.toArrow().column(0), np.int64)] = 1
    return np.packbits(flags, bitorder="little")


def _marked(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    low = hashes & np.uint64((1 << MARKS) - 1)
    return (table[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8)) & 1


def frequent_marks(df: DataFrame, text: str, words: int, percent: int, doubled: frozenset[int], scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the frequent and of the hot shingles, counted over the prefixes
    of all sets. Any tables give right results: they order shingles and split lists."""

    def take():
        tokens: list[np.ndarray] = []
        gather = lambda node, hashes, raw: tokens.append(hashes[: _counted(len(hashes), percent)].view(np.int64))
        return gather, lambda: [_joined(tokens, np.int64)]

    prefixes = _each_set(df, text, words, doubled, take, "token long")
    counts = scratch.keep(prefixes.groupBy("token").count().filter(F.col("count") >= FREQUENT))
    tables = _table(counts, FREQUENT), _table(counts, HOT)
    scratch.drop(counts)
    return tables


def index_lists(df: DataFrame, text: str, words: int, percent: int, doubled: frozenset[int], marks: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(token, salt, node, n, at) of each set's prefix, with the pivot of its list. Lists
    of one set are left out. Those of hot shingles are dealt over ``SALTS`` parts,
    each with a pivot of its own, so that no task meets all of one. Rows run through a
    task in order; no list is held."""

    def take():
        held: list[list[np.ndarray]] = [[], [], [], []]

        def gather(node: int, hashes: np.ndarray, raw: bytes) -> None:
            n = len(hashes)
            order = np.argsort(_marked(marks[0], hashes) + _marked(marks[1], hashes), kind="stable")[: _prefix(n, percent)]
            held[0].append(hashes[order].view(np.int64))
            held[1].append(np.where(_marked(marks[1], hashes[order]) == 1, node % SALTS, -1).astype(np.int32))
            held[2].append(np.full(len(order), node, np.int64))
            held[3].append(np.arange(len(order)) + (n << 32))

        return gather, lambda: [_joined(h, k) for h, k in zip(held, (np.int64, np.int32, np.int64, np.int64))]

    entries = _each_set(df, text, words, doubled, take, "token long, salt int, node long, size_at long")
    placed = entries.repartition("token", "salt").sortWithinPartitions("token", "salt", "node")
    names = ["token", "salt", "node", "size_at", "pivot", "pivot_size_at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64)] * 6  # rows of a list that may go on, with its pivot
        def emit(rows: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) if i != 1 else pa.array(c.astype(np.int32)) for i, c in enumerate(rows)], names)

        def close(rows: list[np.ndarray], alone: bool) -> list[np.ndarray]:
            """Rows of lists with at least two sets, or of parts of a hot one."""
            use = (rows[4] != rows[2]) | (rows[1] >= 0) | ~alone
            return [c[use] for c in rows]

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [np.asarray(c.to_numpy(zero_copy_only=False), np.int64) for c in batch.columns]
            columns = [np.concatenate([k, c]) for k, c in zip(kept[:4], columns)]
            token, salt, node = columns[:3]
            fresh = np.ones(len(token), bool)  # a copy in another task's rows repeats a set
            fresh[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]) | (node[1:] != node[:-1])
            columns = [c[fresh] for c in columns]
            token, salt = columns[:2]
            start = np.ones(len(token), bool)
            start[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
            first = np.maximum.accumulate(np.where(start, np.arange(len(token)), 0))
            rows = [*columns, columns[2][first], columns[3][first]]
            if len(kept[4]) and first[0] == 0:  # the list goes on from the last batch
                same = first == 0
                rows[4] = np.where(same, kept[4][0], rows[4])
                rows[5] = np.where(same, kept[5][0], rows[5])
            size = np.bincount(first, minlength=len(token))[first]
            last = first[-1]
            done = [c[: max(last, 0)] for c in rows]
            yield emit(close(done, size[:last] == 1))
            # Of the open list only the last row stays, once it is known to be a list.
            tail = [c[last:] for c in rows]
            if len(tail[0]) > 1:
                yield emit([c[:-1] for c in tail])
            kept = [c[-1:] for c in tail]
        if len(kept[0]):
            yield emit(close(kept, np.ones(1, bool)))

    return placed.mapInArrow(run, "token long, salt int, node long, size_at long, pivot long, pivot_size_at long")


def packed_sets(df: DataFrame, text: str, words: int, doubled: frozenset[int], nodes: DataFrame) -> DataFrame:
    """(node, blob, odd sketch): a packed text for each of the nodes, and its sketch."""

    def take():
        ids: list[int] = []
        blobs: list[bytes] = []
        odd: list[np.ndarray] = []

        def gather(node: int, hashes: np.ndarray, raw: bytes) -> None:
            ids.append(node)
            blobs.append(_pack(raw))
            odd.append(_odd(hashes))

        def columns() -> list[pa.Array]:
            sketches = np.array(odd, np.int64).reshape(-1, len(ODD))
            out = [pa.array(ids, pa.int64()), pa.array(blobs, pa.binary()), *[pa.array(c) for c in sketches.T]]
            for held in (ids, blobs, odd):
                held.clear()
            return out

        return gather, columns

    return _each_set(df, text, words, doubled, take, "node long, blob binary, " + ", ".join(f"{c} long" for c in ODD)).join(nodes, "node", "left_semi").groupBy("node").agg(
        F.min("blob").alias("blob"), *[F.min(c).alias(c) for c in ODD]
    )


def _odd(hashes: np.ndarray) -> np.ndarray:
    """The parities of how many shingles fall on each of 512 places."""
    places = (hashes >> np.uint64(20)) & np.uint64(64 * len(ODD) - 1)
    return np.packbits((np.bincount(places.astype(np.int64), minlength=64 * len(ODD)) & 1).astype(np.uint8)).view(np.int64)


def _may_differ(one: str, other: str, n: str, m: str, percent: int) -> Column:
    """Parities that differ are shingles that differ, at least; similar sets differ in
    few: ``|A - B| + |B - A| <= (n + m) * (100 - percent) / (100 + percent)``."""
    differ = sum((F.bit_count(F.col(f"{one}{c}").bitwiseXOR(F.col(f"{other}{c}"))) for c in ODD), F.lit(0))
    sizes = F.shiftrightunsigned(n, 32) + F.shiftrightunsigned(m, 32)
    return (100 + percent) * differ <= (100 - percent) * sizes


def _overlaps(pairs: DataFrame, sets: DataFrame, words: int) -> DataFrame:
    """``pairs`` (a, b) with the sizes of both sets and of their intersection."""
    left = sets.select(F.col("node").alias("a"), F.col("blob").alias("blob_a"))
    right = sets.select(F.col("node").alias("b"), F.col("blob").alias("blob_b"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "blob_a", "blob_b")

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}

        def of(node: int, blob: bytes) -> np.ndarray:
            if node not in kept:
                if len(kept) >= 512:
                    kept.clear()
                kept[node] = shingle_set(_open(blob), words)
            return kept[node]

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                s, t = of(a, x), of(b, y)
                at = np.minimum(np.searchsorted(t, s), len(t) - 1)
                sizes.append((len(s), len(t), int((t[at] == s).sum())))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array((z[k] for z in sizes), pa.int64()) for k in range(3)]], ["a", "b", "na", "nb", "both"])

        return apply

    return map_batches(both, make, "a long, b long, na long, nb long, both long")


def _similar(percent: int) -> str:
    return f"{100 + percent} * both >= {percent} * (na + nb)"


def _fits(one: str, other: str, percent: int) -> Column:
    """Sizes and positions, packed in one number each, leave a large enough overlap."""
    n, m = F.shiftrightunsigned(one, 32), F.shiftrightunsigned(other, 32)
    at, to = F.col(one).bitwiseAND(0xFFFFFFFF), F.col(other).bitwiseAND(0xFFFFFFFF)
    overlap = F.least(n - at, m - to) + F.least(at, to)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * overlap >= percent * (n + m))


def similar_nodes(df: DataFrame, text: str, words: int, percent: int, doubled: frozenset[int], scratch: Scratch) -> DataFrame:
    """``node``, ``root`` of all sets that similarity joins to another one."""
    lists = scratch.keep(index_lists(df, text, words, percent, doubled, frequent_marks(df, text, words, percent, doubled, scratch)))
    # Parts of one list meet through the least of their pivots.
    parts = lists.filter("salt >= 0").groupBy("token", "pivot").agg(F.min("pivot_size_at").alias("size_at"))
    heads = parts.groupBy("token").agg(F.min(F.struct("pivot", "size_at")).alias("h")).select("token", F.col("h.pivot").alias("head"), F.col("h.size_at").alias("head_size_at"))
    across = parts.join(heads, "token").filter("pivot <> head").filter(_fits("size_at", "head_size_at", percent)).select(F.col("pivot").alias("a"), F.col("head").alias("b"))
    first = lists.filter("node <> pivot").filter(_fits("size_at", "pivot_size_at", percent)).select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    pairs = scratch.keep(first.union(across).distinct())
    sets = scratch.keep(packed_sets(df, text, words, doubled, lists.select("node").distinct()))
    known = scratch.keep(_overlaps(pairs, sets, words))
    scratch.drop(pairs)
    links = known.filter(_similar(percent)).select("a", "b")
    tree = roots(links, scratch)
    measured = lists.drop("pivot_size_at", "salt")
    # What a pivot didn't join tries members of its list's main component, another one in
    # each list, and one another; most of a group of near copies is joined then.
    sketches = sets.drop("blob")  # the blobs' column isn't read
    source = lists
    for turn in range(TURNS):
        rest = scratch.keep(_still_apart(measured, tree, percent))
        scratch.drop(source)
        drawn, main = F.xxhash64(F.lit(turn), "token", "node"), F.col("comp") == F.col("main")
        one = F.struct("node", "size_at")
        tries = rest.groupBy("token").agg(
            F.min_by(F.when(main, one), F.when(main, drawn)).alias("m"), F.min_by(F.when(~main, one), F.when(~main, drawn)).alias("s")
        ).select("token", F.explode(F.array("m", "s")).alias("t")).select("token", F.col("t.node").alias("to"), F.col("t.size_at").alias("to_size_at"))
        found = rest.filter("comp <> main").join(tries, "token").filter("node <> to").filter(_fits("size_at", "to_size_at", percent))
        fresh = _unseen(found.select(F.col("node").alias("a"), F.col("to").alias("b")), known)
        sizes = rest.groupBy("node").agg(F.min("size_at").alias("size_at"))
        for k in ("a", "b"):  # sketches come to the distinct pairs, not to the lists' rows
            own = sketches.join(sizes, "node").select(F.col("node").alias(k), F.col("size_at").alias(f"{k}_size_at"), *[F.col(c).alias(f"{k}_{c}") for c in ODD])
            fresh = fresh.join(own, k)
        fresh = fresh.filter(_may_differ("a_", "b_", "a_size_at", "b_size_at", percent)).select("a", "b")
        fresh = scratch.keep(fresh)
        new = scratch.keep(_overlaps(fresh, sets, words))
        scratch.drop(fresh)
        links = new.filter(_similar(percent)).select("a", "b").union(tree.select(F.col("node").alias("a"), F.col("root").alias("b")))
        tree = roots(links, scratch)
        known = known.union(new)
        measured, source = rest.select(*measured.columns), rest
    # All that is left: lists' side sets against their main component and one another.
    # Every set of such a list is measured against one head, so that the distances tell
    # which of two sets can't be similar, also where whole groups share a list.
    rest = _still_apart(measured, tree, percent).drop("pivot")
    heads = rest.groupBy("token").agg(F.min_by("node", F.struct(F.col("comp") != F.col("main"), "node")).alias("pivot"))
    rest = scratch.keep(rest.join(heads, "token"))
    scratch.drop(source)
    fresh = scratch.keep(_unseen(rest.filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")), known))
    new = scratch.keep(_overlaps(fresh, sets, words))
    scratch.drop(fresh)
    known, before = known.union(new), rest
    rest = rest.withColumns({"a": F.greatest("node", "pivot"), "b": F.least("node", "pivot")}).join(_distances(known), ["a", "b"], "left").drop("a", "b")
    rest = rest.withColumn("far", F.when(F.col("node") == F.col("pivot"), F.lit(0.0)).otherwise(F.col("far")))
    rest = scratch.keep(rest.select("token", "node", "size_at", "comp", "main", "far").join(sketches, "node"))
    scratch.drop(before)
    links = new.filter(_similar(percent)).select("a", "b")
    side = lambda p: [F.col(c).alias(f"{p}_{c}") for c in ("node", "size_at", "comp", "far", *ODD)]
    x = rest.filter("comp <> main").select("token", *side("x"))
    y = rest.select("token", "main", *side("y"))
    reach = (100 - percent) / 100 + 1e-9
    near = F.coalesce(F.abs(F.col("x_far") - F.col("y_far")) <= reach, F.lit(True))
    once = (F.col("y_comp") == F.col("main")) | (F.col("x_node") < F.col("y_node"))
    more = x.join(y, "token").filter(F.col("x_comp") != F.col("y_comp")).filter(
        once & near & _fits("x_size_at", "y_size_at", percent) & _may_differ("x_", "y_", "x_size_at", "y_size_at", percent)
    )
    # Similar sets meet in so many lists; a shared line alone is met in fewer.
    least = F.ceil(percent * F.least(F.shiftrightunsigned("x_size_at", 32), F.shiftrightunsigned("y_size_at", 32)) / 100)
    more = more.groupBy(F.greatest("x_node", "y_node").alias("a"), F.least("x_node", "y_node").alias("b")).agg(
        F.count("*").alias("met"), F.min(F.least(F.lit(SHARED), least)).alias("must")
    ).filter("met >= must").select("a", "b")
    fresh = scratch.keep(_unseen(more, known))
    scratch.drop(rest)
    late = _overlaps(fresh, sets, words).filter(_similar(percent)).select("a", "b")
    return roots(tree.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links).union(late), scratch)


def _still_apart(lists: DataFrame, tree: DataFrame, percent: int) -> DataFrame:
    """Rows of lists that hold several components and more than two sets, with their
    component and the list's main one, that of its first pivot. Sets that are in fewer
    of these lists than similar ones share go: two sets alone in a list are compared
    already, so a pair that isn't meets in all the lists it shares here."""
    named = lists.join(tree.select("node", "root"), "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    per_list = named.groupBy("token").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c"), F.min_by("comp", F.struct(F.col("node") != F.col("pivot"), "node")).alias("main")
    ).filter("lo <> hi and c > 2").select("token", "main")
    rows = named.join(per_list, "token")
    must = F.least(F.lit(SHARED), F.ceil(percent * F.shiftrightunsigned("size_at", 32) / 100))
    often = rows.groupBy("node").agg(F.count("*").alias("in"), F.min(must).alias("must")).filter(F.col("in") >= F.col("must")).select("node")
    return rows.join(often, "node", "left_semi")


def _distances(known: DataFrame) -> DataFrame:
    far = 1 - F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
    return known.groupBy(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).agg(F.min(far).alias("far"))


def _unseen(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct pairs, the greater first, that aren't compared yet."""
    ordered = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    return ordered.join(known.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row: ``key``, ``n_shingles`` and ``component_id``, the least key that links
    reach. Rows may repeat; their order isn't kept."""
    scratch = Scratch(df.sparkSession, "jaccard")
    rows = scratch.keep(shingled(df, key, text, words))
    classes = scratch.keep(rows.filter("n > 0").groupBy("k1", "k2").agg(F.min(key).alias("first_key")))
    # Of n sets about n * n / 2**65 pairs share half a fingerprint: few, if any.
    doubled = frozenset(r["k1"] for r in classes.groupBy("k1").count().filter("count > 1").select("k1").collect())
    node = F.when(F.col("k1").isin(*doubled), F.col("k2")).otherwise(F.col("k1")) if doubled else F.col("k1")
    tree = similar_nodes(df, text, words, percent, doubled, scratch)
    rooted = classes.select("k1", "k2", "first_key", node.alias("of")).join(tree, F.col("of") == F.col("node"), "left").select(
        "k1", "k2", "first_key", F.coalesce("root", "of").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first_key").alias("component_id"))
    named = rooted.join(least, "root").select("k1", "k2", "component_id")
    return rows.join(named, ["k1", "k2"], "left").select(
        key, F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col(key)).alias("component_id")
    )


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``df``, with all columns, that are the first of their component:
    one row of each, also where rows repeat. Rows without shingles all stay."""
    columns = df.columns
    found = near_duplicates(df.select(key, text), key, text, words, percent)
    gone = found.filter((F.col("n_shingles") > 0) & (F.col("component_id") != F.col(key))).select(F.col(key).alias("__gone")).distinct()
    kept = df.join(gone, F.col(f"`{key}`") == F.col("__gone"), "left_anti")
    # Rows without shingles are told apart by a number, so that none of them is a repeat.
    blank = F.col(f"`{text}`").isNull() | F.col(f"`{text}`").rlike(r"\A[\x09-\x0d ]*\z")
    kept = kept.withColumn("__own", F.when(blank, F.monotonically_increasing_id()))
    return kept.dropDuplicates([key, text, "__own"]).select(*columns)
