"""Near duplicates among vectors by lattice hashing.

Each table projects the unit vectors of a label onto eight random directions and
takes the nearest point of the E8 lattice as the vector's cell. A vector also probes
the cells next to its own that lie nearest. Vectors that meet in a cell, at least one
of them at home, are compared by cosine in double precision. A pair that meets again
in a later cell counts there no more, so links are counted where they are found and
pairs are never shuffled; of each cell only counts per vector and a few edges leave.

Equal vectors of a label are one class and weigh as many as they are. A cell with
many members is cut into chunks, and pairs of chunks are compared as blocks, so no
task holds more than two chunks of a cell, however large it is.

Vectors that are null, zero, or hold null or non-finite components, and vectors
without a label, link with nothing and stay alone. Vectors of different lengths are
never compared. Repeated rows are vectors of their own with equal links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm.arrow import slices
from offerlens.llm.components import roots
from offerlens.llm.shingles import mix
from offerlens.session import durable

COSINE = 0.98
TABLES, PROBES, SCALE = 5, 2, 0.4  # lattice unit in terms of a projected unit vector
CHUNK = 1_024
SEED = 20_240_501


def e8_roots() -> np.ndarray:
    """The 240 shortest lattice vectors: two coordinates of +-1, or eight of +-1/2 with
    an even number of minus signs."""
    eye = np.eye(8)
    whole = [s * eye[i] + t * eye[j] for i in range(8) for j in range(i) for s in (1, -1) for t in (1, -1)]
    signs = np.array(np.meshgrid(*[(0.5, -0.5)] * 8)).reshape(8, -1).T
    return np.concatenate([np.array(whole), signs[(signs < 0).sum(1) % 2 == 0]])


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    point = np.rint(x)
    odd = np.flatnonzero(point.sum(1) % 2 != 0)
    if len(odd):
        off = x[odd] - point[odd]
        at = np.abs(off).argmax(1)
        point[odd, at] += np.where(off[np.arange(len(odd)), at] >= 0, 1, -1)
    return point


def nearest_point(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: the nearer of two shifted even lattices."""
    one, two = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - two) ** 2).sum(1) < ((x - one) ** 2).sum(1)
    return np.where(nearer[:, None], two, one)


def cells(unit: np.ndarray, labels: np.ndarray, tables: int, probes: int, scale: float) -> np.ndarray:
    """Cell numbers (rows, tables, 1 + probes), the own cell first."""
    n, dims = unit.shape
    found = np.zeros((n, tables, 1 + probes), np.int64)
    near = e8_roots()
    for t in range(tables):
        rng = np.random.default_rng([SEED, dims, t])
        # Projected distances equal the distances themselves on average.
        x = unit @ rng.standard_normal((dims, 8)) / np.sqrt(8) / scale + rng.random(8)
        own = nearest_point(x)
        gain = (x - own) @ near.T
        best = np.argsort(-gain, axis=1, kind="stable")[:, :probes]
        points = np.concatenate([own[:, None], own[:, None] + near[best]], 1)
        coded = np.rint(points * 2).astype(np.int64).view(np.uint64)
        total = np.broadcast_to(mix(labels.astype(np.int64).view(np.uint64) + np.uint64(dims * 1009 + t))[:, None], coded.shape[:2])
        for k in range(8):
            total = mix(total * np.uint64(0x9E3779B97F4A7C15) + coded[:, :, k])
        found[:, t] = total.view(np.int64)
    return found


def _hashed(classes: DataFrame, tables: int, probes: int, scale: float) -> DataFrame:
    """(cls, cells): the cells of all tables in one array, 1 + probes for each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8 << 20):
            vectors = batch.column(2).to_pylist()
            labels = np.array(batch.column(1).to_pylist(), np.int64)
            out = np.zeros((len(vectors), tables * (1 + probes)), np.int64)
            lengths = np.fromiter(map(len, vectors), np.int64, len(vectors))
            for dims in np.unique(lengths):
                rows = np.flatnonzero(lengths == dims)
                x = np.array([vectors[i] for i in rows], np.float64)
                x /= np.abs(x).max(1, keepdims=True)  # so that squares don't overflow
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                out[rows] = cells(x, labels[rows], tables, probes, scale).reshape(len(rows), -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.tolist(), pa.list_(pa.int64()))], ["cls", "cells"])

    return classes.select("cls", "label", "embedding").mapInArrow(run, "cls long, cells array<long>")


def _block(rows: list[tuple], within: bool, width: int, cosine: float) -> tuple[list[tuple], list[tuple]]:
    """Link counts and connecting edges of one pair of chunks of a cell, or of one chunk
    with itself."""
    home = np.array([r[0] for r in rows])
    side = np.array([r[1] for r in rows])
    cls = np.array([r[2] for r in rows], np.int64)
    weight = np.array([r[3] for r in rows], np.int64)
    place = np.array([r[4] for r in rows], np.int64)
    x = np.array([r[5] for r in rows], np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    seen = np.array([r[6] for r in rows], np.int64).reshape(len(rows), -1, width)
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if within:
        two = one
    if not len(one) or not len(two):  # a chunk may be empty
        return [], []
    linked = x[one] @ x[two].T >= cosine
    i, j = np.nonzero(linked)
    i, j = one[i], two[j]
    keep = home[i] | home[j]
    keep &= (i < j) if two is one else cls[i] != cls[j]
    i, j = i[keep], j[keep]
    if not len(i):
        return [], []
    # An earlier meeting: an earlier table, or a lesser cell of this one.
    table, here = place[i[0]] // width, rows[0][7]
    earlier = np.zeros(len(i), bool)
    for t in range(int(table) + 1):
        for p in range(width):
            for a, b in ((i, j), (j, i)):
                meets = seen[a, t, p] == seen[b, t, 0]
                earlier |= meets if t < table else meets & (seen[b, t, 0] < here)
    i, j = i[~earlier], j[~earlier]
    counts: dict[int, int] = {}
    got = np.bincount(np.concatenate([i, j]), np.concatenate([weight[j], weight[i]]), len(rows)).astype(np.int64)
    for k in np.flatnonzero(got):
        counts[int(cls[k])] = counts.get(int(cls[k]), 0) + int(got[k])
    # A forest of the block's links says as much of components as all of them.
    parent = {}

    def top(k: int) -> int:
        while parent.setdefault(k, k) != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    edges = []
    for a, b in zip(cls[i].tolist(), cls[j].tolist()):
        s, t = top(a), top(b)
        if s != t:
            parent[max(s, t)] = min(s, t)
            edges.append((a, b))
    return list(counts.items()), edges


def _compared(blocks: DataFrame, width: int, cosine: float) -> DataFrame:
    """Rows arrive sorted by block; a block may span batches."""
    names = ["kind", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: list[tuple] = []
        at = None

        def close() -> None:
            if len(held) > 1:
                counts, edges = _block(held, at[1] == at[2], width, cosine)
                out.extend((0, c, n) for c, n in counts)
                out.extend((1, a, b) for a, b in edges)
            held.clear()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [(), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names)

        for batch in batches:
            for cell, i, j, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (cell, i, j) != at:
                    close()
                    at = (cell, i, j)
                held.append((*row, cell))
            if len(out) > 10_000:
                yield flush()
        close()
        yield flush()

    return blocks.mapInArrow(run, "kind int, a long, b long")


def near_duplicate_vectors(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, chunk: int = CHUNK,
) -> DataFrame:
    """Per row: ``key``, ``n_links`` (other rows linked directly), ``component_id`` (the
    least key that links reach) and ``kept`` (it is its component's least)."""
    width = 1 + probes
    v = F.col("embedding")
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").alias("embedding"))
    finite = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    usable = F.col("label").isNotNull() & finite & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = rows.withColumns({"h1": F.when(usable, F.xxhash64("label", "embedding")), "h2": F.when(usable, F.xxhash64("embedding", F.lit(SEED)))})
    folded = rows.filter("h1 is not null").groupBy("h1", "h2").agg(
        F.min("key").alias("first_key"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("embedding").alias("embedding")
    )
    classes = durable(folded.withColumn("cls", F.monotonically_increasing_id()))
    hashed = _hashed(classes, tables, probes, scale)
    narrow = durable(hashed.select("cls", "cells", F.posexplode("cells").alias("place", "cell")).drop("cells"))
    sizes = narrow.groupBy("cell").agg(F.count("*").alias("size"), F.max(F.col("place") % width == 0).alias("lived")).filter("size > 1 and lived")
    sizes = sizes.select("cell", F.greatest(F.lit(1), F.ceil(F.col("size") / chunk)).cast("int").alias("chunks"))
    dealt = narrow.join(sizes, "cell").withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int"))
    # Chunk c meets every chunk d once, as (min, max); the side tells them apart.
    paired = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")).select(
        "cell", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"),
        (F.col("place") % width == 0).alias("home"), (F.col("chunk") > F.col("other")).cast("int").alias("side"), "cls", "place",
    )
    full = hashed.join(classes.select("cls", "weight", "embedding"), "cls")
    wide = paired.join(full, "cls").select("cell", "i", "j", "home", "side", "cls", "weight", "place", "embedding", "cells")
    blocks = wide.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "cls", "home")
    found = durable(_compared(blocks, width, cosine))
    links = found.filter("kind = 0").groupBy(F.col("a").alias("of")).agg(F.sum("b").alias("links"))
    tree = roots(found.filter("kind = 1").select("a", "b"))
    rooted = classes.select("h1", "h2", "cls", "first_key", "weight").join(tree, F.col("cls") == F.col("node"), "left").join(
        links, F.col("cls") == F.col("of"), "left"
    ).select("h1", "h2", "first_key", F.coalesce("root", "cls").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    least = rooted.groupBy("root").agg(F.min("first_key").alias("component_id"))
    named = rooted.join(least, "root").select("h1", "h2", "n_links", "component_id")
    out = rows.select("key", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "key")
    return out.select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.cast("long").alias("component_id"), (component == F.col("key")).alias("kept"),
    )
