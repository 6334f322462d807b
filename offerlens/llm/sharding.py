"""Sharding by a hierarchical weighted hash tree.

A row descends from the root over regions and racks to a shard. At each level every
child draws ``-ln(u) / weight`` with ``u`` hashed from the row's key and the child's
name; the smallest draw wins. A child's draw doesn't depend on its siblings, so:

- shares follow the weights;
- a heavier (or new) child only attracts rows, a lighter one only gives rows away,
  each in proportion to the change;
- below a node whose children keep their weights nothing moves.

A node's weight is the sum of its shards' weights. ``grown`` hangs one more shard
into a region of its own, so rows move into it and nowhere else.

Everything is column expressions on the key; no row is shuffled to be placed.
A null key is placed like any other value. Rows with equal keys share a shard.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.session import durable

Leaves = dict[tuple[int, int, int], float]


@dataclass(frozen=True)
class Tree:
    """Weights of the shards by (region, rack, shard); shard numbers are unique."""

    leaves: tuple[tuple[tuple[int, int, int], float], ...]

    @staticmethod
    def of(leaves: Leaves) -> "Tree":
        numbers = [s for _, _, s in leaves]
        if not numbers or len(set(numbers)) < len(numbers):
            raise ValueError("a tree needs shards with numbers of their own")
        if any(not w > 0 or math.isinf(w) for w in leaves.values()):
            raise ValueError("weights must be positive and finite")
        return Tree(tuple(sorted(leaves.items())))

    def children(self, *path: int) -> list[tuple[int, float]]:
        """The children of a node with their weights."""
        found: dict[int, float] = {}
        for leaf, weight in self.leaves:
            if leaf[: len(path)] == path:
                found[leaf[len(path)]] = found.get(leaf[len(path)], 0.0) + weight
        return sorted(found.items())

    def grown(self, weight: float = 1.0) -> "Tree":
        """With the next shard, alone in a new region."""
        region = max(leaf[0] for leaf, _ in self.leaves) + 1
        shard = max(leaf[2] for leaf, _ in self.leaves) + 1
        return Tree.of({**dict(self.leaves), (region, 0, shard): weight})


def even_tree(shards: int = 24, racks_per_region: int = 4, shards_per_rack: int = 2) -> Tree:
    """Equal weights, shards in order over racks and regions."""
    per_region = racks_per_region * shards_per_rack
    return Tree.of({(s // per_region, s // shards_per_rack, s): 1.0 for s in range(shards)})


def _draw(key: Column, level: int, child: int, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), F.lit(child)), 11)
    uniform = (bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
    return -F.log(uniform) / F.lit(float(weight))


def _winner(key: Column, level: int, children: list[tuple[int, float]]) -> Column:
    if len(children) == 1:
        return F.lit(children[0][0])
    draws = [F.struct(_draw(key, level, c, w).alias("d"), F.lit(c).alias("c")) for c, w in children]
    return F.least(*draws)["c"]


def place(df: DataFrame, tree: Tree, key: str, to: str = "shard") -> DataFrame:
    """``df`` with the shard of each row in ``to``; other columns stay as they are."""
    region, rack, k = f"__{to}_region", f"__{to}_rack", F.col(f"`{key}`")

    def chosen(pick: list[tuple[Column, Column]]) -> Column:
        out = None
        for condition, value in pick:
            out = F.when(condition, value) if out is None else out.when(condition, value)
        return out

    regions = [r for r, _ in tree.children()]
    racks = {r: tree.children(r) for r in regions}
    out = df.withColumn(region, _winner(k, 0, tree.children()))
    out = out.withColumn(rack, chosen([(F.col(region) == r, _winner(k, 1, racks[r])) for r in regions]))
    out = out.withColumn(to, chosen([
        ((F.col(region) == r) & (F.col(rack) == c), _winner(k, 2, tree.children(r, c))) for r in regions for c, _ in racks[r]
    ]))
    return out.drop(region, rack)


def number_slots(df: DataFrame, group: str, to: str = "slot", rows_per_part: int = 200_000) -> DataFrame:
    """A gapless number from 0 for every row within its group. Rows of a group are
    dealt evenly over parts by their place in the input, counted per part, and
    numbered within the part; so neither a large group nor a repeated key meets in
    one task, and only counts are summed across parts. The deal is written once, as
    a second run of the input might order its rows otherwise."""
    parts = max(1, -(-df.count() // rows_per_part)) * 8
    dealt = durable(df.withColumn("__part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts))))
    counts = dealt.groupBy(group, "__part").count()
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col(group).alias("__group"), F.col("__part").alias("__of"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start")
    )
    own = Window.partitionBy(group, "__part").orderBy(*[F.col(f"`{c}`") for c in df.columns])
    numbered = dealt.withColumn("__own", F.row_number().over(own) - 1)
    joined = numbered.join(starts, (F.col(group) == F.col("__group")) & (F.col("__part") == F.col("__of")))
    return joined.withColumn(to, F.col("__start") + F.col("__own")).drop("__part", "__own", "__group", "__of", "__start")


def shard_documents(df: DataFrame, tree: Tree, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, size, CRC-32 of the text, shard, slot, and the shard after one more is
    added. The text itself is read once and never shuffled."""
    raw = F.col(f"`{text}`").cast("binary")
    rows = df.select(
        F.col(f"`{key}`"), (F.coalesce(F.octet_length(raw), F.lit(0)).cast("long") + 8).alias("bytes"),
        F.coalesce(F.crc32(raw), F.lit(0).cast("long")).alias("text_crc32"),
    )
    placed = place(place(rows, tree, key, "shard"), tree.grown(), key, "grown_shard")
    return number_slots(placed, "shard")
