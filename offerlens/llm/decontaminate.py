"""Passages of benchmark items in documents, by a prefix-filtered join of shingle sets.

Every item is cut into windows of ``window`` consecutive words; an item of fewer words is
one window. A window is the set of its shingles (``shingle`` words, fewer in shorter
windows). It occurs in a document where a stretch of the window's own size holds at
least ``share`` of the set; with a share of 1, which is the default, where the stretch
equals the window word for word.

The shingles of a window are put in order of rarity, by the number of all documents that
hold them. A stretch that holds enough of a set holds one of its rarest ``n - need + 1``
shingles, the prefix, so only these are looked for. A window whose shingles that are in
any document at all are too few can't occur and leaves at once. A prefix shingle found
at a place in a document is joined with the windows that have it in their prefix; the
window's size and the shingle's place in it tell which stretches are left (they must lie
within the document), and the words, or the shingles of the stretches, are compared.

Documents are read twice, once for the rarity and once for the places, and no text is
shuffled: a table of fixed size (``BITS`` bits, 2 MB) tells which shingles may belong to
the benchmark, so that a document sends on only the places found, with the words around
them. Windows are broadcast where they are few (checked, ``SENT_BYTES``); beyond that
places and windows are joined by shingle and salt.

Words are maximal runs of a-z (A-Z is lowered), 0-9 and all characters beyond ASCII.
Null and empty texts have no words and no hits; a null key is a key like others.
Repeated documents are rated each on its own, repeated items (one id) count once; items
without an id are left out. An empty benchmark leaves all documents clean, an empty
table of documents gives an empty one. Other columns aren't read, so none can clash.
"""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerlens.llm.arrow import map_batches, raw_texts, slices
from offerlens.llm.shingles import rolling, word_hashes
from offerlens.session import checkpoint_folder

WINDOW, SHINGLE = 10, 3
BITS = 1 << 24
SENT_BYTES = 16 << 20
SALTS = 16

# A to Z as a to z, everything that is no part of a word as a space.
_WORDS = bytes(
    x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256)
)
_AROUND = pa.list_(pa.struct([("token", pa.int64()), ("at", pa.int64()), ("first", pa.int64()), ("words", pa.string()), ("tokens", pa.list_(pa.int64()))]))


def plain(text: bytes) -> bytes:
    """The text with single-byte spaces between its words."""
    return text.translate(_WORDS)


def tokens(hashes: np.ndarray, shingle: int) -> np.ndarray:
    """Hashes of all runs of ``shingle`` words, none if the text has fewer."""
    return rolling(hashes, shingle).view(np.int64) if len(hashes) >= shingle else np.zeros(0, np.int64)


# The benchmark ---------------------------------------------------------------
def item_windows(items: DataFrame, key: str, text: str, window: int, shingle: int) -> DataFrame:
    """``item`` (id as text), ``words`` of each window, their number ``size``, and the
    window's ``tokens`` in order."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns: list[list] = [[], [], [], []]
            for item, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                spaced = plain(raw)
                words = spaced.split()
                size = min(window, len(words))
                if not size:
                    continue
                width = min(shingle, size)
                found = tokens(word_hashes(spaced, lower=False), width)
                for start in range(len(words) - size + 1):
                    values = item, b" ".join(words[start : start + size]).decode(), size, found[start : start + size - width + 1].tolist()
                    for column, value in zip(columns, values):
                        column.append(value)
            kinds = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["item", "words", "size", "tokens"])

        return apply

    narrow = items.select(F.col(f"`{key}`").cast("string").alias("item"), F.col(f"`{text}`").alias("text")).filter("item is not null")
    return map_batches(narrow, make, "item string, words string, size int, tokens array<long>", 1 << 20)


def _bits(found: DataFrame) -> np.ndarray:
    """One bit for each token's last bits. Of any number of tokens at most ``BITS``
    bits come to the driver."""
    slot = F.pmod("token", F.lit(BITS))
    bytes_ = found.select(slot.alias("s")).groupBy(F.expr("cast(s div 8 as int)").alias("at")).agg(F.expr("bit_or(shiftleft(1, cast(s % 8 as int)))").alias("bits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, bits = (c.to_numpy().astype(t).tobytes() for c, t in zip(batch.columns, ("<i4", "u1")))
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([bits], pa.binary())], ["at", "bits"])

    table = np.zeros(BITS // 8, np.uint8)
    for row in bytes_.mapInArrow(run, "at binary, bits binary").collect():
        table[np.frombuffer(row["at"], "<i4")] = np.frombuffer(row["bits"], "u1")
    return table


def _may_hold(table: np.ndarray, found: np.ndarray) -> np.ndarray:
    slot = found & np.int64(BITS - 1)
    return (table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


# Documents -------------------------------------------------------------------
def rarity(df: DataFrame, text: str, wanted: DataFrame, widths: list[int]) -> DataFrame:
    """``token`` and ``held``: how many of all documents hold it, for the wanted tokens
    that any document holds."""
    sent = df.sparkSession.sparkContext.broadcast(_bits(wanted))

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            held = [np.zeros(0, np.int64)]
            for raw in raw_texts(batch.column(0)):
                hashes = word_hashes(plain(raw), lower=False)
                for width in widths:
                    found = tokens(hashes, width)
                    held.append(np.unique(found[_may_hold(sent.value, found)]))
            found, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts.astype(np.int64))], ["token", "held"])

        return apply

    counted = map_batches(df.select(text), make, "token long, held long").groupBy("token").agg(F.sum("held").alias("held"))
    return counted.join(wanted, "token", "left_semi")


def prefixes(windows: DataFrame, held: DataFrame, share: float) -> DataFrame:
    """The tokens by which a window is looked for: ``token``, its first place ``offset`` in
    the window, ``words``, ``size``, the window's distinct ``tokens`` and how many of them
    a stretch ``need``\\ s."""
    places = windows.select("words", "size", F.array_distinct("tokens").alias("tokens"), F.posexplode("tokens").alias("offset", "token"))
    firsts = places.groupBy("words", "size", "tokens", "token").agg(F.min("offset").alias("offset"))
    need = F.ceil(F.lit(share) * F.size("tokens") - 1e-9).cast("int")
    # Only tokens that some document holds can be found; a window needs enough of them.
    known = firsts.join(held, "token").withColumn("need", need)
    one = Window.partitionBy("words")
    ranked = known.withColumns({
        "absent": F.size("tokens") - F.count("*").over(one),
        "rank": F.row_number().over(one.orderBy("held", "token")),
    })
    short = F.size("tokens") - F.col("need")  # tokens that may be missing
    return ranked.filter((F.col("absent") <= short) & (F.col("rank") + F.col("absent") <= short + 1)).select("token", "offset", "words", "size", "tokens", "need")


def places(df: DataFrame, key: str, text: str, wanted: DataFrame, widths: list[int], window: int, shingle: int) -> DataFrame:
    """Each document: a number of its own row, the key, ``n_words``, and the places of
    wanted tokens with the words and tokens that a window around each could cover."""
    sent = df.sparkSession.sparkContext.broadcast(_bits(wanted))
    kind = df.schema[key].dataType.simpleString()

    def around(spaced: bytes, hashes: np.ndarray) -> list[dict]:
        out: list[dict] = []
        words: list[bytes] | None = None
        for width in widths:
            found = tokens(hashes, width)
            reach = window - width if width == shingle else 0  # shorter windows are one token
            for at in np.flatnonzero(_may_hold(sent.value, found)).tolist():
                words = spaced.split() if words is None else words
                first = max(0, at - reach)
                near = found[first : at + reach + 1]
                out.append({"token": int(found[at]), "at": at, "first": first, "words": b" ".join(words[first : at + reach + width]).decode(), "tokens": near})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in slices(batches, 1 << 20):
            counts, found = [], []
            for raw in raw_texts(batch.column(1)):
                spaced = plain(raw)
                hashes = word_hashes(spaced, lower=False)
                counts.append(len(hashes))
                found.append(around(spaced, hashes))
            rows = np.arange(number, number + batch.num_rows)
            number += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column(0), pa.array(counts, pa.int64()), pa.array(found, _AROUND)], ["row", key, "n_words", "found"])

    return df.select(key, text).mapInArrow(
        run, f"row long, `{key}` {kind}, n_words long, found array<struct<token long, at long, first long, words string, tokens array<long>>>"
    )


def occurrences(found: DataFrame, wanted: DataFrame, shingle: int, share: float, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """``row``, ``start``, ``size`` and ``window`` (its words) of each stretch that a window
    occurs in."""
    spots = found.select("row", "n_words", F.explode("found").alias("f")).select("row", "n_words", "f.token", "f.at", "f.first", F.col("f.words").alias("near"), F.col("f.tokens").alias("near_tokens"))
    known = wanted.withColumnsRenamed({"words": "window", "tokens": "own"})
    weight = wanted.agg(F.coalesce(F.sum(F.length("words") + 120 + 8 * F.size("tokens")), F.lit(0))).first()[0]
    if weight <= sent_bytes:
        pairs = spots.join(F.broadcast(known), "token")
    else:
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = spots.withColumn("salt", F.pmod(F.hash("row", "at"), F.lit(SALTS))).join(salted, ["token", "salt"])
    if share >= 1:
        # The token's place in the window leaves one stretch.
        start = F.col("at") - F.col("offset")
        same = F.slice(F.split("near", " "), (start - F.col("first") + 1).cast("int"), F.col("size")) == F.split("window", " ")
        inside = pairs.filter((start >= 0) & (start + F.col("size") <= F.col("n_words")))
        hits = inside.filter(same).select("row", start.alias("start"), "size", "window")
    else:
        width = F.least(F.lit(shingle), F.col("size"))
        reach = F.col("size") - width
        last = F.least(F.col("at"), F.col("n_words") - F.col("size"))
        starts = F.sequence(F.greatest(F.lit(0), F.col("at") - reach), last)
        inside = pairs.filter(last >= F.greatest(F.lit(0), F.col("at") - reach))
        stretch = lambda s: F.slice("near_tokens", (s - F.col("first") + 1).cast("int"), (reach + 1).cast("int"))
        enough = F.filter(starts, lambda s: F.size(F.array_intersect(stretch(s), F.col("own"))) >= F.col("need"))
        hits = inside.select("row", F.explode(enough).alias("start"), "size", "window")
    return hits.distinct()


def contamination(
    df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    window: int = WINDOW, shingle: int = SHINGLE, share: float = 1.0, sent_bytes: int = SENT_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """Two tables: each document (``row``, the key, ``n_words``), and the occurrences found
    (``row``, ``start`` and ``size`` in words, ``item``)."""
    spark = df.sparkSession
    place = f"{checkpoint_folder(spark)}/decontaminate-{os.urandom(8).hex()}"

    def kept(part: DataFrame, name: str) -> DataFrame:
        part.write.parquet(f"{place}/{name}")
        return spark.read.parquet(f"{place}/{name}")

    cut = kept(item_windows(items, item_key, item_text, window, shingle), "items")
    windows = kept(cut.select("words", "size", "tokens").distinct(), "windows")
    widths = [r[0] for r in windows.select(F.least(F.lit(shingle), F.col("size"))).distinct().collect()]
    held = kept(rarity(df, text, windows.select(F.explode("tokens").alias("token")).distinct(), widths), "rarity")
    wanted = kept(prefixes(windows, held, share), "prefixes")
    found = kept(places(df, key, text, wanted.select("token"), widths, window, shingle), "places")
    hits = kept(occurrences(found, wanted, shingle, share, sent_bytes), "hits")
    listed = cut.select(F.col("words").alias("window"), "item").distinct()
    return found.drop("found"), hits.join(listed, "window").select("row", "start", "size", "item")


def documents_hit(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """All documents with ``n_hit`` (words inside any occurrence), ``n_items`` and their
    ``items`` in order."""
    spans = hits.groupBy("row", "start").agg((F.col("start") + F.max("size")).alias("stop"))
    before = F.max("stop").over(Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))))
    words = spans.select("row", fresh.alias("fresh")).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    named = hits.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    whole = rows.join(words.join(named, "row"), "row", "left")
    return whole.withColumns({
        "n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "items": F.coalesce("items", F.array().cast("array<string>")),
    }).withColumn("n_items", F.size("items").cast("long")).drop("row")
