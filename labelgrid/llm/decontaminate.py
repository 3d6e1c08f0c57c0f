"""Benchmark decontamination by winnowing.

A window is ``window`` consecutive words of a benchmark item (a shorter item is one window of all its words). Of
every text the smallest hash among ``window - gram + 1`` consecutive ``gram``-word hashes is kept, ties included. A window
shared by a document and an item shows the same hashes on both sides, so its smallest is kept on both: no shared
window is missed. Kept fingerprints are joined and each hit is extended word by word, inside its
window reach, against the item's words; only exact runs of a whole window count.

Documents stay where they are: a task keeps those fingerprints that a bit map of all benchmark
fingerprints admits. The map has a fixed size (``MAP_BITS``), whatever the benchmark's; a larger benchmark
admits more candidates but loses none. Candidates carry the few words around them, so texts are never shuffled.
Items with equal surroundings share one row until the end.

Nulls and texts without words have no words and no hits; an item without words has no windows. A doc_id that
occurs twice is judged row by row; equal item ids count once. An item without an id counts in ``n_hit`` and ``contaminated`` but
is not named in ``items``. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from labelgrid.llm.common import MARKS, Block, Words, grams, map_texts, mix, sliding, through_table

WINDOW, GRAM = 10, 5
MAP_BITS = 23

_HIT = "struct<hash:bigint,size:int,pos:int,before:string,core:string,after:string>"
_HIT_ARROW = pa.list_(pa.struct([("hash", pa.int64()), ("size", pa.int32()), ("pos", pa.int32()), ("before", pa.string()), ("core", pa.string()), ("after", pa.string())]))


def winnow(words: Words, hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words where a kept ``gram`` starts, and its hash."""
    values = grams(hashes, gram)
    reach = window - gram + 1
    least = sliding(values, reach)
    if not len(least):
        return np.zeros(0, np.int64), values[:0]
    whole = np.append(words.left(window)[: len(least)], [])[: len(least)].astype(bool)
    least = np.where(whole, least, np.uint64(0))
    pad = np.zeros(reach - 1, np.uint64)
    kept = np.flatnonzero((sliding(np.concatenate([pad, least, pad]), reach, np.maximum) == values) & (values > 0))
    return kept, values[kept]


def short_grams(words: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All runs of ``size`` words inside documents, with hashes of their own kind."""
    values = grams(hashes, size)
    kept = np.flatnonzero(words.left(size)[: len(values)])
    return kept, mix(values[kept] + np.uint64(size))


def _fingerprints(block: Block, rows: int, lengths: list[int], admitted: np.ndarray | None, window: int, gram: int, items: bool):
    """Per row the admitted fingerprints with the words around them, and the number of words."""
    words = block.lowered().words(MARKS)
    hashes, counts = words.hashes(), words.counts()
    doc = words.doc()
    found: list[list[dict]] = [[] for _ in range(rows)]
    for size in [window, *lengths]:
        kept, values = winnow(words, hashes, window, gram) if size == window else short_grams(words, hashes, size)
        if items and size != window:
            alone = counts[doc[kept]] == size
            kept, values = kept[alone], values[alone]
        if admitted is not None:
            slot = values >> np.uint64(64 - MAP_BITS)
            passed = (admitted[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
            kept, values = kept[passed], values[passed]
        core, reach = (gram, window - gram) if size == window else (size, 0)
        for at, value in zip(kept.tolist(), values.view(np.int64).tolist()):
            d = int(doc[at])
            first, last = int(words.at[d]), int(words.at[d + 1])
            text = [x.decode("utf-8", "replace") for x in words.list(max(first, at - reach), min(last, at + core + reach))]
            head = at - max(first, at - reach)
            found[d].append({
                "hash": value, "size": size, "pos": at - first, "before": " ".join(text[:head]),
                "core": " ".join(text[head : head + core]), "after": " ".join(text[head + core :]),
            })
    return counts, found


def _bitmap(prints: DataFrame) -> np.ndarray:
    """Bit map of all fingerprint hashes; at most 2**MAP_BITS / 64 rows reach the driver."""
    slot = F.shiftrightunsigned("hash", 64 - MAP_BITS)
    rows = (
        prints.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - MAP_BITS}) & 63 as int))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()
    )
    table = np.zeros(1 << (MAP_BITS - 6), np.int64)
    for row in rows:
        table[row["word"]] = row["bits"]
    return table.view(np.uint8)


def _overlap(side: str) -> object:
    """Number of equal words at the seam of two word lists; ``before`` is compared from its end."""
    mine, other = F.split(F.col(side), " "), F.split(F.col(f"item_{side}"), " ")
    if side == "before":
        mine, other = F.reverse(mine), F.reverse(other)
    flags = F.transform(F.arrays_zip(mine.alias("a"), other.alias("b")), lambda x: F.coalesce(x["a"] == x["b"], F.lit(False)))
    first = F.array_position(flags, False)
    full = F.when(first == 0, F.size(flags)).otherwise(first - 1)
    return F.when((F.col(side) == "") | (F.col(f"item_{side}") == ""), 0).otherwise(full).cast("int")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, carry: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, items (sorted), contaminated, spans of hit words; and ``carried``, the column ``carry`` as it is, if one is named."""
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))

    def item_rows(block: Block, rows: pa.RecordBatch) -> dict:
        counts, found = _fingerprints(block, len(rows), list(range(1, window)), None, window, gram, True)
        return {"item_id": rows.column("item_id"), "n_words": pa.array(counts, pa.int64()), "hits": pa.array(found, _HIT_ARROW)}

    items = through_table(map_texts(bench, item_rows, f"item_id string, n_words bigint, hits array<{_HIT}>"), "bench-prints")
    prints = items.select("item_id", F.explode("hits").alias("h")).select("item_id", "h.*")
    lengths = sorted(r[0] for r in prints.where(F.col("size") < window).select("size").distinct().collect())
    admitted = docs.sparkSession.sparkContext.broadcast(_bitmap(prints))

    def doc_rows(block: Block, rows: pa.RecordBatch) -> dict:
        counts, found = _fingerprints(block, len(rows), lengths, admitted.value, window, gram, False)
        own = {name: rows.column(name) for name in ["doc_id", *carried]}
        return {**own, "n_words": pa.array(counts, pa.int64()), "hits": pa.array(found, _HIT_ARROW)}

    carried = ["carried"] if carry else []
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(f"`{carry}`").alias(name) for name in carried])
    kinds = [*[f for f in texts.schema if f.name != "text"], *DataType.fromDDL(f"n_words bigint, hits array<{_HIT}>")]
    base = map_texts(texts, doc_rows, StructType(kinds))
    base = through_table(base.withColumn("row_no", F.monotonically_increasing_id()), "doc-prints")

    key = ["hash", "size", "core"]
    around = prints.groupBy(*key, "before", "after").agg(F.collect_set("item_id").alias("item_ids"))
    around = around.select(*key, F.col("before").alias("item_before"), F.col("after").alias("item_after"), "item_ids")
    hits = base.select("row_no", F.explode("hits").alias("h")).select("row_no", "h.*").join(around, key)
    left, right = _overlap("before"), _overlap("after")
    core = F.size(F.split("core", " "))
    spans = (
        hits.withColumn("l", left).withColumn("r", right)
        .where((F.col("size") < window) | (F.col("l") + F.col("r") + core >= window))
        .select("row_no", (F.col("pos") - F.col("l")).alias("first"), (F.col("pos") + core + F.col("r")).alias("last"), "item_ids")
    )
    found = through_table(spans, "bench-hits")
    # Disjoint cover: a hit word is counted once although many spans hold it.
    words = found.groupBy("row_no", "first").agg(F.max("last").alias("last"))
    cover = words.groupBy("row_no").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("parts"))
    merged = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("n"), F.lit(-1).alias("seen")),
        lambda s, p: F.struct(
            (s["n"] + F.greatest(F.lit(0), p["last"] - F.greatest(p["first"], s["seen"]))).alias("n"),
            F.greatest(s["seen"], p["last"]).alias("seen"),
        ),
        lambda s: s["n"],
    )
    named = found.select("row_no", F.explode("item_ids").alias("item_id")).distinct().groupBy("row_no").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    per_row = cover.select("row_no", merged.cast("bigint").alias("n_hit"), F.col("parts").alias("spans")).join(named, "row_no", "left")
    return (
        base.select("row_no", "doc_id", "n_words", *carried).join(per_row, "row_no", "left")
        .select(
            "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            F.col("n_hit").isNotNull().alias("contaminated"),
            F.coalesce("spans", F.array().cast("array<struct<first:int,last:int>>")).alias("spans"), *carried,
        )
    )
