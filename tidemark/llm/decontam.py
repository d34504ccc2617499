"""Benchmark decontamination: containment search for short test items inside long documents.

An item is found in a document if at least ``percent`` of its word shingles occur in the document.  Items are
partitioned by set size (powers of two).  In each partition an item is represented by its smallest fingerprints, as many
as the largest size of the partition may miss and one more: a document that contains the item must then show one of
them, whatever its own length, so the search has no false negatives.  A document's whole set of fingerprints is looked
up among these minima; an item whose minima are hit often enough is verified by exact shingle containment.

The items are the stated query set.  Up to ``block`` fingerprints of items go to the executors, and one scan without any
shuffle answers all.  A larger benchmark stays distributed: a bitmap of a fixed size says which values are minima of some
item, the documents' values that it lets through are joined with the minima, hits are counted by text and item, and the sets
of the texts that remain are met with those of their items.  That is two scans of the documents, whatever the benchmark's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch, texts, tune
from .shingles import WIDTH, runs, string_chunks, word_table

#: Fingerprints of items that are sent to every task at most, 8 bytes each.
BLOCK = 1 << 20
#: Bits of the bitmap of a larger benchmark's minima: 16 MB.
BITMAP = 1 << 27


def _item_sets(width: int):
    schema = pa.schema([("item_id", pa.int64()), ("words", pa.int32()), ("h", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, sets = [], []
            for _, data, offsets in string_chunks(batch.column("text")):
                words, _, first = word_table(data, offsets)
                for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    lengths.append(min(b - a, width))
                    sets.append(np.unique(runs(words[a:b], min(b - a, width))).view(np.int64) if b > a else np.zeros(0, np.int64))
            yield pa.record_batch([batch.column("item_id"), pa.array(lengths, pa.int32()), pa.array(sets, pa.list_(pa.int64()))], schema=schema)

    return run


class _Index:
    """The retained minima of items, and the items' whole sets for verification."""

    def __init__(self, rows, percent: int):
        self.items = [r.item_id for r in rows]
        self.sets = [np.array(r.h, np.int64).view(np.uint64) for r in rows]
        self.lengths = sorted({r.words for r in rows})
        sizes = np.array([len(s) for s in self.sets])
        # size partitions: the allowance for misses is that of the partition's upper end
        upper = 2 ** np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
        keep = np.minimum(sizes, upper * (100 - percent) // 100 + 1)
        self.need = keep - sizes * (100 - percent) // 100
        values = np.concatenate([s[:m] for s, m in zip(self.sets, keep, strict=True)])
        owners = np.repeat(np.arange(len(self.sets)), keep)
        order = np.argsort(values, kind="stable")
        self.values, self.owners = values[order], owners[order]

    def found(self, have: np.ndarray, percent: int) -> list[tuple[int, int]]:
        """(item, shared) for the items that the sorted set ``have`` contains."""
        low = np.searchsorted(self.values, have, side="left")
        hit = low < len(self.values)
        hit[hit] = self.values[low[hit]] == have[hit]
        if not hit.any():
            return []
        ends = np.searchsorted(self.values, have[hit], side="right")
        starts = low[hit]
        owners = np.concatenate([self.owners[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        out = []
        for item, hits in zip(*np.unique(owners, return_counts=True), strict=True):
            if hits >= self.need[item]:
                wanted = self.sets[item]
                at = np.minimum(np.searchsorted(have, wanted), len(have) - 1)
                shared = int((have[at] == wanted).sum())
                if 100 * shared >= percent * len(wanted):
                    out.append((int(item), shared))
        return out


def _search(block, percent: int, width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_item", pa.int64()), ("n_shared", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: _Index = block.value
        for batch in batches:
            rows = ([], [], [], [])
            ids = batch.column("doc_id").to_pylist()
            for row, data, offsets in string_chunks(batch.column("text")):
                words, _, first = word_table(data, offsets)
                by_length = {n: runs(words, n) for n in index.lengths}
                for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    own = [h[a : b - n + 1] for n, h in by_length.items() if b - a >= n]
                    if not own:
                        continue
                    for item, shared in index.found(np.unique(np.concatenate(own) if len(own) > 1 else own[0]), percent):
                        for column, value in zip(rows, (ids[row + k], index.items[item], len(index.sets[item]), shared), strict=True):
                            column.append(value)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in rows], schema=schema)

    return run


def _text_values(column: pa.Array, lengths: list[int]) -> Iterator[np.ndarray]:
    """For each row the sorted distinct fingerprints of its runs of so many words."""
    for _, data, offsets in string_chunks(column):
        words, _, first = word_table(data, offsets)
        by_length = {n: runs(words, n) for n in lengths}
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            own = [h[a : b - n + 1] for n, h in by_length.items() if b - a >= n]
            yield np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64)


def _hits(bitmap, lengths: list[int]):
    schema = pa.schema([("text_print", pa.string()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: np.ndarray = bitmap.value
        for batch in batches:
            prints, values = [], []
            for text, have in zip(batch.column("text"), _text_values(batch.column("text"), lengths), strict=True):
                at = (have & np.uint64(BITMAP - 1)).astype(np.int64)
                some = have[(known[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1]
                if len(some):
                    values.append(some.view(np.int64))
                    prints += [hashlib.md5(text.as_buffer()).hexdigest()] * len(some)
            yield pa.record_batch([pa.array(prints, pa.string()), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64))], schema=schema)

    return run


def _sets(lengths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.view(np.int64) for s in _text_values(batch.column("text"), lengths)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_print"), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "text_print", "s"])

    return run


def _shared(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(h.values) for h in batch.column("h")]
            both = [len(np.intersect1d(h.values.to_numpy(), s.values.to_numpy(), assume_unique=True)) for h, s in zip(batch.column("h"), batch.column("s"), strict=True)]
            keep = pa.array([100 * n >= percent * m for n, m in zip(both, sizes, strict=True)], pa.bool_())
            out = pa.record_batch([batch.column("doc_id"), batch.column("item_id"), pa.array(sizes, pa.int64()), pa.array(both, pa.int64())], names=["doc_id", "item_id", "n_item", "n_shared"])
            yield out.filter(keep)

    return run


def _distributed(docs: DataFrame, items: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The rows of `contaminated` for a benchmark that isn't sent out: ``items`` has item, item_id, words and h."""
    spark = docs.sparkSession
    # size partitions: the allowance for misses is that of the partition's upper end
    upper = F.pow(F.lit(2), F.ceil(F.log2(F.size("h").cast("double")))).cast("long")
    keep = F.least(F.size("h").cast("long"), F.floor(upper * (100 - percent) / 100) + 1).cast("int")
    need = keep - F.floor(F.size("h") * (100 - percent) / 100)
    minima = scratch.write(items.select("item", need.alias("need"), F.explode(F.slice("h", 1, keep)).alias("v")), "minima")
    lengths = [r.words for r in items.select("words").distinct().collect()]  # at most as many as a shingle has words
    word, bit = F.expr(f"shiftright(v & {BITMAP - 1}L, 6)"), F.expr("shiftleft(1L, CAST(v & 63 AS INT))")
    bits = minima.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()  # BITMAP bits
    bitmap = np.zeros(BITMAP >> 6, np.uint64)
    bitmap[bits["word"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.int64).view(np.uint64)
    hits = docs.select("text").mapInArrow(_hits(spark.sparkContext.broadcast(bitmap), lengths), "text_print string, v long").distinct()
    likely = hits.join(minima, "v").groupBy("text_print", "item", "need").agg(F.count("*").alias("n")).where("n >= need").select("text_print", "item")
    likely = scratch.write(likely, "likely")
    own = docs.withColumn("text_print", F.md5("text")).join(likely.select("text_print").distinct(), "text_print", "left_semi")
    sets = own.select("doc_id", "text_print", "text").mapInArrow(_sets(lengths), "doc_id long, text_print string, s array<long>")
    both = sets.join(likely, "text_print").join(items.select("item", "item_id", "h"), "item")
    return both.select("doc_id", "item_id", "h", "s").mapInArrow(_shared(percent), "doc_id long, item_id long, n_item long, n_shared long")


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment): each document row with each benchmark row that it contains.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are ignored.  n_item is the item's number
    of distinct shingles, n_shared how many of them the document has.  An item of fewer than ``width`` words is one
    shingle, its whole sequence, and is looked for as such.  Null, empty and blank texts contain nothing and are contained
    nowhere.  Repeated rows give a row for each pair of rows; ids of null are passed on.
    """
    spark = docs.sparkSession
    tune(spark)
    docs, scratch = texts(docs), Scratch(spark, "decontamination")
    items = benchmark.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(_item_sets(width), "item_id long, words int, h array<long>").where("size(h) > 0")
    items = scratch.write(items.withColumn("item", F.monotonically_increasing_id()), "items")
    schema = "doc_id long, item_id long, n_item long, n_shared long"
    total = items.agg(F.sum(F.size("h"))).first()[0] or 0
    if not total:
        found = spark.createDataFrame([], schema)
    elif total <= block:
        index = spark.sparkContext.broadcast(_Index(items.collect(), percent))  # ``block`` fingerprints at most
        found = docs.mapInArrow(_search(index, percent, width), schema)
    else:
        found = _distributed(docs, items, percent, scratch)
    return found.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item; a row with a doc_id of null stays."""
    leaks = contaminated(docs, benchmark, percent).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(docs.columns)
