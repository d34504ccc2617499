"""Near-duplicate documents by bottom-k sketches of one hash function.

1. Each text becomes its set of word shingles (64-bit fingerprints); the k smallest are its sketch.  Texts with the same
   set form a class, and only the class's smallest id goes on.
2. Inverted lists over retained values generate overlaps, in two steps.  First, sketches of ``FIRST`` values: a set that
   has a partner shares at least `_required` of them with it, so sets with fewer values that occur twice at all go no
   further.  Then, sketches of ``K`` values of the rest: two similar sets share at least `_required` values, so it is
   enough to list a sketch under its rarest ``size - required + 1`` values.  Values that one sketch alone holds need no
   list, and passages that many documents share fall behind rarer values.
3. The place of a value in its sketch's order of rarity bounds the sizes that a partner met there can have (`_reach`):
   the values before it are in one of the two sets alone.  So documents that share a template, each with a part of its own
   that rules the threshold out, meet no partner at all: the lists cost pairs only where the sets can be similar enough.
   A list is first compared with one member of each band of sizes, that with the smallest share of values of its own (in
   a family, its common ancestor), which costs two pairs for each entry.  Verified links are followed for two steps, and
   members that agree in where they lead count as one.  Then the members that aren't in the list's largest such
   group meet the members of other groups, if sizes, places and parity bitmaps (each fingerprint flips a bit, so two
   differ in at most as many bits as the sets differ in members) allow the threshold; all three are certain.  Lists longer
   than ``TOGETHER`` are dealt by cells of sizes and by hashes of both sides.  Nothing is capped, and no link between
   groups is lost.
4. The union sketch (the smallest values of both) estimates the similarity; estimates clearly below the threshold are
   dropped; the rest is verified on the full sets.

Chance can lose a link in steps 2 and 4 only; `_floor` holds it below exp(-14), 1e-6, in each for a pair exactly at the
threshold, and less above it.  For sets of at most ``K`` shingles step 2's second part is exact.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import Scratch, texts, tune
from .shingles import WIDTH, shingle_sets

#: Sizes of the sketches: that rules most documents out, that of the inverted lists, that of the estimate.
FIRST, K, ESTIMATE = 32, 4096, 128
#: Longs of a set's parity bitmap.
LONGS = 16
#: The exponent of the chance to lose a pair.
SURE = 14.0
#: Members of a list that are met together; longer lists are dealt by sizes and hashes.
TOGETHER = 1024


def _floor(percent: int, k: int) -> int:
    """The share of k independent draws, each a hit with a chance of percent%, that they miss with exp(-SURE) at most
    (Chernoff's bound), times k."""
    p, low, high = percent / 100, 0.0, percent / 100
    if p >= 1:
        return k
    for _ in range(60):
        x = (low + high) / 2
        far = x * math.log(max(x, 1e-300) / p) + (1 - x) * math.log((1 - x) / (1 - p))
        low, high = (x, high) if far * k >= SURE else (low, x)
    return max(1, math.floor(low * k))


def _required(percent: int, k: int) -> Column:
    """Retained values that a set of n shingles has in common with every set at least this similar.

    Up to percent% of k, both sets are whole in their sketches: percent% of n.  Above, by chance; a set of at most k
    shingles and a larger partner have more than that in common for certain.
    """
    whole = k * percent // 100
    return F.when(F.col("n") <= whole, F.expr(f"(n * {percent} + 99) div 100")).otherwise(F.lit(_floor(percent, k)).cast("long"))


def _sketches(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fp", pa.binary()), ("sk", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, sketches = [], [], []
            for s in shingle_sets(batch.column("text"), width):
                sizes.append(len(s))
                prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sketches.append(s[:FIRST].view(np.int64))
            yield pa.record_batch([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))], schema=schema)

    return run


def _parity(s: np.ndarray) -> np.ndarray:
    """A bitmap of 64 * LONGS bits in which every fingerprint flips one."""
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) & (64 * LONGS - 1), minlength=64 * LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(width: int):
    """The whole set (fingerprints, ascending as unsigned numbers) and its bitmap."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column("text"), width))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in ([s.view(np.int64) for s in sets], [_parity(s) for s in sets])]
            yield pa.record_batch([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *lists], schema=schema)

    return run


def _verified(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for a, b, x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("s_a"), batch.column("s_b"), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    left.append(a)
                    right.append(b)
            yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], schema=schema)

    return run


def _estimated(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose union sketch doesn't rule the threshold out."""
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.slice("s", 1, ESTIMATE).alias(f"sk_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    # fingerprints are unsigned numbers in signed columns, so the upper half comes after the lower one
    order = F.transform(F.array_union("sk_a", "sk_b"), lambda v: F.struct((v < 0).alias("top"), v.alias("v")))
    known = F.transform(F.slice(F.array_sort(order), 1, ESTIMATE), lambda x: x["v"])
    both = both.select("a", "b", known.alias("known"), F.array_intersect("sk_a", "sk_b").alias("common"))
    # sets smaller than the sketch are known whole: their share is the similarity itself
    share, size = F.size(F.array_intersect("known", "common")), F.size("known")
    return both.where(F.when(size < ESTIMATE, 100 * share >= percent * size).otherwise(share >= _floor(percent, ESTIMATE))).select("a", "b")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    likely = scratch.write(_estimated(pairs, sets, percent), "likely")
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("s").alias(f"s_{x}"))
    out = scratch.write(likely.join(side("a"), "a").join(side("b"), "b").mapInArrow(_verified(percent), "a long, b long"), "found")
    scratch.drop(likely)
    return out


BITS = [f"b{i}" for i in range(LONGS)]


def _reach(percent: int) -> Column:
    """The largest size of a set that can share a similarity of ``percent`` with a set of n shingles if the first value that
    both hold, in the order of rarity, has place pos (from 0) in its sketch; below n, no set of n or more can.

    Whole sets x and y share at least percent * (n_x + n_y) / (100 + percent) values, and n - pos at most.  Of sets beyond
    ``K``, sketches share at least `_floor` values, K - pos at most.
    """
    left = F.least("n", F.lit(K)) - F.col("pos")
    whole = F.when(F.col("n") <= K, F.expr(f"({100 + percent} * (n - pos)) div {percent} - n")).otherwise(F.lit(0))
    sampled = F.when((left >= _floor(percent, K)) & (100 * F.col("n") > percent * K), F.expr(f"(100 * n) div {percent}")).otherwise(F.lit(0))
    return F.greatest(whole, sampled)


def _near(x: str, y: str) -> Column:
    """Whether the members ``x`` and ``y`` (prefixes of column names) of a list are within each other's reach."""
    return (F.col(f"{x}n") <= F.col(f"{y}reach")) & (F.col(f"{y}n") <= F.col(f"{x}reach"))


def _differ(percent: int, x: str, y: str) -> Column:
    """Whether the bitmaps of ``x`` and ``y`` rule the threshold out."""
    bits = sum((F.bit_count(F.col(f"{x}{b}").bitwiseXOR(F.col(f"{y}{b}"))) for b in BITS[1:]), F.bit_count(F.col(f"{x}b0").bitwiseXOR(F.col(f"{y}b0"))))
    return (100 + percent) * bits > (100 - percent) * (F.col(f"{x}n") + F.col(f"{y}n"))


def _lists(sets: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n, v, df, alone, pos, reach): each set under the rarest of its retained values that others retain too.

    df counts the sets that retain v, ``alone`` the document's values that no other retains; they have the first places.
    """
    values = sets.select("doc_id", "n", F.explode(F.slice("s", 1, K)).alias("v"))
    common = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    shared = values.join(common, "v").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
    # as many as the prefix has, less the values that no other sketch holds, which come first in it
    alone = F.least("n", F.lit(K)) - F.size("vs")
    prefix = F.size("vs") - _required(percent, K) + 1
    lists = shared.select("doc_id", "n", alone.alias("alone"), F.posexplode(F.slice("vs", 1, F.greatest(prefix, F.lit(0)).cast("int"))).alias("at", "x"))
    lists = lists.select("doc_id", "n", F.col("x.v").alias("v"), F.col("x.df").alias("df"), "alone", (F.col("alone") + F.col("at")).alias("pos"))
    return lists.withColumn("reach", _reach(percent))


def _stars(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b): each member of a list with the one of its band of sizes that has the smallest share of values alone.

    Bands are two thresholds wide, and a member is in two that overlap by half.
    """
    size = F.log(F.col("n").cast("double")) / (-2 * math.log(percent / 100)) if percent < 100 else F.col("n").cast("double")
    bands = lists.withColumn("band", F.explode(F.array(F.floor(size) * 2, F.floor(size + 0.5) * 2 + 1)))
    first = F.floor(F.greatest("alone", F.lit(0)) * 1000 / F.col("n")) * (1 << 52) + F.xxhash64("doc_id").bitwiseAND((1 << 52) - 1)
    bands = bands.withColumn("first", first)
    tops = bands.groupBy("v", "band").agg(*(F.min_by(c, "first").alias(f"o_{c}") for c in ("doc_id", "n", "reach")), F.count("*").alias("m")).where("m > 1")
    pairs = bands.join(tops.drop("m"), ["v", "band"]).where((F.col("doc_id") != F.col("o_doc_id")) & _near("", "o_"))
    return pairs.select(F.col("doc_id").alias("a"), F.col("o_doc_id").alias("b")).distinct()


def _labels(stars: DataFrame) -> DataFrame:
    """(doc_id, c): where two steps over links to list heads lead; equal c means linked in the end."""
    up = stars.groupBy("a").agg(F.min("b").alias("b"))
    return up.join(up.select(F.col("a").alias("b"), F.col("b").alias("top")), "b", "left").select(F.col("a").alias("doc_id"), F.coalesce("top", "b").alias("c"))


def _dealt(members: DataFrame, side: str, percent: int, low: Column, high: Column) -> DataFrame:
    """Members of lists with the cells of the list in which they are met.

    A list of up to TOGETHER is one cell.  The cells of a longer one are bands of sizes, from that of ``low`` to that of
    ``high``, by parts of the first side (``x``) by parts of the second; a member goes to its part of its own side and to
    all of the other.
    """
    long = F.col("df") > TOGETHER
    parts = F.ceil(F.col("df") / TOGETHER).cast("int")
    step = -math.log(percent / 100) / 2 if percent < 100 else 1e-3
    band = lambda n: F.floor(F.log(n.cast("double")) / step)
    own = F.array(F.pmod(F.xxhash64("doc_id"), parts).cast("int"))
    every = F.sequence(F.lit(0), parts - 1)
    out = members.withColumn("size", F.explode(F.when(long, F.sequence(band(low), band(high))).otherwise(F.array(F.lit(0).cast("long")))))
    for cell, mine in (("i", side == "x"), ("j", side == "y")):
        out = out.withColumn(cell, F.explode(F.when(long, own if mine else every).otherwise(F.array(F.lit(0)))))
    return out


def _others(lists: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs of members of a list with different labels that can be similar enough."""
    known = scratch.write(lists.drop("alone", "pos").join(labels, "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id")), "known")
    tops = known.groupBy("v", "c").agg(F.count("*").alias("m")).groupBy("v").agg(F.max(F.struct("m", "c")).alias("top"), F.count("*").alias("k")).where("k > 1")
    rest = known.join(tops.select("v", F.col("top.c").alias("top")), "v")
    rest = scratch.write(rest.join(sets.select("doc_id", *(F.col("bits")[i].alias(b) for i, b in enumerate(BITS))), "doc_id"), "rest")
    keys, names = ["v", "size", "i", "j"], ["doc_id", "n", "reach", "c", *BITS]
    least = F.expr(f"greatest(({percent} * n) div 100, 1)")
    x = _dealt(rest.where("c <> top"), "x", percent, least, F.greatest("reach", least)).select(*keys, *(F.col(c).alias(f"x_{c}") for c in names))
    y = _dealt(rest, "y", percent, F.col("n"), F.col("n")).select(*keys, (F.col("c") == F.col("top")).alias("main"), *(F.col(c).alias(f"y_{c}") for c in names))
    once = F.col("main") | (F.col("x_doc_id") < F.col("y_doc_id"))
    pairs = x.join(y, keys).where((F.col("x_c") != F.col("y_c")) & once & _near("x_", "y_") & ~_differ(percent, "x_", "y_"))
    return pairs.select(F.least("x_doc_id", "y_doc_id").alias("a"), F.greatest("x_doc_id", "y_doc_id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text; other columns ignored).

    Two documents are linked if 100 * |intersection| >= ``percent`` * |union| of their shingle sets.  component_id is the
    smallest doc_id reachable over links, kept whether it is the document's own.
    Null, empty and blank texts have no shingles and are linked with nothing.  A doc_id of null is a document of its own:
    its component_id is null and it is kept.  A repeated doc_id yields a row for each of its rows; with different texts,
    each row follows its own text's class, and links of any of them are links of the id.  An empty table gives an empty
    one.
    """
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "neardup")
    docs = texts(docs)
    sketches = scratch.write(docs.mapInArrow(_sketches(width), "doc_id long, n long, fp binary, sk array<long>"), "sketches")
    classes = scratch.write(sketches.where("n > 0 AND doc_id IS NOT NULL").groupBy("fp", "n").agg(F.min("doc_id").alias("rep")), "classes")

    reps = sketches.join(classes.select("fp", F.col("rep").alias("doc_id")), ["fp", "doc_id"], "left_semi")
    values = scratch.write(reps.select("doc_id", "n", F.explode(F.array_distinct("sk")).alias("v")), "values")
    common = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1").select("v")
    likely = scratch.write(values.join(common, "v", "left_semi").groupBy("doc_id", "n").agg(F.count("*").alias("shared")).where(F.col("shared") >= _required(percent, FIRST)).select("doc_id").distinct(), "likely")
    scratch.drop(values)

    sets = scratch.write(docs.join(likely, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).mapInArrow(_sets(width), "doc_id long, n long, s array<long>, bits array<long>"), "sets")
    lists = scratch.write(_lists(sets, percent), "lists")
    stars = _linked(scratch.write(_stars(lists, percent), "pairs"), sets, percent, scratch)
    labels = scratch.write(_labels(stars), "labels")
    links = _linked(scratch.write(_others(lists, labels, sets, percent, scratch), "pairs"), sets, percent, scratch).union(stars)

    # links between labels, then the smallest document of the labels that are linked
    label = lambda x: labels.select(F.col("doc_id").alias(x), F.col("c").alias(f"c_{x}"))
    between = links.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    joined = scratch.write(components(between, scratch), "joined")
    nodes = links.select(F.col("a").alias("rep")).union(links.select(F.col("b").alias("rep"))).distinct().join(labels.withColumnRenamed("doc_id", "rep"), "rep", "left").withColumn("node", F.coalesce("c", "rep"))
    nodes = scratch.write(nodes.join(joined, "node", "left").select("rep", F.coalesce("component", "node").alias("group")), "nodes")
    merged = nodes.join(nodes.groupBy("group").agg(F.min("rep").alias("component")), "group").select("rep", "component")
    known = classes.join(merged, "rep", "left").select("fp", "n", F.coalesce("component", "rep").alias("component"))
    out = sketches.drop("sk").join(scratch.write(known, "known"), ["fp", "n"], "left")
    own = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), own.eqNullSafe(F.col("doc_id")).alias("kept"))
