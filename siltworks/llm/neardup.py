"""Near-duplicate records: an exact set-similarity join over distinct word n-grams.

Vertical partitioning. All n-grams have one global order, rare first: by their count in a
sketch over the whole collection, then by hash. Any order gives the right result, a rare-first
one gives it fast. The order is cut into fragments; every fragment counts the overlaps of the
records that meet in it, and the partial counts are summed per pair.

1. One scan turns each text into its set of n-grams, names the set by a 64-bit digest (records
   with equal sets form a class and are joined once), and adds the n-grams to the sketch.
2. The rare fragments hold the first n - a + k n-grams of each class (a: least overlap with any
   partner, k = ``EXTRA``). Two sets with the wanted overlap share at least min(k, a) of them.
   Each fragment is a range of the order and one task: it counts, for the classes that meet in
   its n-grams with fitting sizes and places, how many they share. Sums of at least min(k, a)
   make a pair of candidates. n-grams that the sketch shows to be unique meet nobody and are
   left out; the sketch bounds how many records meet in an n-gram of these fragments.
3. n-grams beyond that bound (``HOT``) form a fragment of their own, which is joined with salt:
   the classes of one n-gram spread over many tasks. The smaller class of a pair must hold the
   n-gram early in its order, so only such entries look for partners, and only in the sizes that
   their place leaves; n-grams that stand early in no class meet nobody.
4. For the candidates the fragments of the whole order count the full overlap, and the sums
   decide exactly. No candidate is capped or sampled.

Defined results: null, empty and short texts have no pairs; records with the same id and the
same text are one record; very long texts are cut into fragments by n-gram, never shortened.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed, table
from .graph import components
from .text import WordHasher, mixed, ngrams, words

#: Cells of the counting sketch (2 ** SKETCH_BITS bytes, for much text up to 2 ** MOST_BITS), characters a cell, and the blocks it travels in.
SKETCH_BITS, MOST_BITS, CELL_CHARS, BLOCKS = 24, 26, 16, 64
#: Counts that a byte of the sketch stands for: exact up to 128, then steps of an eighth; counts between are rounded up.
_LEVELS = np.concatenate((np.arange(128), np.ceil(128 * 2 ** (np.arange(128) / 6)))).astype(np.int64)
#: Shared n-grams asked of the rare fragment.
EXTRA = 4
#: Pivots that cut the global order: n-grams whose sketch count is at most 2, 8, 64, and the rest.
PIVOTS = (2, 8, 64)
#: Sketch count beyond which an n-gram is joined with salt; below it, it is a proven bound of the records that meet there.
HOT = PIVOTS[-1]
#: n-grams of a rare fragment, classes of a hot n-gram that one task takes, and the ratio of sizes that meet in one bucket.
FRAGMENT_GRAMS, SALT_CLASSES, SIZE_STEP = 1_500_000, 2_000, 1.05


def gram_set(text: str | None, hasher: WordHasher, n: int, min_words: int) -> np.ndarray | None:
    if not text:
        return None
    ws = words(text)
    if len(ws) < max(min_words, n):
        return None
    return np.unique(ngrams(hasher(ws), n))


def _class_of(grams: np.ndarray) -> int:
    """Digest of a set of n-grams, independent of order."""
    with np.errstate(over="ignore"):
        return int((mixed(grams).sum(dtype=np.uint64) ^ np.uint64(len(grams))).astype(np.int64))


def _slots(grams: np.ndarray, cells: int) -> np.ndarray:
    return (grams >> np.uint64(65 - cells.bit_length())).astype(np.int64)


def _coded(counts: np.ndarray) -> np.ndarray:
    """The counts as bytes of the sketch."""
    codes = np.minimum(counts, 127).astype(np.uint8)
    high = np.flatnonzero(counts > 127)
    codes[high] = np.minimum(np.searchsorted(_LEVELS, counts[high]), 255)
    return codes


def _sketch_bits(texts: DataFrame) -> int:
    """Size of the sketch for so much text; it decides how well n-grams are ordered, not what is found."""
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 1
    return min(MOST_BITS, max(SKETCH_BITS, math.ceil(math.log2(chars / CELL_CHARS))))


def _classes_and_sketch(df: DataFrame, n: int, min_words: int, bits: int = SKETCH_BITS) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sketch, any_text = WordHasher(), np.zeros(1 << bits, np.uint16), False
        for batch in batches:
            ids, sizes, classes = [], [], []
            found = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                g = gram_set(text, hasher, n, min_words)
                if g is None or i is None:
                    continue
                ids.append(i)
                sizes.append(len(g))
                classes.append(_class_of(g))
                found.append(_slots(g, len(sketch)))
                if len(found) >= 256:
                    _count(sketch, found)
                    found = []
            if found:
                _count(sketch, found)
            any_text |= bool(ids)
            if ids:
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(classes, pa.int64()), pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary())], names=["id", "n", "c", "block", "data"])
        if any_text:
            pack = zstandard.ZstdCompressor(level=1)
            step = len(sketch) // BLOCKS
            data = [pack.compress(_coded(sketch[b * step : (b + 1) * step]).tobytes()) for b in range(BLOCKS)]
            yield pa.record_batch([pa.nulls(BLOCKS, pa.int64()), pa.nulls(BLOCKS, pa.int32()), pa.nulls(BLOCKS, pa.int64()), pa.array(range(BLOCKS), pa.int32()), pa.array(data, pa.binary())], names=["id", "n", "c", "block", "data"])

    return df.mapInArrow(run, "id bigint, n int, c bigint, block int, data binary")


def _count(sketch: np.ndarray, found: list[np.ndarray]) -> None:
    slots, times = np.unique(np.concatenate(found), return_counts=True)
    sketch[slots] = np.minimum(sketch[slots].astype(np.int64) + times, 65535)


def _merged_sketch(parts: DataFrame, bits: int = SKETCH_BITS) -> bytes:
    """The sum of the partial sketches, compressed; every block is added up as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, sums = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for b, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = _LEVELS[np.frombuffer(unpack.decompress(data), np.uint8)]
                if b in sums:
                    sums[b] += x
                else:
                    sums[b] = x
        if sums:
            pack = zstandard.ZstdCompressor(level=1)
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([pack.compress(_coded(x).tobytes()) for x in sums.values()], pa.binary())], names=["block", "data"])

    rows = parts.select("block", "data").repartition(BLOCKS, "block").mapInArrow(run, "block int, data binary").collect()  # BLOCKS rows, 2 ** bits bytes before compression
    step, unpack = (1 << bits) // BLOCKS, zstandard.ZstdDecompressor()
    whole = np.zeros(1 << bits, np.uint8)
    for r in rows:
        whole[r.block * step : (r.block + 1) * step] = np.frombuffer(unpack.decompress(bytes(r.data)), np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(whole.tobytes())


def _ordered(grams: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams in the global order, and their sketch counts."""
    times = sketch[_slots(grams, len(sketch))]
    at = np.lexsort((grams, times))
    return grams[at], times[at]


def _load(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)


def _fragment(grams: np.ndarray, times: np.ndarray, fragments: int) -> np.ndarray:
    """Number of the range of the global order in which each n-gram stands; those of hot ones come last."""
    part = np.searchsorted(PIVOTS, times).astype(np.int64)
    place = ((grams >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
    return (part * fragments + place).astype(np.int32)


def _need(threshold: float) -> Column:
    """Overlap that two sets of sizes n1 and n2 need."""
    return F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("n1") + F.col("n2")) - 1e-9).cast("int")


def _early(p, n, threshold: float, least, ceil):
    """Whether the place of an n-gram is one at which a class of this size can meet a class as large or larger; for columns and arrays."""
    need = ceil(2 * threshold / (1 + threshold) * n - 1e-9)
    return p < n - need + least(EXTRA, need)


def _most(p, n, threshold: float, least):
    """Size of the largest class that a class can meet with an n-gram at this place, rounded up; for columns and arrays."""
    return least(n / threshold, (n - p + EXTRA - 1) * ((1 + threshold) / threshold) - n) + 1e-6


#: Partial overlaps (c1, c2, n1, n2, shared), or a class in a hot n-gram (c1, n1, g, p).
_MET = "c1 bigint, c2 bigint, n1 int, n2 int, shared int, g bigint, p int"


def _meetings(batches: Iterator[pa.RecordBatch], threshold: float, hot: int) -> Iterator[pa.RecordBatch]:
    """Partial overlaps of a fragment: rows sorted by n-gram; what remains of the last n-gram of a batch waits for the next.

    Fragments from number ``hot`` on are passed through, early places of an n-gram first: each
    class of an n-gram once, and late ones only where an early one of fitting size came before.
    """
    rest, last = None, None
    for batch in batches:
        if batch.num_rows and batch.column(0)[0].as_py() >= hot:
            g, p, c, n = (batch.column(k).to_numpy() for k in range(1, 5))
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
            if last is not None:  # the last row of the batch before
                new[0] = (g[0], c[0]) != last[:2]
            early = _early(p, n, threshold, np.minimum, np.ceil)
            first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(g))))
            low = np.minimum.reduceat(np.where(early, n, np.iinfo(np.int32).max), first).astype(np.float64)
            high = np.maximum.reduceat(np.where(early, _most(p, n, threshold, np.minimum), 0.0), first)
            if last is not None and last[0] == g[0]:
                low[0], high[0] = min(low[0], last[2]), max(high[0], last[3])
            last = (g[-1], c[-1], low[-1], high[-1])
            new &= early | ((n >= low[group]) & (n <= high[group]))
            k = int(new.sum())
            if k:
                yield pa.record_batch([pa.array(c[new]), pa.nulls(k, pa.int64()), pa.array(n[new]), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.array(g[new]), pa.array(p[new])], names=["c1", "c2", "n1", "n2", "shared", "g", "p"])
            continue
        t = [batch.column(k).to_numpy() for k in range(1, 5)]  # g, p, c, n
        if rest is not None:
            t = [np.concatenate(x) for x in zip(rest, t)]
        cut = int(np.searchsorted(t[0], t[0][-1])) if len(t[0]) else 0
        rest = [x[cut:] for x in t]
        if cut:
            yield from _counted([x[:cut] for x in t], threshold)
    if rest is not None and len(rest[0]):
        yield from _counted(rest, threshold)


def _counted(t: list[np.ndarray], threshold: float) -> Iterator[pa.RecordBatch]:
    g, p, c, n = t
    new = np.ones(len(g), bool)  # a class may come from several tasks
    new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
    g, p, c, n = (x[new] for x in (g, p, c, n))
    one, two, d = [], [], 1
    while d < len(g):
        i = np.flatnonzero(g[:-d] == g[d:])
        if not len(i):
            break
        j = i + d
        need = np.ceil(threshold / (1 + threshold) * (n[i].astype(np.int64) + n[j]) - 1e-9)
        share = np.minimum(EXTRA, need)
        ok = (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9) & (p[i] < n[i] - need + share) & (p[j] < n[j] - need + share)
        one.append(i[ok])
        two.append(j[ok])
        d += 1
    if not one or not sum(map(len, one)):
        return
    i, j = np.concatenate(one), np.concatenate(two)
    order = np.lexsort((c[j], c[i]))  # classes of an n-gram are sorted, so c[i] < c[j]
    i, j = i[order], j[order]
    first = np.flatnonzero((np.diff(c[i], prepend=c[i[0]] - 1) != 0) | (np.diff(c[j], prepend=c[j[0]] - 1) != 0))
    count = np.diff(np.append(first, len(i)))
    yield pa.record_batch([pa.array(c[i[first]]), pa.array(c[j[first]]), pa.array(n[i[first]]), pa.array(n[j[first]]), pa.array(count.astype(np.int32)), pa.nulls(len(count), pa.int64()), pa.nulls(len(count), pa.int32())], names=["c1", "c2", "n1", "n2", "shared", "g", "p"])


def _salted(hot: DataFrame, threshold: float) -> DataFrame:
    """Partial overlaps in the hot n-grams (g, p, c, n): the smaller class of a pair, at an early place, goes to the buckets of all sizes that it can meet there; the classes of one bucket come in parts, each part met with all smaller ones."""
    p, n = F.col("p"), F.col("n")
    bucket = lambda size: F.floor(F.log(size) / math.log(SIZE_STEP)).cast("int")
    small = hot.where(_early(p, n, threshold, lambda a, b: F.least(F.lit(a), b), F.ceil))
    small = small.withColumn("b", F.explode(F.sequence(bucket(n), bucket(F.greatest(n, _most(p, n, threshold, F.least))))))
    large = hot.withColumn("b", bucket(n))
    parts = large.groupBy("g", "b").agg(F.count("*").alias("k")).where(F.col("k") > SALT_CLASSES).select("g", "b", F.ceil(F.col("k") / SALT_CLASSES).cast("int").alias("parts"))
    some = F.coalesce("parts", F.lit(1))
    x = small.join(parts, ["g", "b"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), some - 1))).select("g", "b", "part", *(F.col(k).alias(f"{k}1") for k in "pcn"))
    y = large.join(parts, ["g", "b"], "left").withColumn("part", F.pmod(F.xxhash64("c"), some).cast("int")).select("g", "b", "part", *(F.col(k).alias(f"{k}2") for k in "pcn"))
    need = _need(threshold)
    share = F.least(F.lit(EXTRA), need)
    smaller = (F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("c1") < F.col("c2")))
    meet = smaller & (F.col("n1") >= threshold * F.col("n2") - 1e-9) & (F.col("p1") < F.col("n1") - need + share) & (F.col("p2") < F.col("n2") - need + share)
    kept = F.col("c1") < F.col("c2")
    met = y.join(x, ["g", "b", "part"]).where(meet)
    met = met.select(*(F.when(kept, F.col(f"{k}{i}")).otherwise(F.col(f"{k}{3 - i}")).alias(f"{k}{i}") for k in "cn" for i in (1, 2)))
    return met.groupBy("c1", "c2", "n1", "n2").agg(F.count("*").cast("int").alias("shared"))


def near_duplicate_classes(df: DataFrame, id_col: str, text_col: str, n: int, threshold: float, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(members, links): class of each record (id, c, n), and the pairs of classes (c1 < c2) that reach the threshold."""
    spark = df.sparkSession
    texts = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null and text <> ''")
    bits = _sketch_bits(texts)
    first = checkpointed(_classes_and_sketch(texts, n, min_words, bits))
    members = first.where("id is not null").select("id", "c", "n")
    total = members.agg(F.sum("n")).first()[0] or 0
    # at least a task per core; beyond that fragments grow in number, not in size
    fragments_ = max(math.ceil(spark.sparkContext.defaultParallelism / len(PIVOTS)), math.ceil(total * (1 - threshold) / FRAGMENT_GRAMS))
    packed = spark.sparkContext.broadcast(_merged_sketch(first.where("block is not null"), bits))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sketch, done = WordHasher(), _load(packed.value), set()
        for batch in batches:
            out: list[tuple[np.ndarray, np.ndarray, int, int]] = []
            for text in batch.column(0).to_pylist():
                g = gram_set(text, hasher, n, min_words)
                if g is None:
                    continue
                c = _class_of(g)
                if c in done:
                    continue
                if len(done) < 1_000_000:
                    done.add(c)
                size = len(g)
                g, times = _ordered(g, sketch)
                p = min(size, size - math.ceil(threshold * size - 1e-9) + EXTRA)
                keep = np.flatnonzero(times[:p] > 1)
                out.append((g[keep], times[keep], keep, c, size))
            if out:
                k = [len(x[0]) for x in out]
                grams, times = (np.concatenate([x[i] for x in out]) for i in (0, 1))
                yield pa.record_batch(
                    [pa.array(_fragment(grams, times, fragments_)), pa.array(grams.view(np.int64)), pa.array(np.concatenate([x[2] for x in out]).astype(np.int32)), pa.array(np.repeat(np.array([x[3] for x in out], np.int64), k)), pa.array(np.repeat(np.array([x[4] for x in out], np.int32), k))],
                    names=["f", "g", "p", "c", "n"],
                )

    entries = texts.select("text").mapInArrow(prefixes, "f int, g bigint, p int, c bigint, n int")
    hot = len(PIVOTS) * fragments_
    count = functools.partial(_meetings, threshold=threshold, hot=hot)
    late = (F.col("f") >= hot) & ~_early(F.col("p"), F.col("n"), threshold, lambda a, b: F.least(F.lit(a), b), F.ceil)
    met = checkpointed(entries.repartitionById((len(PIVOTS) + 1) * fragments_, "f").sortWithinPartitions("g", late, "c").mapInArrow(count, _MET))
    partial = met.where("shared is not null").select("c1", "c2", "n1", "n2", "shared")
    partial = partial.unionByName(_salted(met.where("shared is null").select("g", "p", F.col("c1").alias("c"), F.col("n1").alias("n")), threshold))
    pairs = partial.groupBy("c1", "c2", "n1", "n2").agg(F.sum("shared").alias("shared")).where(F.col("shared") >= F.least(F.lit(EXTRA), _need(threshold))).select("c1", "c2", "n1", "n2")
    pairs = checkpointed(pairs)

    # one record of each class in a pair, cut into the fragments of the order
    wanted = pairs.select(F.explode(F.array("c1", "c2")).alias("c")).distinct()
    chosen = members.join(wanted, "c").groupBy("c").agg(F.min("id").alias("id"))

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sketch = WordHasher(), _load(packed.value)
        for batch in batches:
            cs, fs, gs = [], [], []
            for c, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                g = gram_set(text, hasher, n, min_words)
                if g is None:
                    continue
                part = np.searchsorted(PIVOTS, sketch[_slots(g, len(sketch))])
                for f in range(len(PIVOTS) + 1):
                    own = g[part == f]
                    if len(own):
                        cs.append(c)
                        fs.append(f)
                        gs.append(own.view(np.int64))
            if cs:
                ends = np.concatenate(([0], np.cumsum([len(v) for v in gs]))).astype(np.int32)
                yield pa.record_batch([pa.array(cs, pa.int64()), pa.array(fs, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(gs)))], names=["c", "f", "gs"])

    cut = texts.join(chosen, "id").select("c", "text").mapInArrow(fragments, "c bigint, f int, gs array<bigint>")
    cut = checkpointed(cut)
    one, two = (cut.select(F.col("c").alias(f"c{i}"), "f", F.col("gs").alias(f"gs{i}")) for i in (1, 2))
    partial = pairs.join(one, "c1").join(two, ["c2", "f"]).select("c1", "c2", "n1", "n2", F.size(F.array_intersect("gs1", "gs2")).alias("o"))
    links = partial.groupBy("c1", "c2", "n1", "n2").agg(F.sum("o").alias("o")).where(F.col("o") >= threshold * (F.col("n1") + F.col("n2") - F.col("o")) - 1e-9)
    return members, links.select("c1", "c2", (F.col("o") / (F.col("n1") + F.col("n2") - F.col("o"))).alias("similarity"))


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, n: int = 5, threshold: float = 0.8, min_words: int = 1) -> DataFrame:
    """All pairs of records (a < b) whose n-gram sets reach the threshold, copies spelled out."""
    members, links = near_duplicate_classes(df, id_col, text_col, n, threshold, min_words)
    ids = members.select("id", "c").distinct()
    a, b = ids.select(F.col("id").alias("a"), F.col("c").alias("c1")), ids.select(F.col("id").alias("b"), F.col("c").alias("c2"))
    across = links.join(a, "c1").join(b, "c2").select("a", "b")
    within = a.join(b, (F.col("c1") == F.col("c2")) & (F.col("a") < F.col("b"))).select("a", "b")
    return across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").union(within).distinct()


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, n: int = 5, threshold: float = 0.8, min_words: int = 1) -> DataFrame:
    """One row per record that has a copy or near copy: (id, group_id, links).

    group_id is the least id of the records reachable over links; links counts the classes
    linked to the record's own class. Copies are told by their class, not paired.
    """
    members, links = near_duplicate_classes(df, id_col, text_col, n, threshold, min_words)
    links = checkpointed(links)
    comp = components(links, "c1", "c2").select(F.col("node").alias("c"), "component")
    degree = links.select(F.explode(F.array("c1", "c2")).alias("c")).groupBy("c").agg(F.count("*").alias("links"))
    ids = members.select("id", "c").distinct()
    copies = ids.groupBy("c").agg(F.count("*").alias("copies"))
    named = ids.join(copies, "c").join(comp, "c", "left").join(degree, "c", "left").where("component is not null or copies > 1").withColumn("component", F.coalesce("component", "c"))
    least = named.groupBy("component").agg(F.min("id").alias("group_id"))
    return named.join(least, "component").select("id", "group_id", F.coalesce("links", F.lit(0)).alias("links"), "copies")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of batch items whose word triples overlap by 0.7 or more, from 80 words on."""
    pairs = near_duplicate_pairs(table(spark, sf_dir, "batch_item"), "item_id", "markdown", n=3, threshold=0.7, min_words=80)
    return pairs.select(F.col("a").alias("item_id_a"), F.col("b").alias("item_id_b"))


def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of every batch item that has near copies: five-word shingles, similarity 0.8."""
    return near_duplicate_groups(table(spark, sf_dir, "batch_item"), "item_id", "markdown").select(F.col("id").alias("item_id"), "group_id", "links", "copies")


SQL = {
    "p7_found": r"""WITH w AS (SELECT item_id, regexp_extract_all(lower(markdown), '[\p{L}\p{N}]+') AS w FROM batch_item WHERE markdown IS NOT NULL),
        g AS (SELECT DISTINCT item_id, hash(array_to_string(w[i:i + 2], ' ')) AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 80)), n AS (SELECT item_id, count(*) AS n FROM g GROUP BY item_id),
        o AS (SELECT a.item_id AS a, b.item_id AS b, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.item_id < b.item_id GROUP BY ALL)
        SELECT a AS item_id_a, b AS item_id_b FROM o JOIN n x ON x.item_id = a JOIN n y ON y.item_id = b WHERE o >= 0.7 * (x.n + y.n - o)""",
}
QUERIES = {"p7_found": p7_found, "p7_groups": p7_groups}
