"""Mixing sources to target shares of tokens by weighted sampling without replacement.

Every document gets the key -ln(u) / w (Efraimidis and Spirakis in logarithmic form): u is a
uniform number from the hash of its id, w its quality weight. The smallest keys of a source are
its weighted sample. A source with T tokens and budget B is taken whole floor(B / T) times, at
most max_repeats times, and of the rest of the budget the documents in key order whose running
token sum stays within it.

Running sums without one task per source: keys fall into bins of their logarithm, so a bin holds
a small share of a source whatever its weights are. Token sums per source and bin (a table of
bounded size) say in which bin the budget ends. That bin is split evenly between its least and
greatest key, again and again, until it holds at most ``BIN_ROWS`` rows; only these are ordered
by row. What reaches the driver is one row per source of the targets and split.

Defined results: null and empty texts have 0 tokens and never enter the mix; documents with a
null source or a source without a target are left out; sources of the targets without
documents get share 0; equal keys are ordered by id (rows of one id have one key and stay in
one bin); quality weights that are null or not positive count as the least weight.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpointed, table

#: Where the public tokenizers lie, and which one counts tokens; read on the driver only.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"
#: The pattern by which that tokenizer splits text before its merges; a fixed value of the public tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bins of a doubling of the key; parts of a split.
LOG_BINS, PARTS = 64, 1024
#: Rows of the last bin of a source that one task orders.
BIN_ROWS = 200_000
LEAST_WEIGHT = 0.05


def _encoding(ranks: bytes):
    import tiktoken

    return tiktoken.Encoding("siltworks", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})


_LOADED: dict[int, object] = {}


def token_counts(df: DataFrame, id_col: str, text_col: str, source_col: str, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(id, source, tokens, weight): size of each document in tokens, and its quality weight.

    The weight falls with the share of characters that are neither letters nor spaces and with
    repeated lines; whole texts are read. The vocabulary file is read here and sent to the tasks.
    """
    with open(os.path.join(folder, name), "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary, of fixed size
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text")).where("id is not null and source is not null and text is not null and text <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = sent.value
        key = xxhash.xxh3_64_intdigest(ranks)
        enc = _LOADED.get(key) or _LOADED.setdefault(key, _encoding(ranks))
        for batch in batches:
            texts = batch.column(2).to_pylist()
            n = [len(enc.encode_ordinary(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([_quality(t) for t in texts], pa.float64())], names=["id", "source", "tokens", "weight"])

    return docs.mapInArrow(run, "id bigint, source string, tokens bigint, weight double")


def _quality(text: str) -> float:
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(len, text.split()))
    marks = sum(text.count(c) for c in "|{}<>=_#*~^\\/0123456789")
    return max(LEAST_WEIGHT, (1 - min(1.0, 2 * marks / max(1, letters))) * len(set(lines)) / max(1, len(lines)))


def mixture(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen, report) for sized (id, source, tokens, weight) and targets (source, target_share, max_repeats).

    chosen: (id, source, tokens, copies), copies >= 1. report: one row per target with tokens
    available, budget, tokens taken, achieved share and epochs. Without total_tokens the mix is
    the largest in which every source that has tokens can reach its share within its repeats.
    """
    goal = targets.select(F.col("source").cast("string").alias("source"), F.col("target_share").cast("double").alias("target_share"), F.coalesce(F.col("max_repeats").cast("int"), F.lit(1)).alias("max_repeats")).where("source is not null and target_share > 0").dropDuplicates(["source"])
    weight = F.greatest(F.coalesce("weight", F.lit(LEAST_WEIGHT)), F.lit(LEAST_WEIGHT))
    u = (F.xxhash64(F.lit(7), "id").bitwiseAND(F.lit((1 << 53) - 1)).cast("double") + 0.5) / float(1 << 53)
    keyed = checkpointed(sized.where("tokens > 0").select("id", "source", "tokens", (-F.log(u) / weight).alias("key")))
    binned = _sums(keyed, F.floor(F.log2("key") * LOG_BINS))
    binned = checkpointed(binned)  # some thousand rows per source
    have = binned.groupBy("source").agg(F.sum("t").alias("available"))
    goal = goal.join(have, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    whole = F.lit(float(total_tokens)) if total_tokens is not None else F.coalesce(F.min(F.when(F.col("available") > 0, F.col("available") * F.col("max_repeats") / F.col("target_share"))).over(Window.partitionBy(F.lit(1))), F.lit(0.0))
    goal = goal.withColumn("budget", F.least(F.floor(whole * F.col("target_share") + 1e-6), F.col("available") * F.col("max_repeats"))).withColumn("epochs", F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(0).cast("int")).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("available"))
    goal = checkpointed(goal)  # one row per source of the targets
    cuts = keyed.sparkSession.createDataFrame(edge_bins(keyed, binned, goal) or [("", 1.0, 0.0, 0, 0)], _CUT)
    cuts = goal.select("source", "epochs", "rest", "available").join(cuts, "source", "left")
    placed = keyed.join(F.broadcast(cuts), "source")  # one row per source of the targets
    inside = placed.where("key < lo").select("id", "source", "tokens", (F.col("epochs") + 1).alias("copies"))
    outside = placed.where("lo is null or key > hi").where("epochs > 0").select("id", "source", "tokens", F.col("epochs").alias("copies"))
    edge = placed.where("key between lo and hi")
    ordered = edge.withColumn("running", F.col("before") + F.sum("tokens").over(Window.partitionBy("source").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, 0)))
    last = ordered.withColumn("copies", F.col("epochs") + (F.col("running") <= F.col("rest")).cast("int")).where("copies > 0").select("id", "source", "tokens", "copies")
    chosen = inside.unionByName(outside).unionByName(last)
    taken = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("taken"), F.count("*").alias("docs"), F.sum("copies").alias("rows_out"), F.max("copies").alias("most_copies"))
    report = goal.join(taken, "source", "left").select(
        "source", "target_share", "max_repeats", "available", "budget", "epochs",
        F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("rows_out", F.lit(0)).alias("rows_out"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )
    report = report.withColumn("achieved_share", F.when(F.sum("taken").over(Window.partitionBy(F.lit(1))) > 0, F.col("taken") / F.sum("taken").over(Window.partitionBy(F.lit(1)))).otherwise(0.0))
    return chosen, report


_CUT = "source string, lo double, hi double, before bigint, rows bigint"


def _sums(keyed: DataFrame, part) -> DataFrame:
    """(source, bin, t, rows, lo, hi): tokens, rows, least and greatest key of each part."""
    return keyed.groupBy("source", part.alias("bin")).agg(F.sum("tokens").alias("t"), F.count("*").alias("rows"), F.min("key").alias("lo"), F.max("key").alias("hi"))


def _ending(sums: DataFrame, goal: DataFrame) -> DataFrame:
    """Of each source the part in which its rest ends, with the tokens before it; sums has a column start."""
    before = F.col("start") + F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sums.withColumn("before", before).join(goal.select("source", "rest"), "source").where("before <= rest and before + t > rest").select("source", "lo", "hi", "before", "rows")


def edge_bins(keyed: DataFrame, binned: DataFrame, goal: DataFrame) -> list[tuple]:
    """(source, lo, hi, before, rows): of each source the keys among which its rest ends, split until they are BIN_ROWS rows or one key.

    Sources of which nothing or all is left over have a bin as well: its first row that exceeds the rest ends them.
    """
    spark = keyed.sparkSession
    cuts = {r.source: tuple(r) for r in _ending(binned.withColumn("start", F.lit(0)), goal).collect()}  # one row per source
    tried: set[tuple] = set()
    while large := [c for c in cuts.values() if c[4] > BIN_ROWS and c[1] < c[2] and c not in tried]:
        tried |= set(large)
        frame = spark.createDataFrame(large, _CUT).select("source", F.col("lo").alias("a"), F.col("hi").alias("b"), F.col("before").alias("start"))
        rows = keyed.join(F.broadcast(frame), "source").where("key between a and b")
        part = F.least(F.floor((F.col("key") - F.col("a")) / (F.col("b") - F.col("a")) * PARTS), F.lit(PARTS - 1))
        sums = rows.groupBy("source", "start", part.alias("bin")).agg(F.sum("tokens").alias("t"), F.count("*").alias("rows"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        cuts |= {r.source: tuple(r) for r in _ending(sums, goal).collect()}
    return list(cuts.values())


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sized = token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return mixture(sized, table(spark, sf_dir, "mix_target"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix: every chosen document, its tokens and how often it is repeated."""
    return _mix(spark, sf_dir)[0].select(F.col("id").alias("doc_id"), "source", "tokens", "copies")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and achieved share of every source of the targets."""
    return _mix(spark, sf_dir)[1]


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares}
