"""Lines and blocks of lines that one site repeats over many documents.

One scan reads every text once and writes the identifiers of its lines that count, with their
numbers; all else works on that small table. Every chunk of it concatenates the identifiers of
its documents, source by source, into one integer string with separators, sorts its suffixes by
prefix doubling, and reads repeated identifiers off the common prefixes of neighbours. An
identifier covers the source, so equal lines of two sources never match. Chunks hold whole
documents and are bounded, however many rows a source has; the document counts of a line, which
add up over chunks, are summed after a partial count in each chunk. A line is deleted when it
spans at least ``min_docs`` documents; so does every line of a block that does.

Blocks (``repeated_blocks``) are read off the LCP intervals of the suffix array over the runs of
repeated lines of a whole source, forwards and backwards. Documents with the same runs come in
once, with their number, so a source takes the memory of its distinct runs.

Defined results: null and empty texts have no lines; lines without letters, fenced code with
its fences and lines that start with ``|`` never count; a line that occurs twice in a document
counts once; each row is a document of its own (ids are unique); a null source is a source.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed, table
from .text import mixed

_NO_LETTER = re.compile(r"[\W\d_]+")
_FENCE = re.compile(r"[ \t]{0,3}(`{3,}|~{3,})")
#: Largest set of repeated lines (8 bytes each) that is sent to every task; beyond it lines are joined by shuffle.
MAX_SENT = 2_000_000
#: Line identifiers sorted at a time.
CHUNK_LINES = 200_000


def line_keys(text: str) -> list[tuple[int, str]]:
    """(line number, normalised letters) of the lines that count."""
    out, fence = [], ""
    for i, line in enumerate(text.split("\n")):
        m = _FENCE.match(line)
        if fence:
            if m and m.group(1)[0] == fence[0] and len(m.group(1)) >= len(fence) and not line[m.end() :].strip():
                fence = ""
            continue
        if m:
            fence = m.group(1)
            continue
        if line.startswith("|"):
            continue
        key = _NO_LETTER.sub(" ", line.lower()).strip()
        if not key.isascii():  # numerals such as ½ are word characters, not letters
            key = _NO_LETTER.sub(" ", "".join(c if c.isalpha() else " " for c in key)).strip()
        if key:
            out.append((i, key))
    return out


class _Ids:
    def __init__(self) -> None:
        self.cache: dict[tuple, int] = {}

    def __call__(self, source: str | None, key: str) -> int:
        k = (source, key)
        got = self.cache.get(k)
        if got is None:
            if len(self.cache) > 300_000:
                self.cache.clear()
            got = self.cache[k] = xxhash.xxh3_64_intdigest(key, seed=xxhash.xxh3_64_intdigest(source)) if source is not None else xxhash.xxh3_64_intdigest(key)
        return got


def suffix_array(seq: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of seq in order by their first ``most`` items (prefix doubling), and neighbours' common prefix up to that."""
    n = len(seq)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ranks = [np.unique(seq, return_inverse=True)[1].astype(np.int64)]
    k = 1
    while k < most and ranks[-1].max() < n - 1:
        last = ranks[-1]
        right = np.full(n, -1, np.int64)
        right[: n - k] = last[k:]
        pair = last * (n + 1) + right + 1
        ranks.append(np.unique(pair, return_inverse=True)[1].astype(np.int64))
        k *= 2
    order = np.argsort(ranks[-1], kind="stable")
    # common prefix by descending powers of two
    lcp = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for level in range(len(ranks) - 1, -1, -1):
        ok = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[ok] = ranks[level][a[ok]] == ranks[level][b[ok]]
        step = np.where(same, 1 << level, 0)
        lcp[1:] += step
        a += step
        b += step
    return order, lcp


_ENCODED = "id bigint, source bigint, numbers array<int>, lines array<bigint>"


def encoded_lines(df: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(id, source, numbers, lines): of every document with lines that count, their numbers and identifiers; source: its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids()
        for batch in batches:
            out_id, out_source, numbers, lines = [], [], [], []
            for i, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                keys = line_keys(text)
                if keys:
                    out_id.append(i)
                    out_source.append(0 if source is None else xxhash.xxh3_64_intdigest(source))
                    numbers.append([n for n, _ in keys])
                    lines.append([ids(source, k) for _, k in keys])
            if out_id:
                ends = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in numbers]))).astype(np.int32))
                flat = np.fromiter(chain.from_iterable(lines), np.uint64).view(np.int64)
                yield pa.record_batch([pa.array(out_id, pa.int64()), pa.array(np.array(out_source, np.uint64).view(np.int64)), pa.ListArray.from_arrays(ends, pa.array(np.fromiter(chain.from_iterable(numbers), np.int32))), pa.ListArray.from_arrays(ends, pa.array(flat))], names=["id", "source", "numbers", "lines"])

    return checkpointed(_three(df, id_col, source_col, text_col).mapInArrow(run, _ENCODED))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, items) of a list column without nulls."""
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()


def _repeats(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of one chunk: line identifiers and the number of documents that each spans.

    The suffixes that start with the same identifier stand together in the suffix array; an
    interval of neighbours with common prefix 1 or more is one identifier, and its distinct
    documents are counted there.
    """
    size = np.array([len(d) for d in docs])
    doc = np.repeat(np.arange(len(docs)), size)
    seq = np.concatenate(docs)
    place = np.arange(len(seq)) + doc  # a separator after every document
    spaced = np.empty(len(seq) + len(docs), np.uint64)
    owner = np.full(len(spaced), -1, np.int64)
    spaced[place] = seq
    owner[place] = doc
    ends = np.cumsum(size + 1) - 1
    spaced[ends] = mixed(np.arange(len(docs), dtype=np.uint64) + np.uint64(0xA5A5A5A5))
    order, lcp = suffix_array(spaced, 2)
    real = owner[order] >= 0
    interval = np.cumsum(lcp == 0)
    pairs = np.unique(np.stack((interval[real], owner[order][real])), axis=1)
    ivs, counts = np.unique(pairs[0], return_counts=True)
    first = np.searchsorted(interval, ivs)
    return spaced[order[first]], counts


def repeated_lines(encoded: DataFrame, min_docs: int = 10) -> DataFrame:
    """(h): identifiers of the lines that span at least min_docs documents of their source."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, lines = [], 0
        for batch in batches:
            size, items = _lists(batch.column(0))
            docs += np.split(items.view(np.uint64), np.cumsum(size)[:-1])
            lines += len(items)
            if lines >= CHUNK_LINES:
                yield _counted(docs)
                docs, lines = [], 0
        if docs:
            yield _counted(docs)

    found = encoded.select("lines").mapInArrow(partial, "h bigint, docs bigint")
    return found.groupBy("h").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)


def _counted(docs: list[np.ndarray]) -> pa.RecordBatch:
    h, c = _repeats(docs)
    return pa.record_batch([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "docs"])


def _three(df: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null and text <> ''")


def lines_to_delete(df: DataFrame, id_col: str, source_col: str, text_col: str, min_docs: int = 10) -> DataFrame:
    """(id, line_no, h) of every line of every document that is repeated over min_docs documents of its source."""
    return _hot_lines(encoded_lines(df, id_col, source_col, text_col), min_docs).select("id", "line_no", "h")


def _hot_lines(encoded: DataFrame, min_docs: int) -> DataFrame:
    """(id, source, line_no, h, place): the repeated lines; place: number among the lines of the document that count."""
    hot = checkpointed(repeated_lines(encoded, min_docs).select("h"))
    if hot.count() > MAX_SENT:
        each = encoded.select("id", "source", F.posexplode(F.arrays_zip("numbers", "lines")).alias("place", "x"))
        return each.select("id", "source", F.col("x.numbers").alias("line_no"), F.col("x.lines").alias("h"), "place").join(hot, "h", "left_semi").select("id", "source", "line_no", "h", "place")
    sent = encoded.sparkSession.sparkContext.broadcast(np.sort(np.array(hot.toPandas()["h"], np.int64)).tobytes())  # at most MAX_SENT, counted

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(sent.value, np.int64)
        for batch in batches:
            size, h = _lists(batch.column(3))
            at = np.searchsorted(known, h)
            at[at == len(known)] = 0
            ok = np.flatnonzero(known[at] == h) if len(known) else np.zeros(0, np.int64)
            if len(ok):
                doc = np.repeat(np.arange(len(size)), size)
                place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
                yield pa.record_batch([batch.column(0).take(pa.array(doc[ok])), batch.column(1).take(pa.array(doc[ok])), pa.array(_lists(batch.column(2))[1][ok]), pa.array(h[ok]), pa.array(place[ok].astype(np.int32))], names=["id", "source", "line_no", "h", "place"])

    return encoded.mapInArrow(mark, "id bigint, source bigint, line_no int, h bigint, place int")


def without_repeated_lines(df: DataFrame, id_col: str, source_col: str, text_col: str, min_docs: int = 10) -> DataFrame:
    """(id, text): each document without its repeated lines; documents without any stay as they are.

    Only documents that lose lines meet the list of these; the texts are joined to it by id.
    """
    gone = lines_to_delete(df, id_col, source_col, text_col, min_docs).groupBy("id").agg(F.collect_set("line_no").alias("gone"))
    kept = _three(df, id_col, source_col, text_col).join(gone, "id", "left")
    numbered = F.filter(F.split("text", "\n"), lambda line, i: F.col("gone").isNull() | ~F.array_contains("gone", i))
    return kept.select("id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.concat_ws("\n", numbered)).alias("text"))


def repeated_blocks(df: DataFrame, id_col: str, source_col: str, text_col: str, min_docs: int = 10) -> DataFrame:
    """(block, lines, docs): closed blocks of lines, each with the number of documents of its source that it spans.

    A block is a sequence of lines that follow each other among the lines that count; closed: with
    a line more before or after, it spans fewer documents. It is named by the digest of its
    identifiers. Whatever stands around a block, it is one block.
    """
    hot = _hot_lines(encoded_lines(df, id_col, source_col, text_col), min_docs)
    whole = hot.groupBy("id", "source").agg(F.sort_array(F.collect_list(F.struct("place", "h"))).alias("rows"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, rows = batch.column(0), batch.column(1)
            size = np.diff(rows.offsets.to_numpy())
            place, h = (np.split(rows.flatten().field(k).to_numpy(), np.cumsum(size)[:-1]) for k in (0, 1))
            # runs are kept apart by their sizes
            cut = [np.diff(np.flatnonzero(np.diff(x, prepend=-9, append=x[-1] + 9) != 1)).astype(np.int32).tobytes() for x in place]
            yield pa.record_batch([source, pa.array([x.tobytes() for x in h], pa.binary()), pa.array(cut, pa.binary())], names=["source", "h", "sizes"])

    alike = whole.select("source", "rows").mapInArrow(runs, "source bigint, h binary, sizes binary").groupBy("source", "h", "sizes").agg(F.count("*").alias("docs"))

    def read(t: pa.Table) -> pa.Table:
        docs = t.column("docs").to_numpy()
        h = [np.frombuffer(x, np.uint64) for x in t.column("h").to_pylist()]
        sizes = [np.frombuffer(x, np.int32) for x in t.column("sizes").to_pylist()]
        block, lines, n = closed_blocks(h, sizes, docs, min_docs)
        return pa.table([pa.array(block.view(np.int64)), pa.array(lines.astype(np.int32)), pa.array(n.astype(np.int64))], names=["block", "lines", "docs"])

    return alike.groupBy("source").applyInArrow(read, "block bigint, lines int, docs bigint")


def _intervals(seq: np.ndarray, owner: np.ndarray, weight: np.ndarray, most: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, length, documents) of the LCP intervals that span at least least documents and more than any longer interval inside.

    Documents are the summed weights of the distinct owners of an interval: every suffix adds its
    owner's, and the innermost interval that holds a suffix and the owner's suffix before takes
    one off again.
    """
    order, lcp = suffix_array(seq, most)
    starts, own = order.tolist(), owner[order].tolist()
    heights, weights = [*lcp.tolist(), 0], weight.tolist()
    last: dict[int, int] = {}
    depth, left, value, inner = [0], [0], [0], [0]  # the open intervals; inner: most documents of an interval inside
    out = []
    for i in range(1, len(starts) + 1):
        # the suffix before goes to the innermost open interval; intervals deeper than the common prefix end
        prior, g, height = i - 1, own[i - 1], heights[i]
        if g in last:
            value[bisect_right(left, last[g]) - 1] -= weights[g]
        last[g] = prior
        carry, begin, ended = weights[g], prior, 0
        while depth[-1] > height:
            d, begin, carry, most_inside = depth.pop(), left.pop(), value.pop() + carry, max(inner.pop(), ended)
            if carry >= least and carry > most_inside:
                out.append((starts[begin], d, carry))
            ended = carry
        if depth[-1] == height:
            value[-1] += carry
            inner[-1] = max(inner[-1], ended)
        else:
            depth.append(height)
            left.append(begin)
            value.append(carry)
            inner.append(ended)
    got = np.array(out, np.int64).reshape(-1, 3)
    return got[:, 0], got[:, 1], got[:, 2]


def closed_blocks(h: list[np.ndarray], sizes: list[np.ndarray], docs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest, lines, documents) of the closed blocks of one source; h: repeated lines of each kind of document, sizes: of its runs, docs: documents of the kind."""
    # every kind stands twice, the second time without weight: so what stands in one kind only is an interval too
    flat, cut = np.concatenate(h * 2), np.concatenate(sizes * 2).astype(np.int64)
    kinds = np.repeat(np.arange(2 * len(h)), [len(x) for x in h] * 2)
    weight = np.concatenate((docs, np.zeros(len(docs), np.int64))).astype(np.int64)
    names, ids = np.unique(flat, return_inverse=True)
    run = np.repeat(np.arange(len(cut)), cut)
    seq, owner = np.empty(len(flat) + len(cut), np.int64), np.zeros(len(flat) + len(cut), np.int64)
    at, ends = np.arange(len(flat)) + run, np.cumsum(cut + 1) - 1
    seq[at], owner[at] = ids, kinds
    seq[ends], owner[ends] = len(names) + np.arange(len(cut)), owner[ends - 1]  # a separator after every run
    most = int(cut.max())
    place, length, n = _intervals(seq, owner, weight, most, least)
    back, size, _ = _intervals(seq[::-1], owner[::-1], weight, most, least)
    # blocks that a line after doesn't keep, and a line before doesn't
    text = np.zeros(len(seq), np.uint64)
    text[at] = flat
    both = np.isin(_digests(text, place, length), _digests(text, len(seq) - back - size, size))
    place, length, n = place[both], length[both], n[both]
    return _digests(text, place, length), length, n


def _digests(text: np.ndarray, place: np.ndarray, length: np.ndarray) -> np.ndarray:
    out = np.zeros(len(place), np.uint64)
    order = np.argsort(-length, kind="stable")
    live = len(order)
    for k in range(int(length.max()) if len(length) else 0):  # a line of all blocks at a time
        live = int(np.searchsorted(-length[order], -k, side="left"))
        some = order[:live]
        with np.errstate(over="ignore"):
            out[some] += mixed(text[place[some] + k] + mixed(np.array([k + 1], np.uint64)))
    return out


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of batch items that at least 10 items of the same host share."""
    found = lines_to_delete(table(spark, sf_dir, "batch_item"), "item_id", "host", "markdown", 10)
    return found.select(F.col("id").alias("item_id"), "line_no")


def p6_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated blocks of lines, whatever stands around them, with their size and the number of items of a host that they span."""
    return repeated_blocks(table(spark, sf_dir, "batch_item"), "item_id", "host", "markdown", 10)


def p6_block_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many repeated blocks there are of each number of lines and items."""
    return p6_blocks(spark, sf_dir).groupBy("lines", "docs").agg(F.count("*").alias("blocks"))


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and digest of every item's markdown without the repeated lines."""
    kept = without_repeated_lines(table(spark, sf_dir, "batch_item"), "item_id", "host", "markdown", 10)
    return kept.select(F.col("id").alias("item_id"), F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


#: Lines that count with their keys, and the keys that at least 10 items of a host share.
_LINES = r"""WITH a AS (SELECT item_id, host, string_split(markdown, chr(10)) AS l FROM batch_item WHERE markdown IS NOT NULL),
        l AS (SELECT item_id, host, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM a),
        f AS (SELECT *, regexp_matches(line, '^[ \t]{0,3}(```|~~~)') AS fence, sum(CASE WHEN regexp_matches(line, '^[ \t]{0,3}(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY line_no) AS n FROM l),
        k AS (SELECT item_id, host, line_no, trim(regexp_replace(lower(line), '[^\p{L}]+', ' ', 'g')) AS key FROM f WHERE NOT fence AND n % 2 = 0 AND NOT starts_with(line, '|')),
        hot AS (SELECT host, key FROM k WHERE key <> '' GROUP BY host, key HAVING count(DISTINCT item_id) >= 10)"""

SQL = {
    "p6_found": _LINES
    + """
        SELECT item_id, CAST(line_no AS INTEGER) AS line_no FROM k JOIN hot USING (host, key)""",
    "p6_clean": _LINES
    + """,
        gone AS (SELECT item_id, line_no FROM k JOIN hot USING (host, key)),
        kept AS (SELECT item_id, string_agg(line, chr(10) ORDER BY line_no) AS t FROM l ANTI JOIN gone USING (item_id, line_no) GROUP BY item_id)
        SELECT item_id, length(coalesce(t, '')) AS n_chars, md5(coalesce(t, '')) AS text_md5 FROM batch_item LEFT JOIN kept USING (item_id) WHERE markdown <> ''""",
    "p6_block_sizes": _LINES
    + """,
        c AS (SELECT item_id, host, key, row_number() OVER (PARTITION BY item_id ORDER BY line_no) AS place FROM k WHERE key <> ''),
        h AS (SELECT c.*, place - row_number() OVER (PARTITION BY item_id ORDER BY place) AS run FROM c JOIN hot USING (host, key)),
        r AS (SELECT item_id, host, list(key ORDER BY place) AS keys FROM h GROUP BY item_id, host, run),
        s AS (SELECT item_id, host, keys, unnest(range(1, len(keys) + 1)) AS a FROM r),
        e AS (SELECT item_id, host, keys, a, unnest(range(a, len(keys) + 1)) AS b FROM s),
        d AS (SELECT host, keys[a:b] AS block, count(DISTINCT item_id) AS docs FROM e GROUP BY ALL HAVING count(DISTINCT item_id) >= 10),
        x AS (SELECT host, block[2:] AS block, docs FROM d WHERE len(block) > 1 UNION ALL SELECT host, block[:-2], docs FROM d WHERE len(block) > 1),
        m AS (SELECT host, block, max(docs) AS longer FROM x GROUP BY ALL)
        SELECT CAST(len(block) AS INTEGER) AS lines, docs, count(*) AS blocks FROM d LEFT JOIN m USING (host, block) WHERE longer IS NULL OR longer < docs GROUP BY ALL""",
}
QUERIES = {"p6_found": p6_found, "p6_blocks": p6_blocks, "p6_block_sizes": p6_block_sizes, "p6_clean": p6_clean}
