"""Evaluation texts that leak into training text.

1. Every run of five words of the test prompts is a possible seed. One scan of the corpus
   counts in how many documents each seed occurs.
2. Of every window of ``min_run`` words of a prompt the rarest seed that occurs at all is kept.
   A passage of that length that a document shares with a prompt holds every seed of some
   window, so also the kept one: nothing is lost by leaving out the common ones. An edited
   passage keeps the kept seed of a window wherever that seed was spared.
3. A second scan finds the kept seeds, and where a document and a prompt meet in one, their
   words are aligned by Smith-Waterman within the scan. The score decides: a verbatim run of n
   words scores at least n matches, so lower scores are out; an exact check of the run follows.
4. For edited copies (``alignments``) nothing is chosen: documents and prompts that meet in
   any seed are aligned, and the score tells copies from stock phrases.

The prompts are sent to the tasks in blocks of ``ITEM_BLOCK``, each block with scans of its own,
so their number is free and what is sent is bounded. The corpus is never shuffled.

Defined results: null and empty texts and prompts match nothing; prompts shorter than five
words match nothing; items with equal passages are each reported; repeated documents are
each reported; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .text import WordHasher, ngrams, words

#: Words of a seed.
SEED = 5
#: Test items that are sent to the tasks at a time.
ITEM_BLOCK = 20_000
#: Share of the best possible score from which an alignment is a copy, edited or not.
COPY = 0.5
#: Smith-Waterman over words: match, mismatch, gap.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words of the document around a seed that are aligned beyond the prompt's own length.
MARGIN = 16
#: Cells of a row of alignments that are worked out side by side.
CELLS = 30_000


def smith_waterman(doc: np.ndarray, prompt: np.ndarray) -> tuple[int, int, int]:
    """(best local score, first and last document word of that alignment), over word hashes.

    Rows run over the prompt; within a row gaps along the document are a running maximum, so
    each row is a few vector operations.
    """
    n = len(doc)
    if not n or not len(prompt):
        return 0, 0, 0
    score = np.zeros(n + 1, np.int64)
    start = np.arange(n + 1, dtype=np.int64)
    place = np.arange(n + 1, dtype=np.int64)
    best, b0, b1 = 0, 0, 0
    for w in prompt:
        diag = score[:-1] + np.where(doc == w, MATCH, MISMATCH)
        up = score[1:] + GAP
        here = np.maximum(np.maximum(diag, up), 0)
        origin = np.where(here == 0, place[1:], np.where(diag >= up, start[:-1], start[1:]))
        row = np.concatenate(([0], here))
        origin = np.concatenate(([0], origin))
        lifted = row - GAP * place
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, place, 0))
        across = top + GAP * place
        longer = across > row
        score = np.where(longer, across, row)
        start = np.where(longer, origin[source], origin)
        j = int(score.argmax())
        if score[j] > best:
            best, b0, b1 = int(score[j]), int(start[j]), j
    return best, b0, b1


def longest_run(doc: np.ndarray, prompt: np.ndarray) -> int:
    """Words of the longest run that both have in common."""
    most = 0
    run = np.zeros(len(doc) + 1, np.int64)
    for w in prompt:
        new = np.where(doc == w, run[:-1] + 1, 0)
        run = np.concatenate(([0], new))
        if len(new):
            most = max(most, int(new.max()))
    return most


def aligned_parts(docs: list[np.ndarray], prompts: list[np.ndarray]) -> np.ndarray:
    """(score, first, last, run) of each pair, as smith_waterman and longest_run give them, many pairs side by side."""
    out = np.zeros((len(docs), 4), np.int64)
    order = sorted(range(len(docs)), key=lambda k: (len(docs[k]), len(prompts[k])))
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and (b + 1 - a) * (len(docs[order[b]]) + 1) <= CELLS:
            b += 1
        some = sorted(order[a:b], key=lambda k: -len(prompts[k]))
        out[some] = _side_by_side([docs[k] for k in some], [prompts[k] for k in some])
        a = b
    return out


def _side_by_side(docs: list[np.ndarray], prompts: list[np.ndarray]) -> np.ndarray:
    # longest prompts first: a pair leaves when its prompt ends
    # words past the end of a document or prompt equal nothing, so no score grows there
    m, n, rows = len(docs), max(map(len, docs)), max(map(len, prompts))
    small = np.int16 if 2 * MATCH * rows + 3 * n < 1 << 15 else np.int32
    doc, prompt = np.full((m, n), -1, small), np.full((rows, m, 1), -2, small)
    for i, (d, p) in enumerate(zip(docs, prompts)):
        own, prompt[: len(p), i, 0] = np.unique(p, return_inverse=True)
        if len(own):
            at = np.minimum(np.searchsorted(own, d), len(own) - 1)
            doc[i, : len(d)] = np.where(own[at] == d, at, -1)
    place = np.arange(n + 1, dtype=small)
    slope = small(-GAP) * place
    score, start, run, row, origin, top = (np.zeros((m, n + 1), small) for _ in range(6))
    start[:] = place
    out = np.zeros((m, 4), np.int64)
    size = np.array([len(p) for p in prompts])
    for r, live in enumerate((size > np.arange(rows)[:, None]).sum(axis=1).tolist()):
        if live < len(doc):
            doc, score, start, run, row, origin, top = (x[:live] for x in (doc, score, start, run, row, origin, top))
        w = prompt[r, :live]
        same = doc == w
        diag = same * small(MATCH - MISMATCH)
        diag += score[:, :-1]
        diag += small(MISMATCH)
        up = score[:, 1:] + small(GAP)
        here = row[:, 1:]
        np.maximum(diag, up, out=here)
        np.maximum(here, small(0), out=here)
        # choices by arithmetic: a masked copy takes many times as long
        o = start[:, :-1] - start[:, 1:]
        o *= diag >= up
        o += start[:, 1:]
        o -= place[1:]
        o *= here > 0
        np.add(o, place[1:], out=origin[:, 1:])
        origin[:, 0] = 0
        # gaps along the document; few places are reached by one
        lifted = row + slope
        np.maximum.accumulate(lifted, axis=1, out=top)
        across = top - slope
        i, k = np.nonzero(across > row)
        if len(i):
            # the last place before k that has the lifted score of k
            source = np.maximum.accumulate((lifted == top) * place, axis=1)
            origin[i, k] = origin[i, source[i, k]]
        score, row, start, origin = across, score, origin, start
        row[:, 0] = 0
        j = score.argmax(axis=1)
        most = score[np.arange(live), j]
        k = np.flatnonzero(most > out[:live, 0])
        out[k, 0], out[k, 1], out[k, 2] = most[k], start[k, j[k]], j[k]
        ahead = run[:, :-1] + small(1)
        ahead *= same
        run[:, 1:] = ahead
        np.maximum(out[:live, 3], run.max(axis=1), out=out[:live, 3])
    return out


def _prompt_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """(ids, hashed words) of the prompts with a seed, ITEM_BLOCK at a time."""
    rows = items.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    hasher, names, prompts = WordHasher(), [], []
    for r in rows.orderBy("id").toLocalIterator():
        ws = hasher(words(r.text))
        if len(ws) >= SEED:
            names.append(r.id)
            prompts.append(ws)
        if len(names) == ITEM_BLOCK:
            yield names, prompts
            names, prompts = [], []
    if names:
        yield names, prompts


def _hashed_docs(batch: pa.RecordBatch, hasher: WordHasher) -> tuple[list[int], list[np.ndarray]]:
    ids, docs = [], []
    for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        if i is None or not text:
            continue
        ws = words(text)
        if len(ws) >= SEED:
            ids.append(i)
            docs.append(hasher(ws))
    return ids, docs


class _Seeds:
    """Which of the sorted seeds stand in which document of a batch."""

    def __init__(self, known: np.ndarray) -> None:
        self.known, self.hasher = known, WordHasher()
        # a bit per possible top 20 bits rules out nearly every place before the search
        self.gate = np.zeros(1 << 20, bool)
        self.gate[(known >> np.uint64(44)).astype(np.int64)] = True

    def __call__(self, batch: pa.RecordBatch) -> tuple[list[int], list[np.ndarray], np.ndarray]:
        """(ids, hashed words, distinct (document, seed) as two rows)."""
        known = self.known
        ids, hashed = _hashed_docs(batch, self.hasher)
        if not ids or not len(known):
            return ids, hashed, np.zeros((2, 0), np.int64)
        size = np.array([len(h) for h in hashed])
        grams = ngrams(np.concatenate(hashed), SEED)
        owner = np.repeat(np.arange(len(ids)), size)
        within = owner[: len(grams)] == owner[SEED - 1 :]
        at = np.flatnonzero(within & self.gate[(grams >> np.uint64(44)).astype(np.int64)])
        k = np.searchsorted(known, grams[at])
        k[k == len(known)] = 0
        ok = known[k] == grams[at]
        return ids, hashed, np.unique(np.stack((owner[at[ok]], k[ok])), axis=1)


def seed_counts(docs: DataFrame, seeds: np.ndarray) -> np.ndarray:
    """In how many documents (id, text) each of the sorted seeds occurs; one scan, partial counts."""
    sent = docs.sparkSession.sparkContext.broadcast(seeds.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, total = _Seeds(np.frombuffer(sent.value, np.uint64)), np.zeros(len(sent.value) // 8, np.int64)
        for batch in batches:
            total += np.bincount(find(batch)[2][1], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["seed", "n"])

    counts = np.zeros(len(seeds), np.int64)
    for r in docs.mapInArrow(run, "seed int, n bigint").groupBy("seed").agg(F.sum("n").alias("n")).toLocalIterator():  # one row per seed at most
        counts[r.seed] = r.n
    return counts


_ALIGNED = "id bigint, item bigint, score int, coverage double, run int, first_word int, last_word int"


class _Aligner:
    """Alignments of documents with the prompts that each is wanted for."""

    def __init__(self, names: list[int], prompts: list[np.ndarray]) -> None:
        self.names, self.prompts = names, prompts
        self.grams: dict[int, np.ndarray] = {}

    def __call__(self, wanted: Iterator[tuple[int, np.ndarray, list[int]]]) -> Iterator[pa.RecordBatch]:
        keys, parts, cells = [], [], 0
        for i, doc, ks in wanted:
            own = ngrams(doc, SEED)
            for k in ks:
                prompt = self.prompts[k]
                if k not in self.grams:
                    self.grams[k] = np.unique(ngrams(prompt, SEED))
                grams = self.grams[k]
                found = np.flatnonzero(grams[np.minimum(np.searchsorted(grams, own), len(grams) - 1)] == own)
                if not len(found):
                    continue
                reach = len(prompt) + MARGIN
                keys.append((i, k, []))
                for part in np.split(found, np.flatnonzero(np.diff(found) > 2 * reach) + 1):  # seeds near each other are one passage
                    a, b = max(0, int(part[0]) - reach), int(part[-1]) + SEED + reach
                    keys[-1][2].append(a)
                    parts.append((doc[a:b], prompt))
                    cells += len(parts[-1][0])
            if cells > 20 * CELLS:
                yield self._scored(keys, parts)
                keys, parts, cells = [], [], 0
        if keys:
            yield self._scored(keys, parts)

    def _scored(self, keys: list[tuple[int, int, list[int]]], parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        got, at, out = aligned_parts([d for d, _ in parts], [p for _, p in parts]).tolist(), 0, []
        for i, k, places in keys:
            best, run = (0, 0, 0), 0
            for a in places:
                score, s, e, r = got[at]
                if score > best[0]:
                    best = (score, a + s, a + e)
                run, at = max(run, r), at + 1
            out.append((i, self.names[k], best[0], best[0] / (MATCH * len(self.prompts[k])), run, best[1], best[2]))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32()))], names=["id", "item", "score", "coverage", "run", "first_word", "last_word"])


def _aligned(docs: DataFrame, names: list[int], prompts: list[np.ndarray], wanted: list[np.ndarray]) -> DataFrame:
    """Alignments of the documents (id, text) with the prompts that they meet in one of the prompt's wanted seeds; one scan, no shuffle."""
    seeds = np.unique(np.concatenate(wanted))
    sent = docs.sparkSession.sparkContext.broadcast((names, prompts, wanted, seeds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names_, prompts_, wanted_, known = sent.value
        find, align = _Seeds(known), _Aligner(names_, prompts_)
        own = [np.searchsorted(known, w) for w in wanted_]
        seed, item = np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own])
        item = item[np.argsort(seed, kind="stable")]  # the items of a seed stand together
        size = np.bincount(seed, minlength=len(known))
        first = np.cumsum(size) - size
        for batch in batches:
            ids, hashed, (doc, k) = find(batch)
            if not len(doc):
                continue
            n = size[k]
            at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[k], n)
            pairs = np.unique(np.stack((np.repeat(doc, n), item[at])), axis=1)
            start = np.flatnonzero(np.diff(pairs[0], prepend=-1))
            yield from align((ids[d], hashed[d], ks.tolist()) for d, ks in zip(pairs[0][start].tolist(), np.split(pairs[1], start[1:])))

    return docs.mapInArrow(run, _ALIGNED)


def _rarest(grams: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Of every window of a prompt's seeds the rarest that occurs, ties by the seed itself."""
    keep = set()
    for a in range(max(1, len(grams) - window + 1)):
        part, n = grams[a : a + window], counts[a : a + window]
        part, n = part[n > 0], n[n > 0]
        if len(part):
            keep.add(part[np.lexsort((part, n))[0]])
    return np.array(sorted(keep), np.uint64)


def _over_blocks(corpus: DataFrame, items: DataFrame, names: tuple[str, str, str, str], window: int | None) -> DataFrame:
    doc_id, doc_text, item_id, item_text = names
    docs = corpus.select(F.col(doc_id).cast("bigint").alias("id"), F.col(doc_text).cast("string").alias("text")).where("id is not null and text is not null and text <> ''")
    out = corpus.sparkSession.createDataFrame([], _ALIGNED)
    for ids, prompts in _prompt_blocks(items, item_id, item_text):
        grams = [ngrams(w, SEED) for w in prompts]
        wanted = [np.unique(g) for g in grams]
        if window is not None:
            seeds = np.unique(np.concatenate(grams))
            counts = seed_counts(docs, seeds)
            wanted = [_rarest(g, counts[np.searchsorted(seeds, g)], window) for g in grams]
        if any(map(len, wanted)):
            out = out.union(_aligned(docs, ids, prompts, wanted))
    return out


def alignments(corpus: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "prompt") -> DataFrame:
    """(id, item, score, coverage, run, first_word, last_word) as in leaks, of every document and item that share any seed."""
    return _over_blocks(corpus, items, (doc_id, doc_text, item_id, item_text), None)


def leaks(corpus: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "prompt", min_run: int = 12) -> DataFrame:
    """(id, item, score, coverage, run, first_word, last_word) of every document and item that share a kept seed.

    Lossless for verbatim runs of min_run words: these have score >= MATCH * min_run and
    run >= min_run. score: best Smith-Waterman score; coverage: score over the prompt's best
    possible one; run: longest exact common run in words.
    """
    return _over_blocks(corpus, items, (doc_id, doc_text, item_id, item_text), max(1, min_run - SEED + 1))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least 12 consecutive words of a test prompt, and the items."""
    got = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"), min_run=12)
    return got.where((F.col("score") >= 12 * MATCH) & (F.col("run") >= 12)).select(F.col("id").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def p8_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of every document and item that share any run of five words; copy: by its score it is a copy, edited or not."""
    got = alignments(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))
    return got.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "score", F.round("coverage", 4).alias("coverage"), (F.col("coverage") >= COPY).alias("copy"), "run", "first_word", "last_word")


SQL = {
    "p8_found": r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents), e AS (SELECT item_id, regexp_extract_all(lower(prompt), '[\p{L}\p{N}]+') AS w FROM eval_item),
        dg AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d WHERE len(w) >= 12)), eg AS (SELECT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e WHERE len(w) >= 12))
        SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)""",
}
QUERIES = {"p8_found": p8_found, "p8_alignments": p8_alignments}
