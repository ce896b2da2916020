"""Reading level of documents by a familiar-word formula.

The formula weighs the share of words outside a list of familiar words and the average
sentence length. The list is derived from the corpus: words in at least ``FAMILIAR`` of the
documents of a language. The weights are fitted to labelled documents, with offsets per
language, by ridge logistic regression, one model per level boundary.

Counts cover all documents. The familiar list is bounded by construction: a document has a
bounded share in at most 1 / FAMILIAR words per word of its own, so a language has at most
(average distinct words of a document) / FAMILIAR of them.

Defined results: null and empty texts and texts without words have no level; repeated
documents each get theirs; without labels the level is that of the unfitted formula
(``DEFAULT`` weights); levels follow document order of nothing but the text itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed, table
from .language import LANGUAGES, OTHER, language_of

_LETTERS = re.compile(r"[^\W\d_]+")
_STOP = re.compile(r"[.!?…。]+[\"”’»)\]]*(?=\s|$)")
#: Share of a language's documents that hold a familiar word.
FAMILIAR = 0.05
#: Most labelled documents used for the fit (those with the least hash of their id).
MAX_LABELS = 200_000
#: Distinct words counted in a task before the partial counts are sent on.
FLUSH = 400_000


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null and text <> ''")


def familiar_words(df: DataFrame, text_col: str, share: float = FAMILIAR) -> DataFrame:
    """(lang, word): words in at least that share of the documents of their language."""
    docs = df.select(F.col(text_col).cast("string").alias("text")).where("text is not null and text <> ''")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[Counter] = [Counter() for _ in range(OTHER + 1)]
        size = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                ws = _LETTERS.findall(text.lower())
                k = language_of(ws)
                own = set(ws)
                own.add("")  # stands for the document itself
                seen[k].update(own)
            size = sum(map(len, seen))
            if size > FLUSH:
                yield _rows(seen)
                seen = [Counter() for _ in range(OTHER + 1)]
        yield _rows(seen)

    counts = docs.mapInArrow(count, "lang int, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    total = counts.where("word = ''").select("lang", F.col("n").alias("docs"))
    return counts.where("word <> ''").join(F.broadcast(total), "lang").where(F.col("n") >= share * F.col("docs")).select("lang", "word")


def _rows(seen: list[Counter]) -> pa.RecordBatch:
    lang = np.repeat(np.arange(len(seen)), [len(c) for c in seen]).astype(np.int32)
    return pa.record_batch([pa.array(lang), pa.array([w for c in seen for w in c], pa.string()), pa.array([n for c in seen for n in c.values()], pa.int64())], names=["lang", "word", "n"])


def measures(text: str, familiar: list[frozenset]) -> tuple[int, float, float] | None:
    """(language, share of unfamiliar words, words per sentence), None without words."""
    ws = _LETTERS.findall(text.lower())
    if not ws:
        return None
    k = language_of(ws)
    known = familiar[k]
    return k, 1 - sum(map(known.__contains__, ws)) / len(ws), len(ws) / max(1, len(_STOP.findall(text)))


def design(m: np.ndarray) -> np.ndarray:
    """Columns of the model for rows of (language, unfamiliar share, sentence length)."""
    one = np.eye(OTHER + 1)[m[:, 0].astype(int)]
    u, s = m[:, 1], np.log(np.maximum(m[:, 2], 1)) - 3
    return np.column_stack([np.ones(len(m)), s, u, s * u, s * s, one, one * s[:, None], one * u[:, None]])


def fit_boundaries(m: np.ndarray, level: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Weights of P(level >= k) for k = 2..5."""
    x = design(m)
    out = []
    for k in range(2, 6):
        y, w = (level >= k).astype(float), np.zeros(x.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (y - p) - ridge * w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        out.append(w)
    return np.array(out)


def _default() -> np.ndarray:
    """Unfitted boundaries at 8, 13, 22 and 29 words a sentence, each 10 % of unfamiliar words counting as one word more."""
    out = np.zeros((4, design(np.array([[0, 0.0, 10.0]])).shape[1]))
    for row, words in zip(out, (8, 13, 22, 29)):
        row[0], row[1], row[2] = -10 * (np.log(words) - 3), 10, 5
    return out


DEFAULT = _default()


def _measured(docs: DataFrame, familiar: list[frozenset]) -> DataFrame:
    """(id, lang, unfamiliar, sentence) of every document with words."""
    sent = docs.sparkSession.sparkContext.broadcast(familiar)  # bounded by the share, see above

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *got) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (got := measures(t, sent.value))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.float64(), pa.float64()))], names=["id", "lang", "unfamiliar", "sentence"])

    return docs.select("id", "text").mapInArrow(run, "id bigint, lang int, unfamiliar double, sentence double")


def reading_levels(df: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang, unfamiliar, sentence, score, level) of every document with words.

    labels: (id_col, level); at most MAX_LABELS of them are used for the fit. level is the
    number of boundaries passed, plus one; score is the log odds of level 4 or more. Texts are
    read twice, for the list and for the measures; fit and grading read the measures alone.
    """
    docs = _texts(df, id_col, text_col)
    known: list[set] = [set() for _ in range(OTHER + 1)]
    for r in familiar_words(df, text_col).toLocalIterator():
        known[r.lang].add(r.word)
    measured = checkpointed(_measured(docs, [frozenset(x) for x in known]))
    weights = DEFAULT
    if labels is not None:
        wanted = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col("level").cast("int").alias("label")).where("id is not null and label between 1 and 5").dropDuplicates(["id"])
        sample = wanted.orderBy(F.xxhash64("id")).limit(MAX_LABELS)
        fitted = measured.join(sample, "id").toPandas()  # one row per label
        if len(fitted) >= 50 and fitted.label.nunique() == 5:
            weights = fit_boundaries(fitted[["lang", "unfamiliar", "sentence"]].to_numpy(float), fitted.label.to_numpy())

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            odds = design(np.column_stack([batch.column(k).to_numpy() for k in (1, 2, 3)]).astype(float)) @ weights.T
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(odds[:, 2]), pa.array((1 + (odds > 0).sum(axis=1)).astype(np.int32))], names=["id", "lang", "unfamiliar", "sentence", "score", "level"])

    return measured.mapInArrow(grade, "id bigint, lang int, unfamiliar double, sentence double, score double, level int")


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_label"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents at reading level 4 or 5."""
    return _levels(spark, sf_dir).where("score > 0").select(F.col("id").alias("doc_id")).distinct()


def p10_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, mean sentence length and unfamiliar share by language and level."""
    name = F.element_at(F.array(*(F.lit(x) for x in (*LANGUAGES, "other"))), F.col("lang") + 1)
    return _levels(spark, sf_dir).groupBy(name.alias("lang"), "level").agg(F.count("*").alias("docs"), F.round(F.avg("sentence"), 3).alias("words_per_sentence"), F.round(F.avg("unfamiliar"), 4).alias("unfamiliar_share"))


QUERIES = {"p10_found": p10_found, "p10_profile": p10_profile}
