"""Text that was decoded with the wrong character encoding: detection and repair.

A smoothed character trigram model is trained on the clean runs of non-ASCII characters of all
records (with their neighbours). Every run of every record is then scored as it stands and
after each candidate chain of encodings (encode as it was wrongly decoded, decode as it was
meant, twice where text was garbled twice); the likeliest reading wins if it beats the
standing text by a margin. Single-byte mix-ups leave no trace in the bytes; they are judged by
the runs of a line together. The margins are validated: clean runs are garbled through every
chain, and the margins are set where true repairs and false ones are told apart best.

The model is a set of hashed counts of fixed size, whatever the corpus holds. Counts and margins
cover all records: each run in its context is counted over the whole corpus, once learned from
and, if clean and met ``SEEN`` times, once garbled; margins come from summed tallies.

Defined results: null and empty texts show nothing; U+FFFD and C1 control characters always
count as garbled and stay where no chain recovers them; correct text of any language and
unknown characters stay as they are; long texts are read whole; repeated rows are each judged.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed, table
from . import dense

_RUN = re.compile(r"[^\x00-\x7f]+")
_LOST = re.compile("[�\x80-\x84\x86-\x9f]")
#: Encodings that UTF-8 bytes are read as by mistake.
WRONG = ("cp1252", "latin-1", "mac_roman", "cp850", "cp437", "cp1251", "koi8-r", "cp866", "cp1250", "iso8859-15")
#: Encodings of several bytes a character that UTF-8 is read as; a character may have swallowed the ASCII letter after it.
WIDE = ("gbk", "big5", "shift_jis", "euc_kr")
#: Single-byte mix-ups: (read as, meant). Runs shorter than SHORTEST are left to the UTF-8 chains.
SINGLE = (("cp1252", "cp1251"), ("cp1252", "koi8-r"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("mac_roman", "cp1251"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp850", "cp1252"), ("cp1252", "cp850"))
SHORTEST = 3
#: Times that a run must stand in the corpus to validate with (garbled runs are rare), and the margin where there is too little to validate with.
SEEN, MARGIN = 3, 6.0
#: Cells of each hashed count, and the counts (characters, pairs, triples, whole runs).
CELLS, BLOCKS = 1 << 17, 4
#: Margins that are tried, and the distinct runs that a task gathers before it passes them on.
_GRID, _GATHERED = np.linspace(2, 12, 41), 200_000
_BACKOFF = 2.0


def _tables(name: str) -> tuple[dict[int, int], dict[int, int]]:
    """(character to byte code, byte code to character); undefined bytes stand for themselves, as decoders in browsers have it."""
    back = {}
    for b in range(128, 256):
        try:
            c = ord(bytes([b]).decode(name))
        except UnicodeDecodeError:
            c = b
        back[b] = c
    there = {c: 0x100 for c in range(128, 256)}
    there |= {c: b for b, c in back.items()}
    return there, back


_ENC = {name: _tables(name) for name in {*WRONG, *(x for p in SINGLE for x in p)}}


def _bytes(run: str, name: str) -> bytes | None:
    try:
        if name in WIDE:
            return run.encode(name)
        return run.translate(_ENC[name][0]).encode("latin-1")
    except UnicodeEncodeError:
        return None


def _chars(raw: bytes, name: str) -> str | None:
    """The bytes as the encoding reads them; None where one of several bytes a character can't."""
    if name not in WIDE:
        return raw.decode("latin-1").translate(_ENC[name][1])
    try:
        return raw.decode(name)
    except UnicodeDecodeError:
        return None


def _utf8(run: str, name: str) -> str | None:
    raw = _bytes(run, name)
    if raw is None:
        return None
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return None


def readings(run: str) -> list[tuple[str, str]]:
    """(chain, text) of every chain that can have garbled the run."""
    out, seen = [], set()
    for name in (*WRONG, *WIDE):
        got = _utf8(run, name)
        if got is None or got == run or got in seen:
            continue
        seen.add(got)
        out.append((f"utf-8<{name}", got))
        if not got.isascii():
            for again in WRONG:
                twice = "".join(_utf8(m, again) or m if not m.isascii() else m for m in re.split(r"([^\x00-\x7f]+)", got))
                if twice != got and twice not in seen:
                    seen.add(twice)
                    out.append((f"utf-8<{again}<utf-8<{name}", twice))
    return out


def single_readings(run: str) -> list[str | None]:
    """The run's text after each single-byte chain, None where the chain can't have made it."""
    out: list[str | None] = []
    for name, meant in SINGLE:
        raw = _bytes(run, name)
        out.append(None if raw is None else raw.decode("latin-1").translate(_ENC[meant][1]))
    return out


def garbled(run: str, chain: str) -> str | None:
    """The run as the chain would have garbled it."""
    for step in re.findall(r"(utf-8|[\w-]+)<([\w-]+)", chain if chain.count("<") == 1 else chain.rsplit("<", 2)[0]):
        meant, name = step
        try:
            raw = run.encode("utf-8") if meant == "utf-8" else _bytes(run, meant)
        except UnicodeEncodeError:
            return None
        if raw is None:
            return None
        run = _chars(raw, name)
        if run is None:
            return None
    return run


class Model:
    """Trigram model over hashed counts with back-off to pairs and single characters."""

    def __init__(self, counts: np.ndarray):
        self.one, self.two, self.three, self.runs = (counts[k * CELLS : (k + 1) * CELLS] for k in range(BLOCKS))
        self.total = max(1, int(self.one.sum()))

    def score(self, text: str, skip: int) -> float:
        """Log probability of text[skip:] after text[:skip]."""
        c = [_cell1(x) for x in text]
        out = 0.0
        for i in range(skip, len(text)):
            p = (self.one[c[i]] + 0.02) / (self.total + 0.02 * CELLS)
            if i >= 1:
                p = (self.two[_cell2(text[i - 1 : i + 1])] + _BACKOFF * p) / (self.one[c[i - 1]] + _BACKOFF)
            if i >= 2:
                p = (self.three[_cell2(text[i - 2 : i + 1])] + _BACKOFF * p) / (self.two[_cell2(text[i - 2 : i])] + _BACKOFF)
            out += float(np.log(min(p, 1.0)))
        return out


    def known(self, run: str) -> float:
        """Log of how often the whole run was seen, half a time if never."""
        return float(np.log(self.runs[_cell2("\x1e" + run)] + 0.5))


def _cell1(c: str) -> int:
    o = ord(c)
    return o if o < CELLS else o % CELLS


def _cell2(s: str) -> int:
    return xxhash.xxh32_intdigest(s.encode("utf-8", "surrogatepass")) % CELLS


def _window(text: str, m: re.Match) -> tuple[str, str, str]:
    """The run with the two characters before it and one after it; digits and capitals are told by kind."""
    s, e = m.span()
    return _context(text[max(0, s - 2) : s]), m.group(), _context(text[e : e + 1])


def _context(s: str) -> str:
    return "".join("0" if "0" <= c <= "9" else "A" if "A" <= c <= "Z" else " " if c in " \n\t\r\x1e\x1f" else c for c in s)


def _is_clean(run: str) -> bool:
    """Whether no usual chain makes readable text of the run; Latin, Greek, Cyrillic and common signs are readable."""
    if _LOST.search(run):
        return False
    return not any((x := _utf8(run, name)) and all(c < "\u0530" or "\u2000" <= c <= "\u2122" for c in x) for name in (*WRONG[:6], *WIDE))


def _windows(texts: DataFrame) -> DataFrame:
    """(key, n): every run of the text column in its context, and how often it stands."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        flat = lambda: pa.record_batch([pa.array(map("\x1f".join, seen), pa.string()), pa.array(seen.values(), pa.int64())], names=["key", "n"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                text = _plain(text)
                seen.update(_window(text, m) for m in _RUN.finditer(text))
            if len(seen) > _GATHERED:
                yield flat()
                seen = Counter()
        yield flat()

    return texts.mapInArrow(gather, "key string, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def train(texts: DataFrame) -> tuple[np.ndarray, tuple[float, float]]:
    """Counts of all clean runs of the text column, and the margins that all clean runs validate."""
    spark = texts.sparkSession
    windows = checkpointed(_windows(texts))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BLOCKS * CELLS, np.int64)
        for batch in batches:
            keys, times = (c.to_pylist() for c in batch.columns)
            _absorb(counts, {}, dict(zip((tuple(k.split("\x1f")) for k in keys), times)))
        yield dense.packed(counts, {}, 0)

    counts = dense.summed(windows.mapInArrow(count, dense.SCHEMA), BLOCKS * CELLS, 0)[0].astype(np.float32)
    known = spark.sparkContext.broadcast(counts)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total = Model(known.value), np.zeros(2 * _TALLY, np.int64)
        for batch in batches:
            total += _tally(model, [k for k in batch.column(0).to_pylist() if _is_clean(k.split("\x1f")[1])])
        yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["place", "n"])

    tasks = max(spark.sparkContext.defaultParallelism, windows.rdd.getNumPartitions())
    tallies = windows.where(F.col("n") >= SEEN).select("key").repartition(tasks).mapInArrow(tally, "place int, n bigint")
    rows = tallies.groupBy("place").agg(F.sum("n").alias("n")).orderBy("place").collect()  # 2 * _TALLY rows
    return counts, _margins(np.array([r.n for r in rows], np.int64))


def _absorb(counts: np.ndarray, sample: dict[int, str], seen: dict[tuple[str, str, str], int]) -> dict[int, str]:
    """Adds the clean runs to the counts; the runs to validate with join the sample."""
    clean: dict[str, bool] = {}
    for (left, run, right), n in seen.items():
        if run not in clean:
            clean[run] = _is_clean(run)
        if not clean[run]:
            continue
        text = left + run + right
        counts[3 * CELLS + _cell2("\x1e" + run)] += n
        for i in range(len(text)):
            counts[_cell1(text[i])] += n
            if i >= 1:
                counts[CELLS + _cell2(text[i - 1 : i + 1])] += n
            if i >= 2:
                counts[2 * CELLS + _cell2(text[i - 2 : i + 1])] += n
        if n < SEEN:
            continue
        key = "\x1f".join((left, run, right))
        sample[xxhash.xxh3_64_intdigest(key)] = key
    return sample


#: Figures of a tally: repairs, those that fall short of each margin, changes of clean runs, those beyond each margin.
_TALLY = 2 * (1 + len(_GRID))


def _best(tally: np.ndarray) -> float:
    """The margin with the fewest errors, false changes weighing 20 times; MARGIN without evidence."""
    (true, *short), (false, *beyond) = tally.reshape(2, -1).tolist()
    if true < 20 or false < 20:
        return MARGIN
    wrong = np.array(short) / true + 20 * np.array(beyond) / false
    return float(_GRID[wrong <= wrong.min() + 1e-9].mean())  # the middle of what serves equally well


def _margins(tallies: np.ndarray) -> tuple[float, float]:
    return _best(tallies[:_TALLY]), _best(tallies[_TALLY:])


def validated_margins(model: Model, keys: list[str]) -> tuple[float, float]:
    """Margins for the UTF-8 chains and for the single-byte chains, each set where repairs of garbled clean runs and changes to clean runs are told apart best."""
    return _margins(_tally(model, keys))


def _tally(model: Model, keys: list[str]) -> np.ndarray:
    """How the clean runs do at each margin: two tallies, of the UTF-8 chains and of the single-byte chains, which add up over parts of the runs."""
    true: tuple[list, list] = ([], [])
    false: tuple[list, list] = ([], [])
    for key in keys:
        left, run, right = key.split("\x1f")
        own = model.score(left + run + right, len(left))
        of = lambda x: model.score(left + x + right, len(left)) - own
        false[0].append(max([of(x) for _, x in readings(run) if model.known(x) < model.known(run) + 2], default=-50.0))
        for name in WRONG[:6]:
            bad = garbled(run, f"utf-8<{name}")
            if bad and bad != run:
                true[0].append(-of(bad))
        if len(run) >= SHORTEST and run.isalpha():
            others = [x for x in single_readings(run) if x and x != run]
            if all(model.known(x) < model.known(run) + 2 for x in others):  # else the run itself is garbled
                false[1].append(max([gain(model, left, run, right, x) for x in others], default=-50.0))
                for name, meant in SINGLE:
                    bad = garbled(run, f"{meant}<{name}")
                    if bad and bad != run and bad.isalpha():
                        true[1].append(gain(model, left, bad, right, run))
    out = []
    for t, f in zip(true, false):
        out += [[len(t)], np.searchsorted(np.sort(t), _GRID), [len(f)], len(f) - np.searchsorted(np.sort(f), _GRID, side="right")]
    return np.concatenate(out).astype(np.int64)


def gain(model: Model, left: str, run: str, right: str, other: str) -> float:
    """How much likelier the other text is than the run: by the trigram model, bounded for one run, and by whole runs."""
    by_model = model.score(left + other + right, len(left)) - model.score(left + run + right, len(left))
    return max(-10.0, min(10.0, by_model)) + model.known(other) - model.known(run)


class Repairer:
    """Judges runs and lines; what it decided for a run in its context is kept."""

    def __init__(self, counts: np.ndarray, margins: tuple[float, float]):
        self.model, (self.margin, self.line_margin) = Model(counts), margins
        self.options: dict[str, list[tuple[str, str]]] = {}
        self.verdicts: dict[tuple[str, str, str], tuple[str, str] | None] = {}
        self.deltas: dict[tuple[str, str, str], list[float]] = {}

    def verdict(self, key: tuple[str, str, str]) -> tuple[str, str] | None:
        """(chain, text) of the UTF-8 chain that explains the run, None if it stands as it should."""
        if key in self.verdicts:
            return self.verdicts[key]
        left, run, right = key
        options = self.options.get(run)
        if options is None:
            if len(self.options) > 200_000:
                self.options.clear()
            options = self.options[run] = readings(run)
        got = None
        if options:
            own = self.model.score(left + run + right, len(left))
            best = max(((self.model.score(left + x + right, len(left)) - own, chain, x) for chain, x in options), key=lambda v: v[0])
            if best[0] > self.margin:
                got = best[1:]
        if len(self.verdicts) > 400_000:
            self.verdicts.clear()
        self.verdicts[key] = got
        return got

    def _gains(self, key: tuple[str, str, str]) -> list[float]:
        """Gain of the run by each single-byte chain; a chain that can't have made it loses."""
        got = self.deltas.get(key)
        if got is None:
            left, run, right = key
            got = [-20.0 if x is None or not x.isalpha() else 0.0 if x == run else gain(self.model, left, run, right, x) for x in single_readings(run)]
            if len(self.deltas) > 400_000:
                self.deltas.clear()
            self.deltas[key] = got
        return got

    def line_chain(self, keys: list[tuple[str, str, str]]) -> tuple[str, str] | None:
        """(read as, meant) of the single-byte chain that explains the words of a line together; signs don't count."""
        words = [k for k in keys if k[1].isalpha()]
        if sum(len(k[1]) for k in words) < SHORTEST or not any(max(self._gains(k)) > 0 for k in words):
            return None
        total = [sum(x) for x in zip(*map(self._gains, words))]
        best = max(range(len(SINGLE)), key=total.__getitem__)
        return SINGLE[best] if total[best] > self.line_margin else None

    def is_garbled(self, text: str) -> bool:
        if text.isascii():
            return False
        if _LOST.search(text):
            return True
        for line in text.split("\n"):
            keys = [] if line.isascii() else [_window(line, m) for m in _RUN.finditer(line)]
            if any(map(self.verdict, keys)) or self.line_chain(keys):
                return True
        return False

    def repaired(self, text: str) -> tuple[str, list[str]]:
        """The text with every explained run replaced, also where it is written as entities, and the chains used; single-byte chains go for their whole line."""
        plain, places = _mapped(text)
        if plain.isascii():
            return text, []
        used: set[str] = set()
        at, base, out = 0, 0, []
        for line in plain.split("\n"):
            found = [] if line.isascii() else list(_RUN.finditer(line))
            keys = [_window(line, m) for m in found]
            marks = [self.verdict(k) for k in keys]
            chain = None if any(marks) else self.line_chain(keys)
            for m, got in zip(found, marks):
                if chain is not None:
                    raw = _bytes(m.group(), chain[0])
                    got = None if raw is None else (f"{chain[1]}<{chain[0]}", raw.decode("latin-1").translate(_ENC[chain[1]][1]))
                if got:
                    start, end = base + m.start(), base + m.end()
                    if places is not None:
                        start, end = places[start], places[end]
                    if start < 0 or end < 0:
                        continue
                    out += [text[at:start], got[1]]
                    at = end
                    used.add(got[0])
            base += len(line) + 1
        return "".join(out) + text[at:], sorted(used)


#: What html.unescape looks at.
_ENTITY = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")


def _mapped(text: str) -> tuple[str, list[int] | None]:
    """The text with entities decoded, and where each of its characters (and its end) starts in the raw text; -1 inside an entity of several characters."""
    if "&" not in text:
        return text, None
    out, places, at = [], [], 0
    for m in _ENTITY.finditer(text):
        raw, new = m.group(), html.unescape(m.group())
        if raw == new:
            continue
        same = 0  # letters after an entity without semicolon stay themselves
        while same < len(new) - 1 and raw[-1 - same] == new[-1 - same]:
            same += 1
        end = m.end() - same
        new = new[: len(new) - same]
        out += [text[at : m.start()], new]
        places += [*range(at, m.start()), m.start(), *[-1] * (len(new) - 1)][: m.start() - at + len(new)]
        at = end
    out.append(text[at:])
    places += range(at, len(text) + 1)
    return "".join(out), places


def _plain(text: str) -> str:
    return html.unescape(text) if "&" in text else text


def _trained(spark: SparkSession, texts: DataFrame):
    return spark.sparkContext.broadcast(train(texts.select("text")))


def _tagged(df: DataFrame, id_col: str, text_col: str, tab: str) -> DataFrame:
    return df.select(F.lit(tab).alias("tab"), F.col(id_col).cast("bigint").alias("rec_id"), F.col(text_col).cast("string").alias("text")).where("rec_id is not null and text is not null and text <> ''")


def garbled_records(records: DataFrame) -> DataFrame:
    """(tab, rec_id) of the records (tab, rec_id, text) with at least one garbled passage."""
    known = _trained(records.sparkSession, records)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = Repairer(*known.value)
        for batch in batches:
            keep = [repairer.is_garbled(_plain(t)) for t in batch.column(2).to_pylist()]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return records.mapInArrow(find, "tab string, rec_id bigint")


def repaired_records(records: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(tab, rec_id, text, chains, left): the garbled records restored as far as a chain recovers them; left counts characters that are lost; texts: what to learn from if not the records."""
    known = _trained(records.sparkSession, records if texts is None else texts)

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = Repairer(*known.value)
        for batch in batches:
            rows = []
            for tab, i, text in zip(*(c.to_pylist() for c in batch.columns)):
                if repairer.is_garbled(_plain(text)):
                    new, chains = repairer.repaired(text)
                    rows.append((tab, i, new, ",".join(chains), len(_LOST.findall(_plain(new)))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32()))], names=["tab", "rec_id", "text", "chains", "left"])

    return records.mapInArrow(mend, "tab string, rec_id bigint, text string, chains string, left int")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(table(spark, sf_dir, "raw_page"), "page_id", "html", "raw_page").unionByName(_tagged(table(spark, sf_dir, "batch_item"), "item_id", "markdown", "batch_item"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and items with a passage that shows a wrong decoding."""
    return garbled_records(_records(spark, sf_dir)).distinct()


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The restored texts of the garbled pages and items, and of garbled item titles (tab batch_item.title), with the chains that were undone."""
    texts = _records(spark, sf_dir)
    titles = _tagged(table(spark, sf_dir, "batch_item"), "item_id", "title", "batch_item.title")
    return repaired_records(texts.unionByName(titles), texts)


QUERIES = {"p2_found": p2_found, "p2_repaired": p2_repaired}
