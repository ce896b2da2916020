"""Operators against plain versions on small data."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from siltworks.llm import leakage, mainbody, mixing, mojibake, neardup, reading, residue, sitelines
from siltworks.llm.graph import components
from siltworks.llm.sitelines import suffix_array

WORD = re.compile(r"[^\W_]+")


def texts(n, seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    base = [[r.choice(words) for _ in range(r.randint(40, 120))] for _ in range(n // 3)]
    out = []
    for _ in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 4, 8, 16, 30])):
            w[r.randrange(len(w))] = r.choice(words)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("n,threshold", [(3, 0.7), (5, 0.8), (2, 0.5)])
def test_near_duplicates_against_all_pairs(spark, n, threshold):
    t = texts(90)
    sets = {}
    for i, x in enumerate(t):
        w = WORD.findall(x.lower())
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}
    df = spark.createDataFrame(list(enumerate(t)), "id bigint, text string")
    got = {tuple(r) for r in neardup.near_duplicate_pairs(df, "id", "text", n, threshold).collect()}
    assert got == want and len(want) > 10
    groups = {r.id: r.group_id for r in neardup.near_duplicate_groups(df, "id", "text", n, threshold).collect()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert groups == {i: find(i) for p in want for i in p}


def test_hot_grams_and_repeated_sets(spark):
    r = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    base = r.choices(words, k=60)
    t = []
    for _ in range(110):  # all share most of their n-grams: every n-gram is hot
        w = list(base)
        for _ in range(r.choice([1, 2, 3, 6])):
            w[r.randrange(len(w))] = r.choice(words)
        t.append(" ".join(w))
    t += [t[0]] * 30 + [" ".join(r.choices(words, k=60)) for _ in range(20)]
    sets = [{tuple(x.split()[k : k + 3]) for k in range(58)} for x in t]
    want = {(a, b) for a in range(len(t)) for b in range(a + 1, len(t)) if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b]) - 1e-9}
    df = spark.createDataFrame(list(enumerate(t)), "id bigint, text string").repartition(6)
    assert {tuple(x) for x in neardup.near_duplicate_pairs(df, "id", "text", 3, 0.7).collect()} == want and len(want) > 2000


def test_repeated_texts_with_few_distinct_grams(spark):
    t = ["go here now " * 30, "go here now " * 31, "go here now " * 30 + "stop " * 3]
    df = spark.createDataFrame(list(enumerate(t)), "id bigint, text string")
    assert {tuple(r) for r in neardup.near_duplicate_pairs(df, "id", "text", 3, 0.7, 80).collect()} == {(0, 1)}


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (10, 11), (11, 12), (12, 10), (20, 20), (5, None)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 6)}, **{i: 10 for i in (10, 11, 12)}, **{100 + i: 100 for i in range(41)}}


def test_suffix_array_orders_and_common_prefixes():
    r = np.random.default_rng(1)
    seq = r.integers(0, 4, 200).astype(np.uint64)
    order, lcp = suffix_array(seq, 4)
    key = [tuple(seq[i : i + 4]) for i in order]
    assert key == sorted(key)
    for k in range(1, len(order)):
        a, b = seq[order[k - 1] :][:7], seq[order[k] :][:7]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert min(n, 4) == min(lcp[k], 4)


def test_repeated_lines_against_counting(spark):
    r = random.Random(5)
    lines = ["Share this!", "share  THIS", "© 2020 A.", "| Share this |", "```", "123", "½ ²", "Own {}"]
    rows = []
    for i in range(60):
        body = [r.choice(lines).format(i) for _ in range(8)]
        rows.append((i, r.choice(["a", "b", None]), "\n".join(body)))
    seen, kept = defaultdict(set), []
    for i, h, t in rows:
        fence = False
        for n, line in enumerate(t.split("\n")):
            if line.startswith("```"):
                fence = not fence
                continue
            if fence or line.startswith("|"):
                continue
            key = " ".join("".join(c if c.isalpha() else " " for c in line.lower()).split())
            if key:
                seen[h, key].add(i)
                kept.append((i, n, h, key))
    want = {(i, n) for i, n, h, key in kept if len(seen[h, key]) >= 10}
    df = spark.createDataFrame(rows, "item_id bigint, host string, markdown string").repartition(5)
    got = {(x.id, x.line_no) for x in sitelines.lines_to_delete(df, "item_id", "host", "markdown", 10).collect()}
    assert got == want and want


def test_blocks_and_deletion(spark):
    rows = [(i, "h", f"Legal notice\nShare now\nbody number {'abcdefghijkl'[i]}") for i in range(12)]
    df = spark.createDataFrame(rows, "item_id bigint, host string, markdown string")
    b = sitelines.repeated_blocks(df, "item_id", "host", "markdown", 10).collect()
    assert [(x.lines, x.docs) for x in b] == [(2, 12)]
    assert {x.text for x in sitelines.without_repeated_lines(df, "item_id", "host", "markdown", 10).collect()} == {f"body number {c}" for c in "abcdefghijkl"}


@pytest.mark.parametrize("sent", [True, False])
def test_blocks_against_all_sequences(spark, monkeypatch, sent):
    r = random.Random(8)
    legal = ["Legal notice", "Share now", "Follow us"]
    rows = []
    for i in range(60):  # the same block between other repeated lines
        around = [f"hot {'abcdef'[r.randrange(6)] * 3}" for _ in range(r.randint(0, 5))]
        at = r.randint(0, len(around))
        rows.append((i, "gh"[i % 2], "\n".join([*around[:at], *(legal if i % 3 else legal[:2]), *around[at:], *["", "own " + chr(97 + i // 26) + chr(97 + i % 26)] * (i % 2), *around[:2]])))
    rows += [(100 + i, "long", "\n".join(f"row {chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(90))) for i in range(10)]
    docs = defaultdict(set)
    for i, host, text in rows:
        lines = [x for x in text.split("\n") if x]
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                docs[host, tuple(lines[a:b])].add(i)
    seen = {k for k, v in docs.items() if len(v) >= 10}
    longer = defaultdict(int)
    for host, x in seen:
        for part in (x[1:], x[:-1]):
            longer[host, part] = max(longer[host, part], len(docs[host, x]))
    want = sorted((len(k[1]), len(docs[k])) for k in seen if longer[k] < len(docs[k]))
    monkeypatch.setattr(sitelines, "MAX_SENT", 2_000_000 if sent else 0)
    df = spark.createDataFrame(rows, "item_id bigint, host string, markdown string").repartition(5)
    got = sitelines.repeated_blocks(df, "item_id", "host", "markdown", 10).collect()
    assert sorted((x.lines, x.docs) for x in got) == want and len({x.block for x in got}) == len(got)
    assert (90, 10) in want and (3, 20) in want


def test_long_notices_of_a_host_are_furniture(spark):
    notice = "This paragraph stands under every page of the archive and goes on about the conditions of lending, " * 4
    abc = "abcdefghijklmnopqrstuvwxyz"
    own = lambda i: f"The {abc[i % 26] * 4} of {abc[i // 26] * 5} was found in a field and later shown to the public in a small room."
    rows = [("batch_item", i, "h", f"{own(i)}\n\n{notice}{1900 + i}.\n\n{own(i + 100)}{' More was said of it then.' * 9}") for i in range(60)]
    got = defaultdict(set)
    for x in mainbody.main_blocks(spark.createDataFrame(rows, "tab string, rec_id bigint, host string, text string")).collect():
        got[x.rec_id].add(x.block_md5)
    for _, i, _, text in rows:
        a, b, c = (hashlib.md5(x.encode()).hexdigest() for x in text.split("\n\n"))
        assert got[i] == {a, c}


def test_furniture_is_counted_per_host(spark):
    abc = "abcdefghijklmnopqrstuvwxyz"
    word = lambda i: abc[i // 26 % 26] * 3 + abc[i % 26] * 4
    line = lambda h: f"Visit the shelf of {word(h)} near the harbour wall"
    own = lambda h, i: f"The {word(h * 12 + i)} of {word(h)} was found in a field and later shown to the public."
    rows = [("batch_item", h * 12 + i, f"h{h}", f"{own(h, i)}\n\n{line(h)}\n\n{own(h + 200, i)}") for h in range(40) for i in range(12)]

    def kept(some):
        df = spark.createDataFrame(some, "tab string, rec_id bigint, host string, text string")
        return {(x.rec_id, x.block_md5) for x in mainbody.main_blocks(df).collect()}

    want = {(i, hashlib.md5(x.encode()).hexdigest()) for _, i, _, text in rows for x in text.split("\n\n")[::2]}
    assert kept(rows) == want
    assert kept(rows[:12]) == {x for x in want if x[0] < 12}  # the same page comes out the same in a small group


def test_smith_waterman_against_the_table():
    r = random.Random(2)
    for _ in range(40):
        a = [r.randrange(5) for _ in range(r.randint(0, 14))]
        b = [r.randrange(5) for _ in range(r.randint(0, 14))]
        t = [[0] * (len(a) + 1) for _ in range(len(b) + 1)]
        best = run = 0
        for i in range(1, len(b) + 1):
            for j in range(1, len(a) + 1):
                t[i][j] = max(0, t[i - 1][j - 1] + (2 if b[i - 1] == a[j - 1] else -1), t[i - 1][j] - 1, t[i][j - 1] - 1)
                best = max(best, t[i][j])
        for i in range(len(b)):
            for j in range(len(a)):
                k = 0
                while i + k < len(b) and j + k < len(a) and b[i + k] == a[j + k]:
                    k += 1
                run = max(run, k)
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        assert leakage.smith_waterman(x, y)[0] == best and leakage.longest_run(x, y) == run


def test_alignments_side_by_side_against_one_by_one():
    r = random.Random(4)
    some = [[np.array([r.randrange(6) for _ in range(r.randint(0, 40))], np.uint64) for _ in range(90)] for _ in range(2)]
    got = leakage.aligned_parts(*some)
    assert [tuple(x) for x in got.tolist()] == [(*leakage.smith_waterman(x, y), leakage.longest_run(x, y)) for x, y in zip(*some)]


def test_edited_copies_are_aligned_by_any_seed(spark, tmp_path):
    prompt = [f"w{i}" for i in range(48)]
    copy = [f"x{i}" if i % 8 == 7 else w for i, w in enumerate(prompt)]  # runs of 7 words: no window of 12 is whole
    other = " ".join(f"y{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"{other} {' '.join(copy)} {other}"), (2, other), (3, "w20 w21 w22 w23 w24")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, " ".join(prompt)), (8, "w20 w21 w22 w23 w24"), (9, "too short")], "item_id bigint, prompt string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/eval_item.parquet")
    got = {(x.doc_id, x.item_id): x for x in leakage.p8_alignments(spark, str(tmp_path)).collect()}
    assert set(got) == {(1, 7), (3, 7), (3, 8)}
    assert (got[1, 7].score, got[1, 7].run, got[1, 7].first_word, got[1, 7].last_word) == (2 * 42 - 5, 7, 60, 60 + 47)


@pytest.mark.parametrize("every", [6, 12])
def test_recall_of_edited_copies(spark, every):
    r = random.Random(every)
    w = [f"w{i}" for i in range(4000)]
    prompts = [(i, " ".join(r.choices(w, k=40))) for i in range(50)]
    docs = []
    for i, p in prompts:
        ws = [f"edit{r.randrange(10**6)}" if k % every == every - 1 else x for k, x in enumerate(p.split())]
        docs.append((i, " ".join([*r.choices(w, k=30), *ws, *r.choices(w, k=30)])))
    got = leakage.alignments(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(prompts, "item_id bigint, prompt string")).where(f"coverage >= {leakage.COPY}").collect()
    found = {(x.id, x.item) for x in got}
    assert found <= {(i, i) for i in range(50)} and len(found) >= 45


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "ITEM_BLOCK", 3)
    r = random.Random(1)
    prompts = [(i, " ".join(r.choices([f"w{k}" for k in range(300)], k=20))) for i in range(8)]
    docs = spark.createDataFrame([(i, f"and so {p} it goes") for i, p in prompts], "doc_id bigint, text string")
    got = leakage.leaks(docs, spark.createDataFrame(prompts, "item_id bigint, prompt string")).where("run >= 12")
    assert {(x.id, x.item) for x in got.collect()} == {(i, i) for i in range(8)}


def test_leaks_against_all_windows(spark):
    r = random.Random(9)
    w = [f"w{i}" for i in range(40)]
    prompts = [(i, " ".join(r.choice(w) for _ in range(40))) for i in range(12)]
    docs = []
    for i in range(60):
        t = [r.choice(w) for _ in range(60)]
        p = r.choice(prompts)[1].split()
        n, a, b = r.randint(8, 20), r.randrange(20), r.randrange(40)
        docs.append((i, ", ".join(t[:b] + p[a : a + n] + t[b:]).upper()))
    grams = defaultdict(set)
    for i, p in prompts:
        ws = p.split()
        for k in range(len(ws) - 11):
            grams[tuple(ws[k : k + 12])].add(i)
    want = set()
    for i, t in docs:
        ws = WORD.findall(t.lower())
        for k in range(len(ws) - 11):
            want |= {(i, j) for j in grams.get(tuple(ws[k : k + 12]), ())}
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(prompts, "item_id bigint, prompt string"))
    assert {(x.id, x.item) for x in got.where("run >= 12").collect()} == want and want


def test_mixture_meets_budgets_and_caps(spark):
    rows = [(i, "ab"[i % 7 == 0] if i % 10 else "c", 1 + i % 13, [1.0, 0.2, None][i % 3]) for i in range(2000)]
    sized = spark.createDataFrame(rows, "id bigint, source string, tokens bigint, weight double")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("none", 0.2, 2)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mixture(sized, targets, 6000)
    rep = {r.source: r for r in report.collect()}
    got = chosen.collect()
    taken = Counter()
    for r in got:
        taken[r.source] += r.tokens * r.copies
    assert taken["a"] == rep["a"].taken and 0 <= rep["a"].budget - rep["a"].taken < 14 and rep["none"].taken == 0 and set(taken) == {"a", "b"}
    assert rep["b"].most_copies <= 3 and len({r.id for r in got}) == len(got)
    # heavier weights come first: a's sample holds relatively more of weight 1 than of weight 0.2
    share = lambda w: sum(1 for r in got if r.source == "a" and rows[r.id][3] == w) / sum(1 for x in rows if x[1] == "a" and x[3] == w)
    assert share(1.0) > share(0.2)
    whole, _ = mixing.mixture(sized, targets)
    assert max(r.copies for r in whole.collect()) <= 3


@pytest.mark.parametrize("weights", [[1.0], [0.05], [1.0, 0.05, 0.3]])
def test_running_sums_over_split_bins(spark, monkeypatch, weights):
    monkeypatch.setattr(mixing, "BIN_ROWS", 3)
    monkeypatch.setattr(mixing, "PARTS", 4)
    rows = [(i, "ab"[i % 3 == 0], 1 + i % 7, weights[i % len(weights)]) for i in range(400)]
    sized = spark.createDataFrame(rows, "id bigint, source string, tokens bigint, weight double")
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 2)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mixture(sized, targets, 900)
    got = defaultdict(dict)
    for r in chosen.collect():
        got[r.source][r.id] = r.copies
    keys = {r.id: r.key for r in sized.selectExpr("id", "-ln(((xxhash64(7, id) & 9007199254740991) + 0.5D) / 9007199254740992D) / greatest(weight, 0.05D) as key").collect()}
    for r in report.collect():
        want, left = {}, r.budget - r.epochs * r.available
        for i, source, tokens, _ in sorted(rows, key=lambda x: keys[x[0]]):
            if source == r.source:
                left -= tokens
                if r.epochs + (left >= 0):
                    want[i] = r.epochs + (left >= 0)
        assert got[r.source] == want


@pytest.mark.parametrize("weight", [1.0, 0.05])
def test_no_bin_is_hot(spark, weight):
    keyed = spark.range(1_000_000).selectExpr("id", "'s' as source", "5L as tokens", f"-ln(((xxhash64(7, id) & 9007199254740991) + 0.5D) / 9007199254740992D) / {weight} as key")
    mixing_rows = 2_000
    goal = spark.createDataFrame([("s", 2_345_678)], "source string, rest bigint")
    old, mixing.BIN_ROWS = mixing.BIN_ROWS, mixing_rows
    try:
        binned = mixing._sums(keyed, mixing.F.floor(mixing.F.log2("key") * mixing.LOG_BINS))
        assert binned.agg({"rows": "max"}).first()[0] < 10_000
        ((_, lo, hi, before, rows),) = mixing.edge_bins(keyed, binned, goal)
    finally:
        mixing.BIN_ROWS = old
    assert rows <= mixing_rows and before <= 2_345_678 < before + 5 * rows and before == 5 * keyed.where(f"key < {lo!r}").count()


def test_repair_round_trip():
    clean = ["café", "Straße", "señor", "naïve", "“quoted”", "it’s", "€5", "дорога"] * 30
    counts = np.zeros(mojibake.BLOCKS * mojibake.CELLS, np.int64)
    seen = Counter(mojibake._window(t, m) for t in (f"the {w} was" for w in clean) for m in mojibake._RUN.finditer(t))
    sample = mojibake._absorb(counts, {}, seen)
    margins = mojibake.validated_margins(mojibake.Model(counts), list(sample.values()))
    r = mojibake.Repairer(counts, margins)
    for w in set(clean):
        text = f"the {w} was"
        assert r.repaired(text) == (text, []), w
        for wrong in ("cp1252", "latin-1", "mac_roman", "cp850"):
            bad = "the " + w.encode().decode("latin-1").translate(mojibake._ENC[wrong][1]) + " was"
            fixed, chains = r.repaired(bad)
            assert fixed == text and chains, (w, wrong, bad, fixed)
    for w, wrong in (("café", "gbk"), ("señor", "gbk"), ("naïve", "big5"), ("дорога", "euc_kr"), ("дорога", "gbk")):
        raw = f"the {w} was".encode()
        try:
            bad = raw.decode(wrong)
        except UnicodeDecodeError:
            continue
        assert r.repaired(bad)[0] == f"the {w} was", (w, wrong, bad, r.repaired(bad))
    assert not r.is_garbled("LA FENÊTRE DU CHÂTEAU, L’ÂGE D’OR, 12 ± 2 °C")


def test_titles_and_entities_are_repaired(spark, tmp_path):
    good = [f"the café of señor {w}, naïve" for w in ("lane", "hill", "wood")]
    pages = [(i, f"<p>{good[i % 3]}</p>") for i in range(90)] + [(100, "<p>A &amp; B: the caf&Atilde;&copy; of se&#195;&#177;or &lt;lane&gt;, caf&eacute;</p>")]
    items = [(i, good[i % 3], good[i % 3]) for i in range(90)] + [(200, "the cafÃ© of lane", "fine")]
    spark.createDataFrame(pages, "page_id bigint, html string").write.parquet(f"{tmp_path}/raw_page.parquet")
    spark.createDataFrame(items, "item_id bigint, title string, markdown string").write.parquet(f"{tmp_path}/batch_item.parquet")
    got = {(r.tab, r.rec_id): (r.text, r.chains != "", r.left) for r in mojibake.p2_repaired(spark, str(tmp_path)).collect()}
    assert got == {
        ("raw_page", 100): ("<p>A &amp; B: the café of señor &lt;lane&gt;, caf&eacute;</p>", True, 0),
        ("batch_item.title", 200): ("the café of lane", True, 0),
    }


@pytest.mark.parametrize("text,kinds", [("Dear {{ name }}, hi", "placeholder"), ("```\n{{ name }}\n```\nfine text", ""), ("Sum x^{2} over a_{0}", ""), ("# 404 Not Found\n\nThe page you were looking for does not exist or has been moved.", "notice"), ("Lorem ipsum dolor sit amet consectetur elit.", "filler"), ("Designers fill an empty page with lorem ipsum until the real text arrives from them.", ""), ("An essay on how page not found messages came to be. " * 5 + "It has much more to say about it, and goes on. " * 20, ""), ("Пожалуйста\n\nДля просмотра включите JavaScript и обновите страницу.", "notice")])
def test_residue_verdicts(text, kinds):
    assert ",".join(residue._judged(residue.Judge(), "batch_item", text)) == kinds


def test_reading_fit_on_held_out_labels():
    r = np.random.default_rng(4)
    level = r.integers(1, 6, 800)
    m = np.column_stack([r.integers(0, 2, 800), 0.05 + 0.03 * level + r.normal(0, 0.01, 800), np.exp(1.2 + 0.45 * level + r.normal(0, 0.08, 800))])
    w = reading.fit_boundaries(m[:500], level[:500])
    got = 1 + (reading.design(m[500:]) @ w.T > 0).sum(axis=1)
    assert (got == level[500:]).mean() > 0.9 and math.isfinite(w.sum())
