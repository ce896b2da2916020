"""Work that must not grow faster than the tables."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltworks.llm import mainbody, mojibake, neardup


def test_hot_ngrams_late_in_every_class_meet_nobody():
    n, k = 100, 5000
    late = pa.record_batch([pa.array([9] * k, pa.int32()), pa.array([7] * k, pa.int64()), pa.array([25] * k, pa.int32()), pa.array(range(k), pa.int64()), pa.array([n] * k, pa.int32())], names=["f", "g", "p", "c", "n"])
    assert sum(b.num_rows for b in neardup._meetings(iter([late]), 0.7, 9)) == 0
    # one class holds it early: those as large, up to the size that its place leaves, stay
    sizes = np.array([100, 60, 100, 110, 140], np.int32)
    rows = pa.record_batch([pa.array([9] * 5, pa.int32()), pa.array([7] * 5, pa.int64()), pa.array([12, 25, 25, 25, 40], pa.int32()), pa.array(range(5), pa.int64()), pa.array(sizes)], names=["f", "g", "p", "c", "n"])
    for cut in range(1, 5):
        got = [x for b in neardup._meetings(iter([rows[:cut], rows[cut:]]), 0.7, 9) for x in b.column(0).to_pylist()]
        assert got == [0, 2, 3]


def test_hot_pairs_against_all_pairs(spark):
    r = random.Random(3)
    hot = [(g, r.randrange(0, 60), c, 40 + c % 150) for g in range(4) for c in r.sample(range(900), 400)]
    hot = [(g, min(p, n - 1), c, n) for g, p, c, n in hot]
    need = lambda a, b: int(np.ceil(0.7 / 1.7 * (a + b) - 1e-9))
    want: dict = {}
    for g, p, c, n in hot:
        for g2, q, d, m in hot:
            if g == g2 and c < d and min(n, m) >= 0.7 * max(n, m) - 1e-9 and p < n - need(n, m) + 4 and q < m - need(n, m) + 4:
                want[c, d, n, m] = want.get((c, d, n, m), 0) + 1
    df = spark.createDataFrame(hot, "g bigint, p int, c bigint, n int")
    classes, neardup.SALT_CLASSES = neardup.SALT_CLASSES, 3
    try:
        got = {tuple(x)[:4]: x.shared for x in neardup._salted(df, 0.7).collect()}
    finally:
        neardup.SALT_CLASSES = classes
    assert got == want and len(want) > 500


def test_common_ngrams_are_ordered_by_their_counts(spark):
    df = spark.range(1200).select("id", F.when(F.col("id") % 4 == 0, "some very common words and a rarer ending here").otherwise("some very common words").alias("text"))
    first = neardup._classes_and_sketch(df, 3, 1)
    sketch = neardup._load(neardup._merged_sketch(first.where("block is not null")))
    hasher = neardup.WordHasher()
    often = neardup.gram_set("some very common words", hasher, 3, 1)
    seldom = np.setdiff1d(neardup.gram_set("some very common words and a rarer ending here", hasher, 3, 1), often)
    _, times = neardup._ordered(np.concatenate((often, seldom)), sketch)
    at = neardup._ordered(np.concatenate((often, seldom)), sketch)[0]
    assert set(at[-2:]) == set(often) and times[0] < times[-1]


def test_margins_come_from_all_clean_runs(spark):
    """Each run stands once in three tasks, so three times in all; a unit separator stands beside some."""
    r = random.Random(8)
    stems = ["".join(r.choices("bcdfglmnprst", k=2)) + r.choice("aeiou") for _ in range(60)]
    runs = sorted({r.choice("éèüößçñ") + r.choice("éàôïûœ") for _ in range(20)})
    lines = [f"{s}{run}{c}" for s in stems for run in runs for c in "bd"]
    texts = [" ".join(lines)] * 3 + ["x\x1fé\x1f"] * 3
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(6)
    counts, margins = mojibake.train(df)
    seen = Counter(mojibake._window(t, m) for t in texts for m in mojibake._RUN.finditer(t))
    whole = np.zeros(mojibake.BLOCKS * mojibake.CELLS, np.int64)
    sample = mojibake._absorb(whole, {}, seen)
    assert (counts == whole).all()
    keys = {"\x1f".join(k) for k, n in seen.items() if n >= mojibake.SEEN and mojibake._is_clean(k[1])}
    assert set(sample.values()) == keys and len(keys) > 500
    assert margins == mojibake.validated_margins(mojibake.Model(whole.astype(np.float32)), sorted(keys))


@pytest.mark.parametrize("copies", [0, 300])
def test_shards_of_a_host_decide_like_one_group(spark, copies, monkeypatch):
    """What stands on two pages only is found wherever the shards of a large host put them."""
    r = random.Random(4)
    words = ["".join(r.choices("abcdefghiklmnoprstu", k=7)) for _ in range(3000)]
    rows = []
    for i in range(240):
        twice = f"Share this {words[i // 2]} {words[i // 2 + 300]} page on your {words[i // 2 + 600]} network"
        rows.append(("batch_item", i, "big.example", "\n".join([" ".join(r.choices(words, k=25)), twice, " ".join(r.choices(words, k=25))])))
    rows += [("batch_item", 1000 + i, "big.example", rows[0][3]) for i in range(copies)]
    rows += [("batch_item", 5000 + i, "small.example", " ".join(r.choices(words, k=20))) for i in range(5)]
    df = spark.createDataFrame(rows, "tab string, rec_id bigint, host string, text string")
    whole = {tuple(x) for x in mainbody.main_blocks(df).collect()}
    monkeypatch.setattr(mainbody, "GROUP", 60)
    assert {tuple(x) for x in mainbody.main_blocks(df).collect()} == whole
    shared = hashlib.md5(rows[2][3].split("\n")[1].encode()).hexdigest()
    assert ("batch_item", 2, shared) not in whole and len(whole) == 2 * (240 + copies) + 5


def test_headlines_of_a_few_copies_are_no_menu_of_a_large_host():
    flags, owner = np.array([mainbody._MENU, mainbody._MENU, 0], np.uint16), np.full(3, mainbody._NONE, np.uint32)
    cov, on = np.ones((2, 3)), np.array([[9000, 4, 1], [9000, 4, 1]])
    assert mainbody.furniture(flags, owner, cov, on, 10000).tolist() == [True, False, False]
    assert mainbody.furniture(flags, owner, cov, on, 100).tolist() == [True, True, False]
