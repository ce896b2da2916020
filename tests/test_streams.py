import json
import os

from siltworks.operators import sequences as Q
from siltworks.streaming import watch as W


def run(spark, tmp_path, rows, schema, build, out):
    src = tmp_path / "in"
    src.mkdir()
    for k, part in enumerate((rows[: len(rows) // 2], rows[len(rows) // 2 :])):
        names = [c.split()[0] for c in schema.split(", ")]
        (src / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(names, r))) for r in part))
        os.utime(src / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    q = build(stream).writeStream.format("memory").queryName(out).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(out)


def test_heal_stream_equals_the_fold(spark, tmp_path):
    rows = [("d", f, i, (i * 7 + len(f)) % 10 < 4) for i in range(1, 81) for f in ("f", "gg")]
    schema = "domain string, field string, seq bigint, is_null boolean"
    got = {tuple(r) for r in run(spark, tmp_path, rows, schema, W.heal_stream, "heal_out").collect()}
    want = {tuple(r) for r in Q.heal_triggers(spark.createDataFrame(rows, schema), ["domain", "field"], "seq", "is_null").collect()}
    assert got == want and got


def test_watch_stream_equals_changes(spark, tmp_path):
    rows = [("u", "h1", "a b", 1), ("v", "x", "t", 2), ("u", "h1", "a b", 3), ("u", "h2", "a c", 4)]
    got = {(r.url, r.seq, r.changed, r.diff) for r in run(spark, tmp_path, rows, "url string, content_hash string, markdown string, seq bigint", W.watch, "watch_out").collect()}
    assert got == {("u", 1, False, ""), ("v", 2, False, ""), ("u", 3, False, ""), ("u", 4, True, "- b\n+ c\n")}


def test_throttle_stream_equals_the_fold(spark, tmp_path):
    rows = [("h", i, s, None) for i, s in enumerate([200, 429, 429, 503, 200, 404, 200])]
    schema = "host string, seq int, status int, retry_after double"
    last = run(spark, tmp_path, rows, schema, W.throttle_stream, "throttle_out").orderBy("seq").collect()[-1].delay_s
    want = Q.throttle_delays(spark.createDataFrame(rows, schema), "host", "seq", "status", "retry_after").first().delay_s
    assert last == want


def test_hash_stream_over_micro_batches_and_its_diffs(spark, tmp_path):
    texts = ["a b", "a b", "a c", None, "a c d"]
    rows = [(u, str(t), t, i) for i, t in enumerate(texts) for u in ("u", "v")]
    schema = "url string, content_hash string, markdown string, seq bigint"
    changes = run(spark, tmp_path, rows, schema, W.watch_hashes, "hash_out")
    got = {(r.url, r.seq): (r.changed, r.old_seq) for r in changes.collect()}
    assert got == {(u, i): (i in (2, 3, 4), i - 1 if i else None) for u in "uv" for i in range(5)}
    diffs = {(r.url, r.seq): r.diff for r in W.with_diffs(changes.where("url = 'u'"), spark.createDataFrame(rows, schema).where("url = 'u'")).collect()}
    assert set(diffs) == {("u", 2), ("u", 3), ("u", 4)} and "- b" in diffs["u", 2] and "+ d" in diffs["u", 4]
