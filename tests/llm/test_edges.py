"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import pytest

from siltworks.llm import leakage, mainbody, markup, mixing, mojibake, neardup, reading, residue, sitelines

LONG = "A long tale of many words that never seems to end at all. " * 20_000
TEXTS = [None, "", " ", "x", "\n\n", "é", "�", "```\nopen fence", "| a |", "<p>unclosed <b>", "{{ x }}", LONG, LONG, "𝔘𝔫𝔦 \U0001f600 \x00 \u200b", "Ã©"]
#: A frame with nulls in every column and further columns under names that operators use inside.
SCHEMA = "item_id bigint, host string, markdown string, id string, text int, h string, tab double, n string, c string, level string, source string, g string, block string, lang string"


def frame(spark, texts=TEXTS):
    rows = [(None if i == 3 else i, None if i % 4 == 0 else "h.test", t, "id", 1, "h", 0.5, "n", "c", "l", None if i % 5 == 0 else "s", "g", "b", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def records(df):
    return df.selectExpr("'batch_item' as tab", "item_id as rec_id", "markdown as text").where("rec_id is not null and text is not null and text <> ''")


def run(name, spark, df):
    if name == "neardup":
        return neardup.near_duplicate_pairs(df, "item_id", "markdown", 3, 0.7, 5)
    if name == "groups":
        return neardup.near_duplicate_groups(df, "item_id", "markdown")
    if name == "sitelines":
        return sitelines.lines_to_delete(df, "item_id", "host", "markdown", 2)
    if name == "blocks":
        return sitelines.repeated_blocks(df, "item_id", "host", "markdown", 2)
    if name == "clean":
        return sitelines.without_repeated_lines(df, "item_id", "host", "markdown", 2)
    if name == "leakage":
        items = spark.createDataFrame([(1, LONG[:400]), (2, None), (3, ""), (4, "two words"), (None, LONG[:400])], "item_id bigint, prompt string")
        return leakage.leaks(df, items, "item_id", "markdown")
    if name == "mojibake":
        return mojibake.garbled_records(records(df))
    if name == "repaired":
        return mojibake.repaired_records(records(df))
    if name == "residue":
        return residue.residue(records(df))
    if name == "mainbody":
        return mainbody.main_blocks(df.selectExpr("'batch_item' as tab", "item_id as rec_id", "host", "markdown as text").where("rec_id is not null and text is not null and text <> ''"))
    if name == "markup":
        return markup.markup_kinds(records(df))
    if name == "cleaned":
        return markup.cleaned(records(df))
    if name == "reading":
        labels = spark.createDataFrame([(1, 3), (1, 3), (2, None), (None, 4)], "item_id bigint, level int")
        return reading.reading_levels(df, labels, "item_id", "markdown")
    sized = mixing.token_counts(df, "item_id", "markdown", "source")
    return mixing.mixture(sized, spark.createDataFrame([("s", 0.7, 2), ("absent", 0.3, 1), (None, 0.5, 1)], "source string, target_share double, max_repeats int"))[name == "report"]


NAMES = ["neardup", "groups", "sitelines", "blocks", "clean", "leakage", "mojibake", "repaired", "residue", "mainbody", "markup", "cleaned", "reading", "mix", "report"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, name):
    rows = run(name, spark, frame(spark)).collect()
    if name == "neardup":
        assert {(r.a, r.b) for r in rows} == {(11, 12)}
    if name == "mojibake":
        assert {6} <= {r.rec_id for r in rows}
    if name == "residue":
        assert {(r.rec_id, r.kinds) for r in rows} == {(10, "placeholder")}
    if name == "leakage":
        assert {(r.id, r.item) for r in rows if r.run >= 12} == {(11, 1), (12, 1)}
    if name == "sitelines":
        assert {(r.id, r.line_no) for r in rows} <= {(11, 0), (12, 0)}


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    rows = run(name, spark, frame(spark, [])).collect()
    assert len(rows) == (2 if name == "report" else 0)
