from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.functions import scalars as S
from lodestone.functions.names import note_name


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    return [r[0] for r in rows.orderBy("k").select(f(F.col("x"))).collect()]


def test_note_names(spark):
    raw = ["Areas/Field/Pump Gasket.md", "pump#Materials", "Notes|alias", "  A  B ", "X.PDF", "pic.PNG", "", "#top", None, "a/b/.md", "café#x|y"]
    assert column(spark, raw, note_name) == ["pump-gasket", "pump", "notes", "a-b", "x-pdf", None, None, None, None, None, "café"]


def test_slugs(spark):
    raw = ["My Note.md", " Paper.PDF ", "A/B c", "--x--y--", "Über Größe!", "日本 語", "🙂", None]
    assert column(spark, raw, S.slugify) == ["my-note", "paper-pdf", "ab-c", "x-y", "über-größe", "日本-語", "", None]


def test_titles_and_attachments(spark):
    assert column(spark, ["a/b/My.Note.MD", "x.pdf", "y", None], S.title_from_path) == ["My.Note", "x", "y", None]
    assert column(spark, ["a.png|200", "b.zip#x", "note", "c.pdf", "v1.2 plan", None], S.attachment_kind) == ["image", "attachment", None, None, None, None]


def test_numeric_sizes(spark):
    assert column(spark, ["200", "200x150", "x", "", "200px"], S.is_numeric_size) == [True, True, False, False, False]


def test_query_tokens(spark):
    assert column(spark, ["Golang, Café a go-GO"], S.query_tokens) == [["golang", "caf", "go"]]


def test_word_count_and_tokens(spark):
    assert column(spark, ["  a b\n c ", "", " \n", None], S.word_count) == [3, 0, 0, None]
    assert column(spark, ["abcde", ""], S.estimated_tokens) == [2, 0]


def test_code_only(spark):
    given = ["[code:go]", " [code]\n\n[code:py]\n", "[code] and words", "```x```", ""]
    df = spark.createDataFrame([(t,) for t in given], "t string")
    assert [r[0] for r in df.select(S.is_code_only(F.col("t"))).collect()] == [True, True, False, False, False]


def test_tsv_escape(spark):
    assert column(spark, ["a\tb\\c\nd\re", None], S.tsv_escape) == ["a\\tb\\\\c\\nd\\re", ""]


@pytest.mark.parametrize(("budget", "want"), [(100, "T > H\n[tags: a, b]\n\nbody"), (6, "T > H\n\nbody"), (4, "T\n\nbody"), (3, "body")])
def test_embed_text_drops_what_does_not_fit(spark, budget, want):
    rows = spark.createDataFrame([("T", "H", ["a", "b"], "body")], "t string, h string, g array<string>, b string")
    assert rows.select(S.embed_text(F.col("t"), F.col("h"), F.col("g"), F.col("b"), budget)).first()[0] == want


def test_headings_that_repeat_the_title(spark):
    rows = spark.createDataFrame([("Distributed Systems", "Distributed Systems > Clocks"), ("Short", "Shortened > B"), ("A", "A > B"), ("Other", "Intro")], "t string, h string")
    assert [r[0] for r in rows.select(S.trimmed_heading(F.col("t"), F.col("h"))).collect()] == ["Clocks", "Shortened > B", "B", "Intro"]


def test_uri_and_chips(spark):
    assert column(spark, ["a b/ç.md"], lambda c: S.open_uri("app", "my vault", c)) == ["app://open?vault=my%20vault&file=a%20b%2F%C3%A7.md"]
    assert column(spark, [["a", "b"]], S.tag_chips, "array<string>") == ["#a #b"]
    assert S.normal_tag(" #Project ") == "project"
    assert column(spark, [0.9, 0.6, 0.1], S.score_band, "double") == ["high", "medium", "low"]
