from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm.splitting import BLANK, _joined, split_oversized, split_text


def check(text, limit, overlap):
    pieces = split_text(text, limit, overlap)
    bare = (text or "").strip(BLANK)
    assert "".join(bare[f:e] for _, f, e in pieces) == bare  # whole, in order
    assert all(0 < e - s <= limit for s, _, e in pieces)
    kept = min(overlap, limit // 2)
    for (s0, _, e0), (s, f, _) in zip(pieces, pieces[1:]):
        asked = f - min(kept, f)
        assert e0 == f and s >= max(s0, asked)  # shared with the piece before
        assert all(_joined(bare, p) for p in range(asked, s))  # less only where a character would be parted
    return [bare[s:e] for s, _, e in pieces]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .,\n\r#|`-é日。́‍🙂", max_size=700), st.integers(1, 90), st.integers(0, 60))
def test_any_text(text, limit, overlap):
    check(text, limit, overlap)


def test_places():
    assert check("# A\n\n" + "one two. " * 6 + "\n\n# B\n\n" + "three four. " * 5, 80, 0)[1].startswith("# B")
    assert check("First sentence here. Second sentence here.", 30, 0) == ["First sentence here. ", "Second sentence here."]
    assert check("Some words here (see e.g. this). " * 3, 40, 0)[1].startswith("Some")
    assert not any(p.rstrip().endswith("# Head") for p in check("x y z. " * 9 + "\n\n# Head\n\n" + "u v w. " * 9, 70, 0))
    code = check("```\n" + "x = 1\n" * 30 + "```", 80, 0)
    assert all(p.startswith(("```", "x = 1")) for p in code)
    assert check("a" * 1000, 100, 10)
    assert all(not p.startswith("́") for o in (0, 10, 11) for p in check("é" * 500, 51, o))
    assert all(not p.startswith("\n") for o in (10, 11, 12) for p in check("a\r\n" * 300, 50, o))


def test_a_very_long_text_is_quick():
    assert len(check("word and more. " * 60_000, 800, 100)) > 1000


def test_rows(spark):
    rows = [(1, "x" * 30, 10, 2, "h"), (2, "  " + "y" * 10 + "\r\n", 10, 2, "h"), (3, None, 10, 2, "h"), (4, " \n", 10, 2, None), (5, "z " * 20, None, 2, "h"), (6, "w " * 20, 10, None, None), (7, "v" * 5, 0, 0, "h"), (None, "u" * 20, 10, 2, "h")]
    df = spark.createDataFrame(rows, "k long, text string, n int, o int, piece string")
    got = split_oversized(df, "k", F.col("text"), F.col("n"), F.col("o"), "piece")
    assert got.columns == ["k", "piece", "start", "fresh", "end", "text", "piece"]
    assert {r[0] for r in got.collect()} == {1, 6, None}
    assert split_oversized(df.limit(0), "k", F.col("text"), F.col("n"), F.col("o")).count() == 0
