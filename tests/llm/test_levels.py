from __future__ import annotations

import numpy as np
import pytest

from lodestone.llm import levels, prose
from lodestone.llm.catalogue import BANDS

EASY = "The cat sat on the mat. We saw a red dog and it ran to the big tree. I had a cup of milk. "
HARD = "Notwithstanding the epistemological heterogeneity attributed to institutional hermeneutics, the paradigmatic operationalization necessarily presupposes an interdisciplinary contextualization of methodological individualism. "
FOREIGN = "Nous avons vérifié le fichier et la clé après les pages. La journée reste calme tant que le fichier n'est pas relié. "


@pytest.fixture(scope="module")
def model():
    return levels.LevelModel.learn([("primary", EASY * 6), ("specialist", HARD * 4), ("none", "x"), ("primary", None)], BANDS)


def test_prose_without_markup():
    text = "---\ntitle: x\n---\n# Head\n\nA [link](http://u) and ![[e.png]] `code` end.\nhttp://a.b/c #tag\n\n```\ncode here\n```\n| a | b |\n|---|---|\n\n> [!note] T\n> quoted words\n\n- [ ] item one\n- item two\n\nTitle\n=====\n\n    indented code\n"
    assert [b.replace("\x00", "") for b in prose.blocks(text)] == ["A link and     end.", "quoted words", "item one\nitem two"]
    assert prose.blocks("```\nnever ends") == [] and prose.blocks("") == []
    assert len(prose.sentences("\x00one two\n\x00three")) == 2


def test_bands(model):
    assert model.band(EASY * 6)[0] == "primary" and model.band(HARD * 6)[0] == "specialist"
    assert model.band(EASY * 9 + "\n\n" + HARD * 2)[0] == "primary"  # the larger part
    assert model.band("```\n" + HARD * 6 + "\n```\n\n" + EASY * 5)[0] == "primary"
    assert model.band(FOREIGN * 6) is None and model.band("日本語の文章。" * 100) is None
    assert model.band(FOREIGN * 2 + "\n\n" + EASY * 6)[0] == "primary"
    assert model.band(EASY) is None and model.band(None) is None and model.band(" \n") is None


OTHERS = {
    "Danish": "Det var en kold morgen, og børnene gik langsomt for at komme i skole. Deres mor havde lagt brød og mælk i tasken, så de kunne have noget at spise i pausen. ",
    "Norwegian": "Vi gikk langs fjorden hele dagen for å se på båtene som skulle ut på havet. Bestefar hadde fortalt oss at de gamle fiskerne alltid tok med seg kaffe og en god historie. ",
    "Swedish": "När hösten kom flyttade familjen till en liten stad vid kusten där fadern hade fått ett nytt arbete. Barnen fick börja i en annan skola och det tog lång tid. ",
    "Dutch": "Het was al laat toen de trein eindelijk het station binnenreed en de mensen naar buiten stapten. Niemand wist precies waarom het zo lang had geduurd. ",
    "German": "Der alte Mann saß jeden Morgen am Fenster und sah den Vögeln zu, die in seinen Garten kamen, um Körner zu fressen, bis der Nachbar mit seinem Hund kam. ",
    "Finnish": "Vanha mies istui joka aamu ikkunan ääressä ja katseli lintuja, jotka tulivat syömään siemeniä hänen pihalleen. ",
    "Indonesian": "Setiap pagi orang tua itu duduk di dekat jendela dan melihat burung yang datang ke kebunnya untuk makan biji. ",
    "Latin": "Gallia est omnis divisa in partes tres quarum unam incolunt Belgae aliam Aquitani tertiam qui ipsorum lingua Celtae nostra Galli appellantur. ",
}
ENGLISH = {
    "plain": "Every morning the old man sat by the window and watched the birds that came to his garden to eat the seeds. ",
    "learned": "Heterogeneous catalysis on bimetallic nanoparticles exhibits pronounced structure sensitivity, whereby adsorbate coverage modulates turnover frequency. ",
}


def test_languages_that_the_model_does_not_know(spark):
    rows = [(r["band"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/level_samples.parquet").orderBy("sample_id").collect()]
    model = levels.LevelModel.learn(rows, BANDS)
    for name, text in OTHERS.items():
        assert model.band(text * 8) is None, name
        assert model.band(text * 4 + "\n\n" + ENGLISH["plain"] * 12) is not None
    assert [model.band(t * 8)[0] for t in ENGLISH.values()] == ["secondary", "specialist"]


def test_measures_are_those_of_single_words():
    common = np.sort(np.array([levels.word_code(w) for w in ("the", "cat")], np.uint64))
    blocks = ["The Cat, the dog; it ran. It sat! 12 ok", "", "\x00one item\n\x00another (item.) \"Yes.\" no", "Überraschung 日本"]
    m = levels.measure(blocks, common)
    assert m.words.tolist() == [9, 0, 6, 2] and m.plain.tolist() == [10, 0, 6, 1] and m.letters.tolist() == [24, 0, 23, 14]
    assert m.x[0].round(4).tolist() == [round(v, 4) for v in (24 / 9, 1.0, 0, 0, 0, np.log(9 / 3), 2 / 9, 0, 3 / 9)]
    assert np.exp(m.x[2][5]) == pytest.approx(6 / 4) and m.foreign.tolist() == [0, 0, 0, 14]
    whole = levels.measure([blocks[0]], common)
    assert np.array_equal(whole.x[0], m.x[0]) and np.array_equal(whole.trigrams[:20], m.trigrams[:20])


def test_many_parts_are_drawn_as_pairs():
    y = np.repeat([0, 1, 2], 3000)
    hard, easy = levels._pairs(y, 5000)
    assert len(hard) == 5000 and (y[hard] > y[easy]).all()
    assert len(levels._pairs(y[::1000], 5000)[0]) == 27


def test_samples_are_taken_from_every_band(spark):
    rows = [(k, BANDS[k // 30], (EASY if k < 60 else HARD) * 4) for k in range(120)]
    df = spark.createDataFrame(rows, "sample_id long, band string, text string")
    model = levels.learn(df, BANDS, most=8)
    assert model.values.min() < 1 and model.values.max() >= 2


def test_held_out_passages_of_the_data(spark):
    rows = [(r["band"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/level_samples.parquet").orderBy("sample_id").collect()]
    right = 0
    for k in range(4):
        m = levels.LevelModel.learn([r for i, r in enumerate(rows) if i // 4 % 4 != k], BANDS)
        right += sum(m.band(t, 20)[0] == b for i, (b, t) in enumerate(rows) if i // 4 % 4 == k)
    assert right >= 0.95 * len(rows)


def test_isotonic():
    assert levels.isotonic(np.array([1.0, 3, 2, 2, 5])).tolist() == pytest.approx([1, 7 / 3, 7 / 3, 7 / 3, 5])
    assert levels.isotonic(np.zeros(0)).size == 0


def test_rows(spark, model):
    df = spark.createDataFrame([(1, EASY * 6, "x"), (2, None, "x"), (3, "", "x"), (None, EASY * 6, "x"), (1, EASY * 6, "x")], "doc_id long, text string, band string")
    got = levels.reading_levels(df, model).collect()
    assert [(r["doc_id"], r["band"]) for r in got] == [(1, "primary"), (1, "primary")]
    assert levels.reading_levels(df.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        levels.LevelModel.learn([("primary", EASY * 6)], BANDS)
