from __future__ import annotations

import json
import urllib.error

import pytest

from lodestone.__main__ import main
from lodestone.engine import Engine
from lodestone.operators import ingest
from lodestone.operators.filters import SearchFilter
from lodestone.sources import convert
from lodestone.sources.store import Store

NOTES = {
    "Garden.md": "---\ntags: [outdoor, outdoor/plants]\n---\n# Soil\nCompost and mulch keep the garden soil moist through a long dry summer, see [[Compost]].\n",
    "Compost.md": "---\ntags: [outdoor]\n---\nCompost heaps need air, water and a mix of green and brown garden matter to rot well.\n",
    "Mulch.md": "Mulch and compost keep garden soil moist through a long dry summer and feed it too.\n",
    "Router.md": "The router firmware drops the wireless network whenever the kitchen microwave oven runs. [[Missing page]]\n",
}


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    root, at = tmp_path_factory.mktemp("vault"), tmp_path_factory.mktemp("store")
    for name, text in NOTES.items():
        (root / name).write_text(text)
    store = Store(spark, str(at))
    ingest.Ingest(spark, store, ingest.HashingEmbedder(384), ingest.Settings(400, 50, 5)).run(str(root))
    return Engine(store, ingest.HashingEmbedder(384)), at


def slugs(df):
    return [r["note_slug"] for r in df.collect()]


def test_questions(world):
    engine = world[0]
    assert slugs(engine.search(["router firmware wireless network"]))[0] == "router"
    assert slugs(engine.search(["compost garden", " compost garden ", "router network"], 4)) and "router" not in slugs(engine.search(["garden soil"], exclude=["Router"]))
    assert [r["lexical"] for r in engine.search(["compost"], min_score=0.99).collect()][0] is True
    assert slugs(engine.search([], where=SearchFilter(tag="outdoor"))) == ["compost", "garden"]
    assert slugs(engine.backlinks("Compost")) == ["garden"] and slugs(engine.shared_tags("compost")) == ["garden"]
    assert slugs(engine.hidden("garden"))[0] == "mulch" and slugs(engine.hidden("garden", deep=True))[0] == "mulch"
    assert "compost" not in slugs(engine.hidden("garden")) and "compost" in slugs(engine.hidden("garden", include_linked=True))
    assert {r["note_slug"]: r["is_phantom"] for r in engine.connections("router").collect()} == {"missing-page": True}
    assert {r["note_slug"] for r in engine.boosted("moist soil", "garden").where("extra is not null").collect()} == {"compost"}
    assert engine.get("garden").first()["content"].startswith("# Soil") and engine.meta("garden").first()["n_chunks"] == 1
    assert tuple(engine.stats().first()) == (4, 4, 2) and slugs(engine.slugs()) == ["compost", "garden", "mulch", "router"]
    with pytest.raises(ValueError):
        engine.search([" "])


def test_commands(world, spark, capsys):
    at = ["--store", str(world[1])]
    assert main([*at, "--json-path", "results[*].note_slug", "search", "router firmware", "--limit", "1"], spark) == 0
    assert capsys.readouterr().out == "router\n"
    assert main([*at, "--format", "json", "stats"], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"command": "stats", "notes": 4, "chunks": 4, "links": 2}
    assert main([*at, "--format", "tsv", "backlinks", "compost"], spark) == 0
    assert capsys.readouterr().out.split("\n")[:2] == ["slug\ttitle\tfile_path\tscore\ttags\textra\theading_path\ttext", "garden\tGarden\tGarden.md\t1.000000\t\tCompost\t\t"]
    assert main([*at, "tags", "--list"], spark) == 0 and "#outdoor\t(2 notes)" in capsys.readouterr().out
    assert main([*at, "--format", "json", "search", "garden", "soil", "--limit", "2"], spark) == 0
    made = json.loads(capsys.readouterr().out)
    assert made["queries"] == ["garden", "soil"] and not {"text", "tags", "id", "embedding"} & set(made["results"][0]) and "file_path" in made["results"][0]
    assert main([*at, "--format", "json", "--show-tags", "--no-show-file-path", "--include-text", "search", "compost heaps rot"], spark) == 0
    made = json.loads(capsys.readouterr().out)["results"][0]
    assert made["tags"] == ["outdoor"] and made["text"].startswith("Compost heaps") and "file_path" not in made
    assert main([*at, "search", "compost heaps rot", "--limit", "1"], spark) == 0 and capsys.readouterr().out.startswith("1. Compost ")
    assert main([*at, "tags", "outdor"], spark) == 0 and "Did you mean: #outdoor" in capsys.readouterr().out
    assert main([*at, "get", "compost", "--meta"], spark) == 0 and "Chunks: 1" in capsys.readouterr().out
    assert main([*at, "suggest-notes"], spark) == 0 and capsys.readouterr().out.split() == ["compost", "garden", "mulch", "router"]
    assert main([*at, "tags"], spark) == 2
    assert main([*at, "index"], spark) == 0 and json.loads(capsys.readouterr().out)["cells"] == 2
    assert Engine(world[0].store, world[0].embedder).index is None and world[0].store.has_index()
    again = Engine(world[0].store, world[0].embedder)
    assert slugs(again.search(["router firmware wireless network"]))[0] == "router" and again.index is not None
    assert main([*at, "get", "nothing"], spark) == 1 and main([*at, "nonsense"], spark) == 2 and main([*at, "doctor"], spark) == 0


def test_ingest_of_pdfs(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "v").mkdir()
    (tmp_path / "v/Paper.pdf").write_bytes(b"first page of a paper on soil\fsecond page of it")
    (tmp_path / "v/skip.md").write_text("some words of a note to be kept")
    (tmp_path / "v/.obsidian").mkdir()
    (tmp_path / "v/.obsidian/app.json").write_text('{"userIgnoreFilters": ["skip"]}')
    monkeypatch.setattr(convert, "converter", lambda model, window, env: lambda text: f"# {model}\n\n{text}")
    at = ["--store", str(tmp_path / "s"), "ingest", str(tmp_path / "v"), "--min-chunk-words", "3", "--chunk-size", "200", "--chunk-overlap", "20"]
    assert main([*at, "--enable-pdf"], spark) == 2  # no reader
    assert main([*at, "--enable-pdf", "--pdf-reader", "no.such:thing"], spark) == 1
    monkeypatch.setattr("lodestone.__main__.named", lambda spec: lambda content: content.decode().split("\f"))
    assert main([*at, "--respect-exclude", "--enable-pdf", "--pdf-reader", "readers:pages", "--llm-model", "m", "--llm-context-window", "20000"], spark) == 0
    assert json.loads(capsys.readouterr().out)["written"] == 1
    rows = Store(spark, str(tmp_path / "s")).chunks.collect()
    assert {(r["note_slug"], r["file_type"], r["heading_path"]) for r in rows} == {("paper-pdf", "pdf", "m")}
    assert "first page of a paper" in rows[0]["text"] and "second page" in rows[-1]["text"]


def test_exact_searches_have_no_window(spark):
    from lodestone.operators import hybrid, vector
    from tests.test_retrieval import chunk, table

    rows = [chunk("hot", k, [1.0, 0.001 * k, 0.0]) for k in range(150)] + [chunk(f"n{k:03}", 0, [0.5, 1.0, 0.01 * k]) for k in range(130)]
    df = table(spark, rows)
    assert vector.semantic_search(df, [1.0, 0.0, 0.0], 10, 1).count() == 1  # the window is full of one note
    assert vector.semantic_search(df, [1.0, 0.0, 0.0], 120, 1, exact=True).count() == 120
    assert vector.multi_search(df, [[1.0, 0.0, 0.0]], ["q"], 10, 1).count() == 1
    assert vector.multi_search(df, [[1.0, 0.0, 0.0]], ["q"], 120, 1, exact=True).count() == 120
    links, aliases = spark.createDataFrame([("n000", "n001", "n001", "n001")], "source_slug string, target_slug string, target_path string, display_text string"), spark.createDataFrame([("n000", "n000"), ("n001", "n001")], "key string, note_slug string")
    assert hybrid.hidden(df, links, aliases, [1.0, 0.0, 0.0], "n000", 10).count() == 1
    assert hybrid.hidden(df, links, aliases, [1.0, 0.0, 0.0], "n000", 110, exact=True).count() == 110
    assert hybrid.hidden_deep(df, links, aliases, "n000", 110, 1, exact=True).count() == 110
    found = hybrid.boosted(df, links, aliases, [1.0, 0.0, 0.0], "n000", 9.0, 5, exact=True).collect()
    assert found[0]["note_slug"] == "n001" and found[0]["extra"] == "graph-boosted" and len(found) == 5


def test_converters():
    env = {"OPENAI_API_KEY": " 'k 1' ", "OLLAMA_HOST": "http://h:1/"}
    assert convert.converter("m", 20_000, env).name == "openai" and convert.converter("m", 20_000, env).key == "k1"
    made = convert.converter("ollama/x", 20_000, env)
    assert (made.url, made.model) == ("http://h:1/v1", "x")
    with pytest.raises(ValueError):
        convert.converter("m", 10, env)
    with pytest.raises(convert.NoKey):
        convert.converter("m", 20_000, {})


def test_retries():
    waited, answers = [], [urllib.error.HTTPError("u", 503, "", {"Retry-After": "7"}, None), urllib.error.URLError("x"), b"ok"]

    def call():
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    assert convert.with_retries(call, waited.append) == b"ok" and waited == [7.0, 4.0]
    answers[:] = [urllib.error.HTTPError("u", 404, "", {}, None)]
    with pytest.raises(RuntimeError):
        convert.with_retries(call, waited.append)
    assert convert.asked_delay("soon") is None
