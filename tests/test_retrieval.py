from __future__ import annotations

import pytest

from lodestone.operators import filters, graph, hybrid, lexical, notes, tags, vector
from lodestone.plans import retrieval
from lodestone.sources.store import CHUNKS

LINK = "source_slug string, raw string"


def chunk(slug, k, vec, **more):
    base = {"id": f"{slug}:{k}", "note_slug": slug, "title": slug.title(), "file_path": f"{slug}.md", "chunk_index": k, "heading_path": "", "heading_level": 0, "has_task": False, "has_code": False, "file_type": "md", "content_hash": "h", "tags": [], "text": f"text {k}", "embedding": vec}
    return base | more


def table(spark, rows):
    names = [f.split()[0] for f in CHUNKS.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], CHUNKS)


@pytest.fixture(scope="module")
def world(spark):
    chunks = table(spark, [
        chunk("note-a", 0, [1.0, 0.0, 0.0], tags=["go", "vector"]), chunk("note-a", 1, [0.9, 0.1, 0.0], heading_path="Intro > Part", heading_level=2),
        chunk("note-b", 0, [0.0, 1.0, 0.0], tags=["go"]), chunk("note-c", 0, [0.9, 0.0, 0.0], tags=["go/tools"]),
        chunk("note-d", 0, None), chunk("note-e", 0, [0.0, 0.0, 0.0]), chunk("note-f", 0, [1.0, 0.0]),
    ])
    heads = notes.headers(chunks)
    aliases = graph.alias_table(heads)
    raw = spark.createDataFrame([("note-a", "Note-B#part"), ("note-a", "note-b|alias"), ("note-a", "Missing Note"), ("note-a", "pic.png"), ("note-b", None), ("note-b", " "), ("note-x", "note-a")], LINK)
    return chunks, graph.resolve_links(raw, aliases), aliases, heads


def test_semantic_cap_and_unusable_vectors(world):
    got = vector.semantic_search(world[0], [1.0, 0.0, 0.0], 10, 1).collect()
    assert [r["id"] for r in got] == ["note-a:0", "note-c:0", "note-b:0"]
    assert [round(r["score"], 6) for r in got] == [1.0, 1.0, 0.0]


def test_multi_query_prefers_more_queries(spark):
    chunks = table(spark, [chunk("a", 0, [1.0, 0.0, 0.0]), chunk("b", 0, [0.0, 1.0, 0.0]), chunk("c", 0, [0.707, 0.707, 0.0])])
    got = vector.multi_search(chunks, [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]], ["x", "y"]).collect()
    best = max(got, key=lambda r: (r["n_queries"], r["score"]))
    assert best["note_slug"] == "c" and sorted(best["matched_queries"]) == ["x", "y"]


def test_weak_query_is_not_named(spark):
    chunks = table(spark, [chunk("x", 0, [1.0, 0.0, 0.0])])
    got = vector.multi_search(chunks, [[1.0, 0.0, 0.0], [0.4, 0.9165, 0.0]], ["p", "q"]).first()
    assert got["matched_queries"] == ["p"] and got["n_queries"] == 2


def test_filters(world):
    where = filters.SearchFilter(section="Intro > Part").column()
    assert [r["id"] for r in vector.semantic_search(world[0], [1.0, 0.0, 0.0], where=where).collect()] == ["note-a:1"]
    assert filters.conjunction(None, None) is None
    shown = filters.present(vector.semantic_search(world[0], [1.0, 0.1, 0.0]), 0.5, mask=("text",)).collect()
    assert all(r["text"] is None and r["score"] == round(r["score"], 4) >= 0.5 for r in shown)


def test_lexical(world):
    got = lexical.lexical_search(world[0], "Vector NOTE-A ! x").collect()
    assert [(r["note_slug"], r["hits"]) for r in got][0] == ("note-a", 4)
    assert lexical.lexical_search(world[0], "? !").count() == 0


def test_tags(world):
    chunks, heads = world[0], world[3]
    assert [r["note_slug"] for r in tags.tag_search(chunks, "#Go").collect()] == ["note-a", "note-b"]
    assert [r["note_slug"] for r in tags.tag_search(chunks, "go", children=True).collect()] == ["note-a", "note-b", "note-c"]
    assert [(r["tag"], r["count"]) for r in tags.list_tags(heads).collect()] == [("go", 2), ("go/tools", 1), ("vector", 1)]
    assert [r["tag"] for r in tags.suggest_tags(heads, "goo").collect()][0] == "go"
    assert [(r["note_slug"], r["score"]) for r in tags.shared_tags(heads, "note-a").collect()] == [("note-b", 1)]


def test_links_and_graph(world):
    chunks, links, aliases, heads = world
    assert {(r["source_slug"], r["target_slug"]) for r in links.collect()} == {("note-a", "note-b"), ("note-a", "missing-note"), ("note-x", "note-a")}
    back = graph.backlinks(links, aliases, heads, "note-b").collect()
    assert [(r["note_slug"], r["is_phantom"]) for r in back] == [("note-a", False)]
    near = {(r["note_slug"], r["score"], r["is_phantom"]) for r in graph.connections(links, aliases, heads, "note-b", 2).collect()}
    assert near == {("note-a", 1, False), ("missing-note", 2, True), ("note-x", 2, True)}
    assert {r[0] for r in graph.linked_slugs(links, aliases, "note-a").collect()} == {"note-b", "missing-note", "note-x"}


def test_alias_collision_goes_to_the_smallest_slug(spark):
    chunks = table(spark, [chunk("b", 0, None, title="Same"), chunk("a", 0, None, title="Same"), chunk("same", 0, None, title="Other")])
    got = {r["key"]: r["note_slug"] for r in graph.alias_table(chunks).collect()}
    assert got["Same"] == "a" and got["same"] == "same"


def test_hybrid(world):
    chunks, links, aliases, _ = world
    found = [r["note_slug"] for r in hybrid.hidden(chunks, links, aliases, [1.0, 0.0, 0.0], "note-a").collect()]
    assert found == ["note-c"]
    assert {r["note_slug"] for r in hybrid.hidden(chunks, links, aliases, [1.0, 0.0, 0.0], "note-a", include_linked=True).collect()} == {"note-b", "note-c"}
    assert [r["note_slug"] for r in hybrid.hidden_deep(chunks, links, aliases, "note-a").collect()] == ["note-c"]
    up = {r["note_slug"]: r["extra"] for r in hybrid.boosted(chunks, links, aliases, [0.5, 0.5, 0.0], "note-a").collect()}
    assert up["note-b"] == "graph-boosted" and up["note-c"] is None
    with pytest.raises(LookupError):
        hybrid.deep_queries(chunks, "nobody")


def test_reconstruction_writes_changed_headings(spark):
    chunks = table(spark, [chunk("n", 0, None, text="pre"), chunk("n", 1, None, heading_path="A > B", heading_level=2, text="one"), chunk("n", 2, None, heading_path="A > C", heading_level=2, text="two"), chunk("n", 3, None, heading_path="A > C", heading_level=2, text="three")])
    assert notes.note_texts(chunks).first()["content"] == "pre\n\n# A\n\n## B\n\none\n\n## C\n\ntwo\n\nthree"
    assert (notes.get_note(chunks, "n", 2).first()["total"], notes.note_meta(chunks).first()["n_chunks"]) == (4, 4)
    around = notes.with_context(chunks.where("chunk_index = 1"), chunks, 1).first()
    assert around["context"] == ["pre", "two"]


def test_names(spark):
    heads = table(spark, [chunk("alpha", 0, None, title="Alpha", file_path="x/Alpha.md"), chunk("beta", 0, None, title="Twin"), chunk("gamma-beta", 0, None, title="Twin", file_path="y/g.md")])
    assert notes.resolve_name(heads, " alpha ") == "alpha"
    assert notes.resolve_name(heads, "Alpha.md") == "alpha"
    assert notes.resolve_name(heads, "y/g") == "gamma-beta"
    assert notes.resolve_name(heads, "") == ""
    for bad in ("twin", "nothing"):
        with pytest.raises(LookupError):
            notes.resolve_name(heads, bad)


def test_group_by_note(spark):
    rows = spark.createDataFrame([(0, "a", 0.5), (1, "b", 0.6), (2, "a", 0.8)], "position int, note_slug string, score double")
    assert [(r["note_slug"], r["score"], r["extra"]) for r in notes.group_by_note(rows).collect()] == [("a", 0.8, "2 matching chunks"), ("b", 0.6, None)]


def test_stats_without_first_chunks(spark):
    links = spark.createDataFrame([], "a string")
    assert tuple(notes.stats(table(spark, [chunk("a", 1, None), chunk("b", 2, None)]), links).first()) == (2, 2, 0)
    assert tuple(notes.stats(table(spark, []), links).first()) == (0, 0, 0)


def test_tag_children_gives_all_notes(spark, tmp_path):
    rows = spark.range(10_050).selectExpr("concat('n', id, ':0') AS id", "concat('n', id) AS note_slug", "0 AS chunk_index", "'t' AS title", "array('project/x') AS tags", "timestamp'2024-01-01' AS ingested_at")
    rows.write.parquet(f"{tmp_path}/chunks.parquet")
    assert retrieval.tag_children(spark, str(tmp_path)).count() == 10_050
