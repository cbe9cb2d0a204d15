"""The retrieval interface over a store: one method for each question."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import filters, graph, hybrid, lexical, notes, tags, vector
from lodestone.operators.index import VectorIndex
from lodestone.operators.ingest import Embedder
from lodestone.sources.store import Store


def distinct_queries(queries: Sequence[str]) -> list[str]:
    """Queries without outer blanks, blank ones and repeats, in their order."""
    return [q for q in dict.fromkeys(q.strip() for q in queries) if q]


class Engine:
    """Answers questions about the notes of a store. Results are DataFrames, bounded by their limits where they have one."""

    def __init__(self, store: Store, embedder: Embedder, exact: bool = False):
        """``exact`` searches rank all chunks and have no limit of 100 rows. Others take the store's index for single queries, if it has one of its current state."""
        self.store, self.embedder, self.exact = store, embedder, exact
        self._at: str | None = None
        self.index: VectorIndex | None = None

    def _read(self) -> None:
        at = self.store.snapshot
        if at is None or at != self._at:
            self._at, self.chunks, self.links = at, self.store.chunks, self.store.links
            self.notes = notes.headers(self.chunks)
            self.aliases = graph.alias_table(self.notes)
            self.index = VectorIndex(self.store.spark, self.store.index_path) if at and self.store.has_index() else None

    def build_index(self, dim: int) -> int:
        """Index the store's current vectors; how many cells a search reads of how many."""
        self._read()
        self.index = VectorIndex.build(self.chunks, self.store.index_path, dim)
        return self.index.reads

    def vectors(self, texts: Sequence[str]) -> list[list[float]]:
        return [[float(x) for x in v] for v in self.embedder.embed([t or " " for t in texts])]

    def resolve(self, name: str) -> str:
        self._read()
        return notes.resolve_name(self.notes, name)

    def excluded(self, names: Sequence[str]) -> tuple[list[str], list[str]]:
        """The slugs that names mean, and the names that no note has. Ambiguous names raise LookupError."""
        self._read()
        wanted = [n for n in dict.fromkeys(p.strip() for name in names for p in name.split(",")) if n]
        if not wanted:
            return [], []
        rows = {r["input"]: r for r in notes.resolve_names(self.notes, self.store.spark.createDataFrame([(n,) for n in wanted], "input string")).collect()}
        for n in wanted:
            if rows[n]["status"] == "ambiguous":
                raise LookupError(f"{n!r} is ambiguous: {notes.candidates_of(self.notes, n)}")
        return list(dict.fromkeys(rows[n]["note_slug"] or n for n in wanted)), [n for n in wanted if rows[n]["status"] == "missing"]

    def search(self, queries: Sequence[str], limit: int = 10, per_note: int = 3, where: filters.SearchFilter | None = None, min_score: float = 0.0, context: int = 0, exclude: Sequence[str] = ()) -> DataFrame:
        """Similar chunks; keyword hits where nothing similar is found. Without queries, the notes of the filter's tag.

        Queries are trimmed, blank and repeated ones dropped. ``context`` adds the texts of so many chunks on either side.
        """
        self._read()
        asked = distinct_queries(queries)
        where = where or filters.SearchFilter()
        slugs, _ = self.excluded(exclude)
        if slugs:
            where = filters.SearchFilter(**{**where.__dict__, "exclude": (*where.exclude, *slugs)})
        if not asked:
            if not where.tag:
                raise ValueError("a query or a tag is needed")
            return tags.tag_search(self.chunks, where.tag, limit, where=where.column())
        vecs = self.vectors(asked)
        if len(asked) == 1:
            if self.index is not None and not self.exact:
                found = self.index.search(vecs[0], limit, per_note, where.column())
            else:
                found = vector.semantic_search(self.chunks, vecs[0], limit, per_note, where.column(), self.exact)
            found = found.withColumn("matched_queries", F.when(F.col("score") > 0, F.array(F.lit(asked[0]))))
        else:
            found = vector.multi_search(self.chunks, vecs, asked, limit, per_note, where.column(), self.exact)
        if lexical.needs_fallback(found, min_score):
            return lexical.lexical_search(self.chunks, " ".join(asked), limit, where.column())
        return notes.with_context(found, self.chunks, context) if context > 0 else found

    def tag_search(self, tag: str, limit: int = 50, children: bool = False) -> DataFrame:
        self._read()
        return tags.tag_search(self.chunks, tag, limit or 50, children)

    def shared_tags(self, name: str, least: int = 1) -> DataFrame:
        return tags.shared_tags(self.headers(), self.resolve(name), least)

    def list_tags(self, limit: int | None = None) -> DataFrame:
        return tags.list_tags(self.headers(), limit)

    def suggest_tags(self, tag: str, limit: int = 3) -> DataFrame:
        return tags.suggest_tags(self.headers(), tag, limit)

    def headers(self) -> DataFrame:
        self._read()
        return self.notes

    def backlinks(self, name: str) -> DataFrame:
        slug = self.resolve(name)
        return graph.backlinks(self.links, self.aliases, self.notes, slug)

    def connections(self, name: str, hops: int = 2) -> DataFrame:
        slug = self.resolve(name)
        return graph.connections(self.links, self.aliases, self.notes, slug, hops)

    def hidden(self, name: str, limit: int = 10, include_linked: bool = False, deep: bool = False, per_note: int = 3) -> DataFrame:
        """Similar notes without a link: to the name as a query, or (``deep``) to each chunk of the note."""
        slug = self.resolve(name)
        if deep:
            return hybrid.hidden_deep(self.chunks, self.links, self.aliases, slug, limit, per_note, include_linked, self.exact)
        return hybrid.hidden(self.chunks, self.links, self.aliases, self.vectors([name])[0], slug, limit, include_linked, self.exact)

    def boosted(self, query: str, seed: str, boost: float = 1.5, limit: int = 10) -> DataFrame:
        slug = self.resolve(seed)
        return hybrid.boosted(self.chunks, self.links, self.aliases, self.vectors([query])[0], slug, boost, limit, exact=self.exact)

    def get(self, name: str, head: int | None = None) -> DataFrame:
        slug = self.resolve(name)
        return notes.get_note(self.chunks, slug, head)

    def content(self, name: str, head: int | None = None, meta: bool = False) -> dict[str, Any]:
        """One note with its text, or its beginning, or (``meta``) without."""
        slug = self.resolve(name)
        row = (self.meta(slug) if meta else notes.get_note(self.chunks, slug, head)).first()
        if row is None:
            raise LookupError(f"{name!r} names no note")
        found = row.asDict()
        tags = self.chunks.where((F.col("note_slug") == slug) & (F.col("chunk_index") == 0)).select("tags").first() if meta else None
        return {"note_slug": slug, "title": found["title"], "file_path": found["file_path"], "tags": tags[0] if tags else found.get("tags"), "text": "" if meta else found["content"], "chunks": found["n_chunks"] if meta else found["total"]}

    def meta(self, name: str) -> DataFrame:
        slug = self.resolve(name)
        return notes.note_meta(self.chunks.where(F.col("note_slug") == slug))

    def slugs(self) -> DataFrame:
        return notes.slugs(self.headers())

    def stats(self) -> DataFrame:
        self._read()
        return notes.stats(self.chunks, self.links)
