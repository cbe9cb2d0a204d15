"""Row filters that searches share, and the filters of their results."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conjunction(*parts: Column | None) -> Column | None:
    """AND of those that are given; None for none."""
    given = [p for p in parts if p is not None]
    return reduce(lambda a, b: a & b, given) if given else None


def tagged(tag: str) -> Column:
    return F.array_contains("tags", tag)


@dataclass(frozen=True)
class SearchFilter:
    """Which chunks a search looks at; it is applied before ranking. Null columns fail a condition."""

    section: str | None = None
    has_task: bool = False
    has_code: bool = False
    include_pdf: bool = False
    tag: str | None = None
    exclude: tuple[str, ...] = ()

    def column(self) -> Column | None:
        return conjunction(
            F.col("heading_path") == self.section if self.section else None,
            F.col("has_task") if self.has_task else None,
            F.col("has_code") if self.has_code else None,
            F.col("file_type") == "md" if not self.include_pdf else None,
            tagged(self.tag) if self.tag else None,
            ~F.col("note_slug").isin(*self.exclude) if self.exclude else None,
        )


def present(results: DataFrame, min_score: float | None = None, phantoms: bool = False, mask: tuple[str, ...] = ()) -> DataFrame:
    """Results as shown: weak ones and phantoms off, scores to four decimals, masked columns null.

    Scores are compared before rounding; keyword hits have no score and stay.
    """
    kept = results
    if min_score is not None:
        kept = kept.where((F.col("score") >= min_score) | F.coalesce("lexical", F.lit(False)) if "lexical" in results.columns else F.col("score") >= min_score)
    if not phantoms and "is_phantom" in results.columns:
        kept = kept.where(~F.coalesce("is_phantom", F.lit(False)))
    types = dict(results.dtypes)
    return kept.withColumns({"score": F.round("score", 4)} | {c: F.lit(None).cast(types[c]) for c in mask})
