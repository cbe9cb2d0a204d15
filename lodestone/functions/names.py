"""Names of notes as links and slugs write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The endings of attachments.
ATTACHMENTS = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".mp4", ".m4a", ".canvas", ".zip", ".docx", ".xlsx")


def note_name(raw: Column) -> Column:
    """The note that a raw link target or slug names; null for nulls, blanks and attachments.

    Anchor and alias go, then the folders, outer spaces, case and ``.md``; ``.pdf`` becomes
    ``-pdf``; runs of spaces become one hyphen.
    """
    # Plain string functions, as this runs over every reference; the lambda names the bare text, which is then made once.
    bare = F.lower(F.trim(F.substring_index(F.substring_index(F.substring_index(raw, "#", 1), "|", 1), "/", -1)))
    return F.get(F.transform(F.array(bare), _slug), F.lit(0))


def note_names(raws: Column) -> Column:
    """The names in an array of raw targets, without nulls; exploded, they need no filter that would make them twice."""
    return F.filter(F.transform(raws, note_name), lambda n: n.isNotNull())


def _slug(bare: Column) -> Column:
    ending = F.concat(F.lit("."), F.substring_index(bare, ".", -1))
    attached = F.contains(bare, F.lit(".")) & ending.isin(*ATTACHMENTS)
    slug = F.when(F.endswith(bare, F.lit(".md")), F.left(bare, F.length(bare) - 3)).when(F.endswith(bare, F.lit(".pdf")), F.concat(F.left(bare, F.length(bare) - 4), F.lit("-pdf"))).otherwise(bare)
    joined = F.regexp_replace(slug, " +", "-")
    return F.when(~attached & (slug != ""), joined)
