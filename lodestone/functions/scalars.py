"""Scalar functions as columns: slugs, titles, attachments, hashes, token estimates, output escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of files that are attachments, not notes; first those of images.
IMAGES = [
    "png",
    "jpg",
    "jpeg",
    "gif",
    "svg",
    "webp",
    "avif",
    "bmp",
    "tiff",
    "ico",
    "heic",
]
OTHER_FILES = [
    "mp4",
    "webm",
    "mov",
    "mkv",
    "avi",
    "mp3",
    "wav",
    "ogg",
    "flac",
    "m4a",
    "aac",
    "canvas",
    "excalidraw",
    "zip",
    "gz",
    "tar",
    "7z",
    "rar",
    "docx",
    "pptx",
    "xlsx",
    "epub",
]
# The version of the chunk layout and the length from which a title may be cut off a heading.
SCHEMA_VERSION = 5
LEAST_TITLE = 12


def slugify(c: Column) -> Column:
    """Lower case, ``.md`` off, ``.pdf`` to ``-pdf``, spaces to hyphens, all but letters, digits and hyphens off."""
    low = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    low = F.regexp_replace(F.regexp_replace(low, r"\.md\z", ""), r"\.pdf\z", "-pdf")
    kept = F.regexp_replace(F.regexp_replace(low, " ", "-"), r"[^\p{L}\p{N}\-]+", "")
    return F.regexp_replace(F.regexp_replace(kept, "-+", "-"), "^-|-$", "")


def basename(path: Column) -> Column:
    return F.regexp_replace(path, r"(?s)^.*/", "")


def title_from_path(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?i)\.(md|pdf)\z", "")


def without_anchor(link: Column) -> Column:
    """The target of a raw link without alias and anchor."""
    return F.trim(F.regexp_replace(link, r"(?s)[#|].*$", ""))


def extension(link: Column) -> Column:
    return F.lower(F.regexp_extract(without_anchor(link), r"\.([A-Za-z0-9]+)\z", 1))


def is_attachment(link: Column) -> Column:
    return extension(link).isin(*IMAGES, *OTHER_FILES)


def attachment_kind(link: Column) -> Column:
    """``image``, ``attachment``, or null for notes."""
    return F.when(extension(link).isin(*IMAGES), "image").when(is_attachment(link), "attachment")


def is_numeric_size(c: Column) -> Column:
    """Whether an embed's alias is a size such as ``300`` or ``300x200``."""
    return F.trim(c).rlike("^[0-9xX]*[0-9][0-9xX]*$")


def content_hash(content: Column, size: int, overlap: int, model: str) -> Column:
    """SHA-256 of the content and of everything that changes how it is cut and embedded."""
    suffix = f"\0schema={SCHEMA_VERSION}\0size={size}\0overlap={overlap}\0model={model}\0"
    return F.sha2(F.concat(F.encode(content, "utf-8"), F.encode(F.lit(suffix), "utf-8")), 256)


def estimated_tokens(c: Column) -> Column:
    return F.ceil(F.length(c) / 4)


def is_code_only(c: Column) -> Column:
    """Whether a chunk's plain text is nothing but what stands for blocks of code: ``[code]`` or ``[code:language]``."""
    return F.regexp_replace(c, r"^\s+|\s+$", "").rlike(r"^(\[code(:[^\]]+)?\]\s*)+$")


def word_count(c: Column) -> Column:
    """Words between white space; 0 for blank texts."""
    bare = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"\s+")))


def query_tokens(text: Column) -> Column:
    """The distinct words of a query: runs of a-z and 0-9, two characters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: F.length(t) >= 2))


def embed_text(title: Column, heading: Column, tags: Column, body: Column, budget: int) -> Column:
    """What is embedded for a chunk: ``title > heading``, a line of tags, a blank line, the body.

    What does not fit into ``budget`` tokens less the body's and two is left out: the tags first, then the heading, then
    all. A chunk without heading has its title as heading.
    """
    room = F.lit(budget) - estimated_tokens(body) - 2
    section = F.when(F.coalesce(heading, F.lit("")) == "", title).otherwise(F.concat(title, F.lit(" > "), heading))
    tagged = F.when(F.size(tags) > 0, F.concat(section, F.lit("\n[tags: "), F.array_join(tags, ", "), F.lit("]"))).otherwise(section)
    fits = lambda c: estimated_tokens(c) <= room
    head = F.when(fits(tagged), tagged).when(fits(section), section).when(fits(title), title)
    return F.when(head.isNull() | (head == ""), body).otherwise(F.concat(head, F.lit("\n\n"), body))


def trimmed_heading(title: Column, heading: Column) -> Column:
    """A heading path without its first part, if that repeats the title (or begins it, or is begun by it)."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    first = F.element_at(F.split(heading, " > "), 1)
    a, b = plain(title), plain(first)
    same = (F.least(F.length(a), F.length(b)) >= LEAST_TITLE) & (F.startswith(a, b) | F.startswith(b, a))
    rest = F.array_join(F.slice(F.split(heading, " > "), F.lit(2), F.size(F.split(heading, " > "))), " > ")
    return F.when((F.length(a) > 0) & ((a == b) | same), rest).otherwise(heading)


def deep_label(heading: Column, title: Column, index: Column) -> Column:
    """The name of a chunk as a query of a deep search."""
    h, t = F.trim(F.coalesce(heading, F.lit(""))), F.trim(F.coalesce(title, F.lit("")))
    return F.when(h != "", F.concat(F.lit("§ "), trimmed_heading(t, h))).when((index == 0) & (t != ""), F.concat(F.lit("§ "), t)).when(index == 0, "§ (intro)").otherwise(F.concat(F.lit("chunk #"), (index + 1).cast("string")))


def tsv_escape(c: Column) -> Column:
    """Backslash, tab, line feed and carriage return escaped; null is empty."""
    for raw, shown in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(raw), F.lit(shown))
    return F.coalesce(c, F.lit(""))


def score_band(score: Column) -> Column:
    return F.when(score >= 0.75, "high").when(score >= 0.5, "medium").otherwise("low")


def tag_chips(tags: Column) -> Column:
    return F.array_join(F.transform(tags, lambda t: F.concat(F.lit("#"), t)), " ")


def open_uri(scheme: str, vault: str, path: Column) -> Column:
    """A link that opens a note in its application; percent-encoded, spaces as %20."""
    quoted = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit(f"{scheme}://open?vault="), quoted(F.lit(vault)), F.lit("&file="), quoted(path))


def normal_tag(tag: str) -> str:
    """A tag as typed, without its ``#`` and outer blanks, in lower case."""
    return tag.strip().removeprefix("#").lower()
