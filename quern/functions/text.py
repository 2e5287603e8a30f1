"""Text functions as column expressions; none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ELLIPSIS = "..."
#: Least characters to embed, most to embed, length of a semantic snippet, least letters of real text.
MIN_EMBED, MAX_EMBED, SNIPPET, LEAST_LETTERS = 50, 8000, 200, 20
#: Fixed patterns: bold headings, image links, inline tags.
BOLD_HEADING, IMAGE_LINK, INLINE_TAG = r"(?m)^(#{1,6}\s+)\*\*(.+?)\*\*\s*$", r"!\[[^\]]*\]\([^)]*\)", r"</?[a-zA-Z][a-zA-Z0-9]*(\s[^<>]*)?/?>"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normal_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def clip_words(c: Column, most: int) -> Column:
    """At most `most` characters: cut at the last space if that lies beyond the middle, and end in an ellipsis."""
    if most <= len(ELLIPSIS):
        return F.when(F.length(c) <= most, c).otherwise(F.substring(c, 1, most))
    room = most - len(ELLIPSIS)
    cut = F.substring(c, 1, room)
    back = F.instr(F.reverse(cut), " ")  # 1-based from the end, 0 if there is none
    last = F.lit(room) - back
    kept = F.when((back > 0) & (last > room / 2), F.substring(cut, F.lit(1), last)).otherwise(cut)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.regexp_replace(kept, r"\s+$", ""), F.lit(ELLIPSIS)))


def semantic_snippet(c: Column, most: int | None = None) -> Column:
    """One line of SNIPPET characters, or the raw content clipped to `most`."""
    return clip_words(c, most) if most else clip_words(F.translate(c, "\n", " "), SNIPPET)


def unbold_headings(c: Column) -> Column:
    return F.regexp_replace(c, BOLD_HEADING, "$1$2")


def strip_images(c: Column) -> Column:
    return F.regexp_replace(c, IMAGE_LINK, "")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, INLINE_TAG, "")


def has_text(c: Column) -> Column:
    """Whether enough letters and digits are left without image links."""
    return F.length(F.regexp_replace(strip_images(c), r"[^\p{L}\p{N}_]", "")) >= LEAST_LETTERS


def fold(c: Column) -> Column:
    """Lower case without diacritics; a text of one byte a character has none."""
    low = F.lower(c)
    return F.when(F.length(c) == F.octet_length(c), low).otherwise(F.call_function("java_method", F.lit("org.apache.commons.lang3.StringUtils"), F.lit("stripAccents"), low))


def tokens(c: Column) -> Column:
    """Runs of letters and digits, folded."""
    return F.array_remove(F.split(fold(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def iso_time(ns: Column) -> Column:
    """Epoch nanoseconds as an ISO-8601 string in UTC; null where unknown or marked for retry."""
    return F.when(ns >= 0, F.date_format(F.timestamp_seconds((ns - ns % 1_000_000_000) / 1_000_000_000), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))


def iso_now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def embed_text(heading: Column, content: Column, previous: Column, overlap: int) -> Column:
    """What is embedded for a chunk: the end of the previous chunk, the heading, the content, cut to MAX_EMBED."""
    body = content
    if overlap > 0:
        has = F.length(F.coalesce(previous, F.lit(""))) > 0
        body = F.when(has, F.concat(F.lit("..."), F.right(previous, F.lit(overlap)), F.lit("\n\n"), content)).otherwise(content)
    full = F.when(F.length(F.coalesce(heading, F.lit(""))) > 0, F.concat(heading, F.lit(": "), body)).otherwise(body)
    return F.substring(full, 1, MAX_EMBED)


def suffix(path: Column) -> Column:
    """Lower-case suffix of the last path component, with its dot."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def data_url(content: Column, mime: Column) -> Column:
    # base64 here breaks lines; a URL has none
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def query_terms(q: Column) -> Column:
    """Words of a query without operators and excluded words."""
    kept = F.filter(F.split(q, r"\s+"), lambda w: ~w.isin("AND", "OR", "NOT", "NEAR") & ~w.startswith("-"))
    return F.flatten(F.transform(kept, lambda w: F.regexp_extract_all(w, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))))


def has_operators(q: Column) -> Column:
    return F.arrays_overlap(F.split(q, r"\s+"), F.array(*[F.lit(x) for x in ("AND", "OR", "NOT", "NEAR")]))


def int_or(c: Column, default: int) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(default))
