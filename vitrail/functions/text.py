"""Text, markup and path columns.

Case is folded for A to Z only, everywhere. Null input gives null unless said otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The supported extensions.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "tif", "tiff")
# The classes of decode failures in order of precedence, and the phrases of which one is in the message; those joined by "&" must all be.
FAILURE_CLASSES = [
    ("invalid_jpeg", ("illegal start bytes", "format error decoding jpeg", "jpeg & format error")),
    ("truncated", ("unexpected eof", "unexpected end", "end of file", "truncated")),
    ("unsupported", ("unsupported",)),
    ("access", ("permission denied", "access is denied")),
]


def nocase(c: Column) -> Column:
    """The sort and compare key that ignores the case of A to Z."""
    return F.translate(c, _UPPER, _LOWER)


def fold(s: str) -> str:
    return s.translate(str.maketrans(_UPPER, _LOWER))


def contains_token(c: Column, token: str) -> Column:
    """Whether the text holds the token; % and _ have no meaning. False for null."""
    return F.coalesce(F.contains(nocase(c), F.lit(fold(token))), F.lit(False))


def matches_all_tokens(columns: list[Column], query: str) -> Column:
    """Every white-space token of the query is in at least one of the columns; an empty query matches nothing.

    Tokens shorter than three characters need no other path than longer ones: both are substrings.
    """
    tokens = query.split()
    if not tokens:
        return F.lit(False)
    return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [contains_token(c, t) for c in columns]) for t in tokens])


def like_pattern(token: str) -> str:
    """A LIKE pattern (escape character backslash) that finds the token literally."""
    return "%" + "".join("\\" + ch if ch in "\\%_" else ch for ch in token) + "%"


def phrase(token: str) -> str:
    """The token as a quoted phrase; quotes inside are doubled."""
    return '"' + token.replace('"', '""') + '"'


def collapse_space(c: Column) -> Column:
    """Runs of white space, that of all scripts, as one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_markup(c: Column) -> Column:
    """Tags removed, each closing bracket a space, five entities decoded (the ampersand first), white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"<[^>]*$", "")
    for entity, text in (("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">")):
        bare = F.replace(bare, F.lit(entity), F.lit(text))
    return collapse_space(bare)


def elements(c: Column, tag: str) -> Column:
    """Cleaned, non-empty contents of the elements of a tag, in order; the opening tag may have attributes or a longer name."""
    raw = F.regexp_extract_all(c, F.lit(rf"(?s)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))
    return F.filter(F.transform(raw, strip_markup), lambda x: x != "")


def attribute(c: Column, name: str) -> Column:
    """The first value of name="...", white space collapsed; null if there is none or it is empty."""
    value = collapse_space(F.regexp_extract(c, rf'{name}="([^"]*)"', 1))
    return F.when(value != "", value)


def dedup_keep_first(values: Column) -> Column:
    """The array without blank values and without later values that equal an earlier one but for case."""
    trimmed = F.filter(values, lambda x: F.trim(x) != "")
    keys = F.transform(trimmed, lambda x: nocase(F.trim(x)))
    return F.filter(trimmed, lambda x, i: F.array_position(keys, F.element_at(keys, i + 1)) == i + 1)


def packet_text(c: Column) -> tuple[Column, Column]:
    """(description, keywords) of an XMP packet in a text column."""
    one = lambda name: F.when(attribute(c, name).isNotNull(), F.array(attribute(c, name))).otherwise(F.array().cast("array<string>"))
    described = F.concat(elements(c, "dc:description"), elements(c, "dc:title"), elements(c, "photoshop:Headline"), one("xmp:Label"), one("photoshop:Headline"))
    keyed = F.concat(elements(c, "dc:subject"), elements(c, "photoshop:Keywords"))
    return F.array_join(dedup_keep_first(described), " | "), F.array_join(dedup_keep_first(keyed), ", ")


def tag_route(tag: Column) -> Column:
    """Where a metadata tag belongs: struct of the flags keywords and description."""
    t = nocase(tag)
    has = lambda *words: reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in words])
    return F.struct(has("keyword", "subject").alias("keywords"), has("description", "comment", "title", "caption").alias("description"))


# Paths


def file_name(path: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension(path: Column) -> Column:
    """What follows the last dot of the file name, unless that begins the name; else empty."""
    return F.regexp_extract(file_name(path), r"[^.].*\.([^.]*)$|^[^.]\.([^.]*)$", 1)


def is_supported_image(path: Column) -> Column:
    return nocase(F.regexp_extract(file_name(path), r".\.([^.]+)$", 1)).isin(*IMAGE_EXTENSIONS)


def key_native(path: Column, windows: bool = False) -> Column:
    """Slashes become backslashes; case is folded on Windows only."""
    key = F.translate(path, "/", "\\")
    return nocase(key) if windows else key


def key_folded_trimmed(path: Column) -> Column:
    """Slashes become backslashes, case is folded, separators at the end go."""
    return F.regexp_replace(nocase(F.translate(path, "/", "\\")), r"\\+$", "")


def key_forward(path: Column) -> Column:
    """Backslashes become slashes and case is folded."""
    return nocase(F.translate(path, "\\", "/"))


def with_separator(root: Column, separator: str = "\\") -> Column:
    return F.when(F.substring(root, -1, 1).isin("/", "\\"), root).otherwise(F.concat(root, F.lit(separator)))


def relative_to(path: Column, root: Column, separator: str = "\\") -> Column:
    """The path without its root; empty for the root itself; null if it isn't below the root."""
    prefix = with_separator(root, separator)
    return F.when(path == root, F.lit("")).when(F.startswith(path, prefix), F.substr(path, F.length(prefix) + 1))


def absolute_from(relative: Column, root: Column, separator: str = "\\") -> Column:
    return F.when(relative == "", root).otherwise(F.concat(with_separator(root, separator), relative))


def is_safe_relative(path: Column) -> Column:
    """Neither absolute, nor with a drive, nor with a step to a parent folder."""
    parts = F.split(path, r"[\\/]")
    return ~(F.rlike(path, F.lit(r"^[\\/]")) | F.rlike(path, F.lit(r"^[A-Za-z]:")) | F.array_contains(parts, ".."))


def is_internal(relative: Column, index_folder: str) -> Column:
    """Whether the path lies in the index folder of its library."""
    return F.coalesce(F.element_at(F.split(relative, r"[\\/]"), 1) == index_folder, F.lit(False))


def folders_above(path: Column) -> Column:
    """All folders above a path, and the path itself, as written, longest last."""
    cuts = F.filter(F.sequence(F.lit(1), F.length(path)), lambda i: F.substr(path, i, F.lit(1)).isin("/", "\\"))
    return F.when(path.isNotNull() & (path != ""), F.array_distinct(F.concat(F.transform(cuts, lambda i: F.substr(path, F.lit(1), i - 1)), F.array(path))))


# Reports


def report_key(c: Column) -> Column:
    """A name with anything but letters, digits, dot, dash and underscore made an underscore."""
    return F.regexp_replace(nocase(c), r"[^a-z0-9._-]", "_")


def one_line(c: Column) -> Column:
    return F.regexp_replace(c, r"[\r\n\t]+", " ")


def format_bytes(c: Column) -> Column:
    """With one digit, half to even, in the largest unit that fits."""
    n = c.cast("double")
    shown = lambda power, unit: F.format_string(f"%.1f {unit}", F.bround(n / (1 << power), 1))
    return (
        F.when(n >= 1 << 30, shown(30, "GB"))
        .when(n >= 1 << 20, shown(20, "MB"))
        .when(n >= 1 << 10, shown(10, "KB"))
        .otherwise(F.concat(n.cast("bigint").cast("string"), F.lit(" B")))
    )


def format_day(epoch_seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch_seconds), "yyyy-MM-dd HH:mm")


def truncate_middle(c: Column, most: int) -> Column:
    """At most ``most`` characters, with an ellipsis for the middle of longer texts."""
    head = (most - 1) // 2
    tail = most - 1 - head
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, head), F.lit("…"), F.right(c, F.lit(tail))))


def failure_class(message: Column) -> Column:
    """The class of a decode failure, by what its message contains."""
    m = nocase(message)
    has = lambda phrase: reduce(lambda a, b: a & b, [F.contains(m, F.lit(p)) for p in phrase.split(" & ")])
    out = F.lit("other")
    for name, phrases in reversed(FAILURE_CLASSES):
        out = F.when(reduce(lambda a, b: a | b, [has(p) for p in phrases]), F.lit(name)).otherwise(out)
    return out
