"""Line and text normalisation as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip/str.split treat as whitespace, and the line
# boundaries of str.splitlines, as regular-expression classes Java and RE2 both read.
WHITESPACE = (
    r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
LINE_BREAK = r"\r\n|[\x{0A}-\x{0D}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"

# Markers and replacements of the listing and module normalisers.
IDENT_MARKERS = (".ident", "clang version")
FILE_MARKER, FILE_LINE = ".file", '.file   "-"'
MODULE_MARKER, MODULE_LINE = "; ModuleID", "; ModuleID = '<stdin>'"
SOURCE_MARKER, SOURCE_LINE = "source_filename", 'source_filename = "-"'
COMMENT = "#"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once.

    Inside higher-order functions Spark evaluates a repeated expression as often as it is
    written; a lambda variable is evaluated once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def newline_split(text: Column) -> Column:
    """Split on newline only, keeping trailing empty lines."""
    return F.split(text, "\n", -1)


def split_lines(text: Column) -> Column:
    """Split at every line boundary; a final boundary starts no new line."""

    def cut(parts: Column) -> Column:
        last_is_empty = F.element_at(parts, -1) == ""
        return F.when(last_is_empty, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)

    return let(F.split(text, LINE_BREAK, -1), cut)


def strip(text: Column) -> Column:
    """Remove whitespace of any kind at both ends."""
    return F.regexp_replace(text, f"^{WHITESPACE}+|{WHITESPACE}+\\z", "")


def squeeze(text: Column) -> Column:
    """Collapse every whitespace run to one space and strip the ends."""
    return F.trim(F.regexp_replace(text, f"{WHITESPACE}+", " "))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def normalize_listing(
    text: Column, remove_comments: bool = False, comment_character: str = COMMENT
) -> Column:
    """Drop the compiler ident line, neutralise file lines, optionally cut comments.

    The comment character only decides whether a line is cut; the cut is always at ``#``.
    A line that is only a comment stays as an empty line.
    """

    def rewrite(line: Column) -> Column:
        out = F.when(line.contains(FILE_MARKER), F.lit(FILE_LINE))
        if remove_comments:
            cut = strip(F.split_part(line, F.lit(COMMENT), F.lit(1)))
            out = out.when(line.contains(comment_character), cut)
        return out.otherwise(line)

    def kept(line: Column) -> Column:
        return ~(line.contains(IDENT_MARKERS[0]) & line.contains(IDENT_MARKERS[1]))

    return F.array_join(F.transform(F.filter(newline_split(text), kept), rewrite), "\n")


def normalize_module(text: Column) -> Column:
    """Replace the module-id and source-file header lines of compiler IR by neutral ones."""

    def rewrite(line: Column) -> Column:
        return (
            F.when(line.contains(MODULE_MARKER), F.lit(MODULE_LINE))
            .when(line.contains(SOURCE_MARKER), F.lit(SOURCE_LINE))
            .otherwise(line)
        )

    return F.array_join(F.transform(newline_split(text), rewrite), "\n")


def path_from_component(path: Column, name: str) -> Column:
    """The path from its first component containing ``name``; the whole path if none does."""
    parts = F.split(path, "/", -1)
    hit = F.transform(parts, lambda c: c.contains(name))
    first = F.greatest(F.array_position(hit, True), F.lit(1)).cast("int")
    return F.array_join(F.slice(parts, first, F.size(parts)), "/")


def drop_suffix(text: Column, suffix: str) -> Column:
    """Remove ``suffix`` once, and only as a whole suffix."""
    return F.when(
        text.endswith(suffix), F.left(text, F.length(text) - F.lit(len(suffix)))
    ).otherwise(text)


def preview(text: Column, width: int = 50) -> Column:
    """At most ``width`` characters, followed by dots when something was cut."""
    return F.when(
        F.length(text) > width, F.concat(F.left(text, F.lit(width)), F.lit("..."))
    ).otherwise(text)


def word_count(text: Column) -> Column:
    """Default length measure; a subword tokenizer can be plugged in as a batch stage."""
    return F.size(F.regexp_extract_all(text, F.lit(r"(\w+)"), F.lit(1)))
