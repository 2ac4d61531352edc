"""Compiler-error texts: cleaning, typing, categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from irquarry.functions.text import let, newline_split, squeeze, strip

# Message markers.
TOOL_ERROR = "llc: error:"
ANY_ERROR = "error:"
UNVERIFIED = "input module cannot be verified"
PATH_POSITION = r"/[^:\s]+(?::\d+:\d+:)?"

# Error categories, in matching order.
CATEGORIES = (
    "input module cannot be verified",
    "expected top-level entity",
    "use of undefined value",
    "label expected to be numbered",
    "instruction forward referenced with type 'label'",
    "alignment is not a power of two",
    "instruction expected to be numbered",
    "label expected to be numbered",
    "defined with type",
    "invalid getelementptr indices",
    "value doesn't match function result type",
    "instruction forward referenced with type",
    "redefinition of function",
    "expected value token",
    "is not a basic block",
    "multiple definition of local value named",
    "unable to create block numbered",
    "base element of getelementptr must be sized",
    "use of undefined comdat",
    "invalid shufflevector operands",
    "invalid use of function-local name",
    "expected instruction opcode",
)


def drop_paths(text: Column) -> Column:
    """Remove file paths with their positions and collapse whitespace."""
    return squeeze(F.regexp_replace(text, PATH_POSITION, ""))


def clean_message(message: Column) -> Column:
    """Strip every line, clean the tool's own error lines, drop caret lines."""
    prefix = TOOL_ERROR + " "
    stripped = F.transform(newline_split(message), strip)
    kept = F.filter(stripped, lambda x: x.contains(prefix) | ~x.contains("^"))
    cleaned = F.transform(
        kept,
        lambda x: F.when(
            x.contains(prefix), drop_paths(F.replace(x, F.lit(prefix), F.lit("")))
        ).otherwise(x),
    )
    return F.array_join(cleaned, "\n")


def error_type(message: Column) -> Column:
    """Type of a message: that of its first tool-error line which can be typed, else null."""

    def line_type(line: Column) -> Column:
        def of_pieces(pieces: Column) -> Column:
            unverified = (F.size(pieces) == 2) & line.contains(UNVERIFIED)
            return F.when(unverified, F.lit(UNVERIFIED)).when(
                F.size(pieces) == 3, strip(F.element_at(pieces, -1))
            )

        return let(F.split(line, ANY_ERROR, -1), of_pieces)

    lines = F.filter(newline_split(message), lambda line: line.contains(TOOL_ERROR))
    return F.get(F.filter(F.transform(lines, line_type), lambda t: t.isNotNull()), F.lit(0))


def category(error: Column) -> Column:
    """First category contained in the type; null when none is."""
    out = F.when(error.contains(CATEGORIES[0]), F.lit(CATEGORIES[0]))
    for name in CATEGORIES[1:]:
        out = out.when(error.contains(name), F.lit(name))
    return out


def module_differs(log: Column) -> Column:
    """A differ log reports a difference, one-sided functions aside."""

    def counts(line: Column) -> Column:
        one_sided = line.contains("exists only in left module") | line.contains(
            "exists only in right module"
        )
        return (line != "") & ~one_sided & line.contains("differ")

    return F.exists(newline_split(log), counts)
