"""Extraction of code, names and markers from source text and model output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from irquarry.functions.text import let, strip

# Patterns and markers that decide what is extracted.
FENCE_BLOCK = r"(?s)```llvm\n(.*?)\n```"
TAG_BLOCK = r"(?s)<code>(.*?)</code>"
C_BLOCK = r"(?s)```C\n(.*?)```"
THINK_OPEN, THINK_CLOSE = "<think>", "</think>"
C_DECLARATION = r"\b([a-zA-Z_][a-zA-Z0-9_]*)\s*\([^)]*\)\s*(const)?\s*(;)?\s*$"
STATIC_HEAD = (
    r"\A\s*(?:static\s+)?(?:inline\s+|__inline\s+|__inline__\s+)?(?:static\s+)?"
    r"(?:[\w\s*<>]+)\s+\w+\s*\("
)
STATIC_PREFIX = r"(?md)^\s*(?:static\s+|inline\s+|__inline\s+|__inline__\s+)+"
SUITE_LINE = r"# (\w+):\s+(\d+)"
QUOTED = r"'(.*?)'"
AARCH64_TRIPLE = 'target triple = "aarch64'
SEQUENCE_MARKERS = ("</s><s>", "<｜end▁of▁sentence｜><｜begin▁of▁sentence｜>")
BOOL_TYPEDEF = "typedef int bool;"
PLT = "@PLT"


def _first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def tag_blocks(text: Column) -> Column:
    """All ``<code>`` blocks of a text."""
    return F.regexp_extract_all(text, F.lit(TAG_BLOCK), F.lit(1))


def fenced_blocks(text: Column) -> Column:
    """All fenced IR blocks; the tagged blocks where there is no fence."""
    fenced = F.regexp_extract_all(text, F.lit(FENCE_BLOCK), F.lit(1))
    return F.when(F.size(fenced) > 0, fenced).otherwise(tag_blocks(text))


def response_code(content: Column) -> Column:
    """The first block after the last closing think tag, or the empty string."""
    answer = F.when(
        content.contains(THINK_CLOSE), strip(F.substring_index(content, THINK_CLOSE, -1))
    ).otherwise(content)
    return F.coalesce(_first(fenced_blocks(answer)), F.lit(""))


def strip_think(text: Column) -> Column:
    """Text behind the first closing think tag, when both tags are there."""
    close = F.locate(THINK_CLOSE, text)
    rest = strip(F.substr(text, close + F.lit(len(THINK_CLOSE))))
    return F.when(text.contains(THINK_OPEN) & (close > 0), rest).otherwise(text)


def normalize_prediction(predict: Column) -> Column:
    """Each prediction's first tagged block, or the prediction itself without one."""
    return F.transform(
        predict,
        lambda p: F.when(p.contains("code"), F.coalesce(_first(tag_blocks(p)), p)).otherwise(p),
    )


def ir_function_name(ir: Column) -> Column:
    """Name of the function found behind ``define``.

    The greedy token run of the rule makes it the last ``@name(`` that starts a token behind the
    first ``define``.  It is written as cut-and-collect, so that no regular expression has to
    back off over the whole module.
    """
    cut = F.regexp_instr(ir, F.lit(r"define\s"))
    behind = F.when(cut > 0, F.substr(ir, cut + F.lit(len("define"))))
    names = F.regexp_extract_all(behind, F.lit(r"(?U)(?<=\s)@\s*(\w+)\s*\("), F.lit(1))
    return F.try_element_at(names, F.lit(-1))


def c_function_name(declaration: Column) -> Column:
    return F.nullif(F.regexp_extract(declaration, C_DECLARATION, 1), F.lit(""))


def c_block(text: Column) -> Column:
    """Content of the first C fence, null without one."""
    return strip(_first(F.regexp_extract_all(text, F.lit(C_BLOCK), F.lit(1))))


def strip_static(func_def: Column) -> Column:
    """Remove leading static/inline keywords when the text starts like a function head."""
    return F.when(
        func_def.rlike(STATIC_HEAD), F.regexp_replace(func_def, STATIC_PREFIX, "")
    ).otherwise(func_def)


def suite_counts(output: Column) -> Column:
    """``# KEY:  n`` lines as a map; the last value of a repeated key wins."""
    hits = F.reverse(F.regexp_extract_all(output, F.lit(SUITE_LINE), F.lit(0)))
    pairs = F.transform(hits, lambda h: F.split(F.substr(h, F.lit(3)), r":\s+", 2))

    def to_map(found: Column) -> Column:
        # Of a repeated key the first entry of the reversed list is the last one of the text.
        keys = F.transform(found, lambda p: p[0])
        kept = F.filter(found, lambda p, i: F.array_position(keys, p[0]) == i + 1)
        return F.map_from_arrays(
            F.transform(kept, lambda p: p[0]), F.transform(kept, lambda p: p[1].try_cast("int"))
        )

    return let(pairs, to_map)


def suite_passed(counts: Column) -> Column:
    """TOTAL is positive and equals PASS + SKIP, and nothing failed."""
    get = lambda key: F.coalesce(F.try_element_at(counts, F.lit(key)), F.lit(0))
    total = get("TOTAL")
    return (total > 0) & (total == get("PASS") + get("SKIP")) & (get("FAIL") == 0)


def quoted_name(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, QUOTED, 1), F.lit(""))


def clean_sequence_markers(text: Column) -> Column:
    out = text
    for marker in SEQUENCE_MARKERS:
        out = F.replace(out, F.lit(marker), F.lit("\n"))
    return out


def targets_aarch64(ir: Column) -> Column:
    return ir.contains(AARCH64_TRIPLE)


def strip_plt(symbol: Column) -> Column:
    return F.split_part(symbol, F.lit(PLT), F.lit(1))


def dependency_text(deps: Column, dummy_funcs: Column) -> Column:
    """Dependencies and the first dummy function without the bool typedef."""
    text = F.concat(deps, F.lit("\n"), _first(dummy_funcs), F.lit("\n"))
    return F.replace(text, F.lit(BOOL_TYPEDEF), F.lit(""))


def composite_key(path: Column, head: Column) -> Column:
    """``path:head``; an absent part is spelled None."""
    none = F.lit("None")
    return F.concat_ws(":", F.coalesce(path, none), F.coalesce(head, none))
