"""Lines of assembly listings: what marks, calls and argument set-up look like, and runs of lines within an array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from irquarry.functions.text import WHITESPACE, let, split_lines, strip

# Line patterns of the listing format.
GLOBL_LINE = r"^\s*\.globl\s+(\S+)"
LABEL_LINE = r"^\s*(\S+):"
END_LINE = r"^\s*\.cfi_endproc"

# Registers that carry call arguments, per calling convention.
ARGUMENT_REGISTERS = {
    "amd64_sysv": (
        "rdi", "rsi", "rdx", "rcx", "r8", "r9", "r10", "r11", "r12", "r13", "r14", "r15",
        "edi", "esi", "edx", "ecx", "r8d", "r9d", "r10d", "r11d", "r12d", "r13d", "r14d", "r15d",
        "di", "si", "dx", "cx", "r8w", "r9w", "r10w", "r11w", "r12w", "r13w", "r14w", "r15w",
        "dil", "sil", "dl", "cl", "r8b", "r9b", "r10b", "r11b", "r12b", "r13b", "r14b", "r15b",
        "xmm0", "xmm1", "xmm2", "xmm3", "xmm4", "xmm5", "xmm6", "xmm7", "al",
    ),
    "amd64_win": ("rcx", "rdx", "r8", "r9"),
}

# Instructions that set up arguments.
SETUP_OPCODES = (
    r"(?:v?mov(?:b|l|q|sd|ss|ups|aps|shdup|pd|ps)|lea|push|or|shl|vshuf|vextract|vcvt|vzeroupper)"
)

GLOBL, END, CALL = ".globl", ".cfi_endproc", "call"


def symbol_of_call(line: Column) -> Column:
    """Second token of a call line, cut at its parenthesis and comma; null without one."""
    token = F.get(F.split(strip(line), f"{WHITESPACE}+"), F.lit(1))
    return F.regexp_replace(F.regexp_replace(token, r"\(.*\)", ""), r",.*", "")


def called_symbols(text: Column) -> Column:
    """Distinct symbols of the lines that mention a call, in order of appearance."""
    calls = F.filter(
        F.transform(
            F.filter(split_lines(text), lambda line: line.contains(CALL)), symbol_of_call
        ),
        lambda s: s.isNotNull(),
    )
    return F.array_distinct(calls)


def _last_spans(spans: Column) -> Column:
    """Spans without those a later one of the same name replaces, in order of place."""

    def of_sorted(by_name: Column) -> Column:
        def is_last(s: Column, k: Column) -> Column:
            return ~F.coalesce(F.get(by_name, k + 1)["name"] == s["name"], F.lit(False))

        placed = F.transform(
            F.filter(by_name, is_last),
            lambda s: F.struct(s["first"].alias("first"), s["name"].alias("name"), s["last"].alias("last")),
        )
        return F.transform(
            F.array_sort(placed),
            lambda s: F.struct(s["name"].alias("name"), s["first"].alias("first"), s["last"].alias("last")),
        )

    return let(F.array_sort(spans), of_sorted)


def _is_globl(line: Column) -> Column:
    return line.contains(GLOBL) & line.rlike(GLOBL_LINE)


def _place(values: Column, test: Callable[[Column], Column]) -> Column:
    """Place of the first value that passes, counted from one; 0 where none does."""
    passes = F.transform(values, lambda v: F.coalesce(test(v), F.lit(False)))
    return F.coalesce(F.array_position(passes, True), F.lit(0)).cast("int")


def _between(lines: Column, first: Column, last: Column) -> Column:
    return F.slice(lines, first, F.greatest(last - first + 1, F.lit(0)))


def function_spans(lines: Column, last_only: bool = True) -> Column:
    """Functions of a listing's lines as (name, first, last) line numbers, counted from one.

    ``.globl S`` arms S; the next label S opens the function and disarms it; the function ends
    with its end marker, before the next opening, or with the listing.  Of a reopened name the
    last span counts, unless ``last_only`` is off.

    Each ``.globl`` line is looked at with the lines up to the next one, and each opening with the lines up to the
    next one, so the work grows with the lines.
    """
    return let(lines, lambda bound: _spans(bound, last_only))


def _spans(lines: Column, last_only: bool) -> Column:
    def numbered(line: Column, i: Column) -> Column:
        armed = F.regexp_extract(line, GLOBL_LINE, 1)
        return F.when(_is_globl(line), F.struct(armed.alias("name"), (i + 1).alias("line")))

    def opened(globls: Column) -> Column:
        def opening(g: Column, k: Column) -> Column:
            until = F.coalesce(F.get(globls, k + 1)["line"] - 1, F.size(lines))

            def label_line(label: Column) -> Column:
                return _place(
                    _between(lines, g["line"] + 1, until),
                    lambda line: line.contains(label) & (F.regexp_extract(line, LABEL_LINE, 1) == g["name"]),
                )

            at = let(F.concat(g["name"], F.lit(":")), label_line)
            return let(at, lambda n: F.when(n > 0, F.struct(g["name"].alias("name"), (g["line"] + n).alias("first"))))

        return F.filter(F.transform(globls, opening), lambda o: o.isNotNull())

    def closed(openings: Column) -> Column:
        def span(o: Column, k: Column) -> Column:
            until = F.coalesce(F.get(openings, k + 1)["first"] - 1, F.size(lines))
            at = _place(
                _between(lines, o["first"] + 1, until), lambda line: line.contains(END) & line.rlike(END_LINE)
            )
            last = let(at, lambda n: F.when(n > 0, o["first"] + n).otherwise(until))
            return F.struct(o["name"].alias("name"), o["first"].alias("first"), last.alias("last"))

        return F.transform(openings, span)

    globls = F.filter(F.transform(lines, numbered), lambda g: g.isNotNull())
    found = let(let(globls, opened), closed)
    return let(found, _last_spans) if last_only else found


def function_bodies(lines: Column) -> Column:
    """Functions of a listing with their lines, ``.globl`` lines left out."""

    def cut(lines: Column) -> Column:
        def body(span: Column) -> Column:
            whole = F.slice(lines, span["first"], span["last"] - span["first"] + 1)
            return F.struct(
                span["name"].alias("name"),
                span["first"].alias("first_line"),
                span["last"].alias("last_line"),
                F.filter(whole, lambda line: ~_is_globl(line)).alias("lines"),
            )

        return F.transform(function_spans(lines), body)

    return let(lines, cut)


def setup_pattern(arch: str) -> str:
    """Lines that set an argument of ``arch``, as one pattern that ignores case."""
    if arch == "x86":
        return r"(?i)^\s*push \s*\S"
    registers = "|".join(ARGUMENT_REGISTERS[arch])
    return rf"(?i)^\s*{SETUP_OPCODES}[a-z]*\s+.*,\s*%(?:{registers}|ymm[0-9]+)\b"


def call_pattern(symbol: Column) -> Column:
    """Pattern of a call or jump to ``symbol``, ignoring case."""
    quoted = F.regexp_replace(symbol, r"([^A-Za-z0-9_])", r"\\$1")
    return F.concat(F.lit(r"(?i)\b(?:callq?|jmp)\s+(?:\w+:)?\b"), quoted, F.lit(r"(?:@PLT)?\b"))


def setup_lines(arch: str) -> Callable[[Column], Column]:
    """Whether a line sets an argument."""
    setup = setup_pattern(arch)
    marker = "%" if arch in ARGUMENT_REGISTERS else " "
    return lambda line: line.contains(marker) & line.rlike(setup)


def may_call(line: Column) -> Column:
    """A plain test that all calls pass, so that few lines meet the pattern."""
    lower = F.lower(line)
    return lower.contains(CALL) | lower.contains("jmp")


def call_context(
    lines: Column, symbol: Column, arch: str = "amd64_sysv", goes_on: Column | None = None
) -> Column:
    """Numbers of the lines related to calls of ``symbol``, counted from one, ascending.

    They are the calls and the unbroken run of argument set-up lines directly above each.  The run is sought between a
    call and the one before it, whose own run lies above it.  Where ``goes_on``, a call follows the last line's run.
    """
    return let(lines, lambda bound: let(call_pattern(symbol), lambda calls: _runs(bound, calls, arch, goes_on)))


def _runs(lines: Column, pattern: Column, arch: str, goes_on: Column | None) -> Column:
    is_setup = setup_lines(arch)

    def not_setup(line: Column) -> Column:
        return ~is_setup(line)

    def related(calls: Column) -> Column:
        def run(call: Column, k: Column) -> Column:
            before = F.when(k > 0, F.get(calls, k - 1)).otherwise(F.lit(0))
            above = F.reverse(_between(lines, before + 1, call - 1))
            at = _place(above, not_setup)
            first = let(at, lambda n: F.when(n > 0, call - n + 1).otherwise(before + 1))
            return F.sequence(first, call)

        return F.flatten(F.transform(calls, run))

    numbers = F.transform(lines, lambda line, i: F.when(may_call(line) & F.regexp_like(line, pattern), i + 1))
    calls = F.filter(numbers, lambda n: n.isNotNull())
    if goes_on is None:
        return let(calls, related)
    virtual = F.when(goes_on, F.array(F.size(lines) + 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(let(F.concat(calls, virtual), related), lambda n: n <= F.size(lines))
