"""Listing folds against plain line loops on random listings."""

import random
import re

from pyspark.sql import functions as F

from irquarry.functions.text import split_lines
from irquarry.operators import listing_chunks, listings


def functions_by_lines(text):
    """Line loop: armed name, open function, collected lines."""
    armed, inside, out = None, None, {}
    for line in text.splitlines():
        if m := re.match(r"\s*\.globl\s+(\S+)", line):
            armed = m[1]
        elif (m := re.match(r"\s*(\S+):", line)) and armed is not None and m[1] == armed:
            armed, inside = None, m[1]
            out[inside] = [line]
        elif inside is not None:
            out[inside].append(line)
            if re.match(r"\s*\.cfi_endproc", line):
                inside = None
    return out


def context_by_lines(lines, symbol, setup):
    calls = re.compile(rf"\b(?:callq?|jmp)\s+(?:\w+:)?\b{re.escape(symbol)}(?:@PLT)?\b", re.I)
    hits = set()
    for i, line in enumerate(lines):
        if calls.search(line):
            j = i
            hits.add(i)
            while j > 0 and re.match(setup, lines[j - 1].strip().lower() or "-"):
                j -= 1
                hits.add(j)
    return sorted(hits)


PIECES = [
    "\t.globl\tf", "\t.globl\tg", "f:", "g:  # @g", "h:", "\t.cfi_endproc", "\tmovl\t$1, %edi", "\tMOVQ %rax, %RSI",
    "\tcallq\tf@PLT", "\tcall g", "\tjmp\tf", "\tnop", "\tpushq %rax, %rdi", "\tcallq fg", "# call f", "\tvmovups (%rax), %ymm3", "", "\tpush %ebx",
]


def random_listings(seed, n):
    rng = random.Random(seed)
    return ["\n".join(rng.choices(PIECES, k=rng.randint(0, 30))) for _ in range(n)]


def test_split_functions(table):
    texts = random_listings(1, 400)
    df = table(list(enumerate(texts)), "doc long, text string")
    got = {}
    for r in listings.split_functions(df, "doc", "text").collect():
        got.setdefault(r["doc"], {})[r["name"]] = r["lines"]
    assert got == {i: w for i, t in enumerate(texts) if (w := functions_by_lines(t))}


def test_call_context(table):
    texts = random_listings(2, 400)
    df = table([(i, t, "f") for i, t in enumerate(texts)], "doc long, text string, symbol string")
    for arch in ("amd64_sysv", "amd64_win", "x86"):
        rows = df.select("doc", listings.call_context(split_lines(F.col("text")), F.col("symbol"), arch).alias("n")).collect()
        setup = listings.setup_pattern(arch)
        for r in rows:
            assert [n - 1 for n in r["n"]] == context_by_lines(texts[r["doc"]].splitlines(), "f", setup), texts[r["doc"]]


def test_symbols_are_quoted(table):
    df = table([("callq a.b@PLT\ncallq axb", "a.b")], "text string, symbol string")
    got = df.select(listings.call_context(split_lines(F.col("text")), F.col("symbol"))).head()[0]
    assert got == [1]


def test_called_symbols(table):
    text = "callq f@PLT\n call g(x), y\n# call\ncallq\nlea x, call\n callq f@PLT"
    row = table([(text,)], "t string").select(listings.called_symbols(F.col("t"))).head()
    assert sorted(row[0]) == sorted({"f@PLT", "g", "call", "x"})


def test_report(table):
    listing = "\t.globl f\nf:\n callq g@PLT\n callq h\n .cfi_endproc"
    wrapper = listing + "\n .globl main\nmain:\n movl $1, %edi\n callq f\n nop\n .cfi_endproc\n .globl g\ng:\n nop"
    df = table([(0, listing, wrapper), (1, "nop", wrapper)], "doc long, listing string, wrapper string")
    rows = listings.listing_report(df, "doc", "listing", "wrapper").collect()
    assert len(rows) == 1 and rows[0]["undefined"] == ["h"] and rows[0]["under_test"] == "f" and rows[0]["has_main"]
    calls = listings.callers_of(df.where("doc = 0"), "doc", "listing", "wrapper").collect()
    assert [(r["caller"], r["line"].strip()) for r in calls] == [("main", "movl $1, %edi"), ("main", "callq f")]


def test_listings_of_many_chunks(table):
    texts = random_listings(3, 250)
    df = table([(i, t, "f") for i, t in enumerate(texts)], "doc long, text string, symbol string")
    for size in (1, 3, 7):
        chunks = listing_chunks.line_chunks(df, "doc", "text", ["symbol"], size)
        assert chunks.agg(F.max(F.size("lines"))).head()[0] == size
        got, firsts = {}, {}
        for r in listing_chunks.functions(chunks, "doc", size).collect():
            got.setdefault(r["doc"], {})[r["name"]] = r["lines"]
        assert got == {i: w for i, t in enumerate(texts) if (w := functions_by_lines(t))}
        for r in listing_chunks.names(chunks, "doc", False, size).collect():
            firsts.setdefault(r["doc"], []).append((r["first"], r["name"]))
        assert {i: min(f)[1] for i, f in firsts.items()} == {i: next(iter(w)) for i, t in enumerate(texts) if (w := functions_by_lines(t))}
        for arch in ("amd64_sysv", "amd64_win", "x86"):
            lines = {}
            for r in listing_chunks.call_lines(chunks, "doc", "symbol", arch).collect():
                lines.setdefault(r["doc"], []).append(r["line_no"] - 1)
                assert texts[r["doc"]].splitlines()[r["line_no"] - 1] == r["line"]
            want = {i: context_by_lines(t.splitlines(), "f", listings.setup_pattern(arch)) for i, t in enumerate(texts)}
            assert {i: sorted(n) for i, n in lines.items()} == {i: n for i, n in want.items() if n}


def test_set_up_lines_reach_over_chunks_without_other_lines(table):
    text = "\n".join(["nop", *["\tmovl\t$1, %edi"] * 20, "\tcallq\tf", *["\tmovl\t$1, %edi"] * 5, "nop"])
    df = table([(0, text, "f"), (1, None, "f"), (2, "", "f")], "doc long, text string, symbol string")
    chunks = listing_chunks.line_chunks(df, "doc", "text", ["symbol"], 4)
    got = sorted(r["line_no"] for r in listing_chunks.call_lines(chunks, "doc", "symbol", "amd64_sysv").collect())
    assert got == list(range(2, 23))
