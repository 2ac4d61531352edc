"""Column functions on literal values."""

import re

import pytest
from pyspark.sql import functions as F

from irquarry.functions import code, errors, instructions, text


def test_listing_drops_ident_and_files(evaluate):
    raw = '  .ident "clang version 17"\n.ident "gcc"\n\t.file "a.c" # x\nmovl $1 # c\n# only\n'
    kept = evaluate(text.normalize_listing(F.col("t")), t=raw)
    assert kept == '.ident "gcc"\n.file   "-"\nmovl $1 # c\n# only\n'
    cut = evaluate(text.normalize_listing(F.col("t"), remove_comments=True), t=raw)
    assert cut == '.ident "gcc"\n.file   "-"\nmovl $1\n\n'


def test_comment_character_only_gates(evaluate):
    cut = text.normalize_listing(F.col("t"), remove_comments=True, comment_character=";")
    assert evaluate(cut, t="a # b\n c ; d # e") == "a # b\nc ; d"


def test_module_headers(evaluate):
    raw = "; ModuleID = 'x'\nsource_filename = \"y\"\ndefine i32 @f()"
    assert evaluate(text.normalize_module(F.col("t")), t=raw) == (
        "; ModuleID = '<stdin>'\nsource_filename = \"-\"\ndefine i32 @f()"
    )


@pytest.mark.parametrize("raw", ["", "a", "a\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x85g h\n\ni"])
def test_split_lines(evaluate, raw):
    got = evaluate(text.split_lines(F.col("t")), t=raw)
    assert got == raw.splitlines()


def test_strip_takes_all_whitespace(evaluate):
    raw = "　\t a b \n "
    assert evaluate(text.strip(F.col("t")), t=raw) == raw.strip()
    assert evaluate(text.squeeze(F.col("t")), t=raw) == " ".join(raw.split())


def test_error_cleaning(evaluate):
    line = "llc: error: llc: /a/b c/predict.ll:20:56: error: invalid  getelementptr"
    assert evaluate(errors.drop_paths(F.col("t")), t=line) == "llc: error: llc: c error: invalid getelementptr"
    message = f"  {line}\n   %9 = x\n     ^\nllc: error: a ^ b\n"
    assert evaluate(errors.clean_message(F.col("t")), t=message) == (
        "llc: c error: invalid getelementptr\n%9 = x\na ^ b\n"
    )


@pytest.mark.parametrize(
    "message, expected",
    [
        ("llc: error: llc: /x.ll:1:2: error: expected value token", "expected value token"),
        ("note\nllc: error: y: input module cannot be verified", "input module cannot be verified"),
        ("llc: error: something else\nllc: error: llc: x: error: second line", "second line"),
        ("llc: error: a error: b error: c", None),
        ("error: plain", None),
        ("", None),
    ],
)
def test_error_type(evaluate, message, expected):
    assert evaluate(errors.error_type(F.col("t")), t=message) == expected


def test_category_takes_list_order(evaluate):
    first = "instruction forward referenced with type 'label'"
    assert evaluate(errors.category(F.col("t")), t=f"x {first}") == first
    assert evaluate(errors.category(F.col("t")), t="instruction forward referenced with type 'i32'") == (
        "instruction forward referenced with type"
    )
    assert evaluate(errors.category(F.col("t")), t="unheard of") is None


def test_differ_log(evaluate):
    log = "function f exists only in left module, different\n\n"
    assert evaluate(errors.module_differs(F.col("t")), t=log) is False
    assert evaluate(errors.module_differs(F.col("t")), t=log + "called functions differ") is True


FENCE = "```llvm\n{}\n```"


@pytest.mark.parametrize(
    "content, expected",
    [
        ("no block", ""),
        (FENCE.format("a") + FENCE.format("b"), "a"),
        ("<code>x\ny</code>", "x\ny"),
        ("<code>x</code>" + FENCE.format("a"), "a"),
        (FENCE.format("early") + "</think>mid</think> " + FENCE.format("late"), "late"),
        (FENCE.format("early") + "</think>", ""),
    ],
)
def test_response_code(evaluate, content, expected):
    assert evaluate(code.response_code(F.col("t")), t=content) == expected


def test_strip_think(evaluate):
    assert evaluate(code.strip_think(F.col("t")), t="<think>a</think> b</think> c ") == "b</think> c"
    assert evaluate(code.strip_think(F.col("t")), t="a</think> b") == "a</think> b"


IR_NAME = re.compile(r"define\s+(?:\S+\s+)*@\s*([\w\d_]+)\s*\(")


@pytest.mark.parametrize(
    "ir",
    [
        "define i32 @foo(i32 %0) {",
        "define dso_local i32 @foo (i32 %0) {\n  call void @bar(i32 1)\n}",
        "declare @x()\ndefine @y\ndefine void @z() {",
        "define i32 @foo.1() {\n ret i32 0 }",
        "no function",
        "define i32 @ foo()",
        "undefine x @a( @b(",
        "define @a(x@b(",
    ],
)
def test_ir_name_follows_the_greedy_rule(evaluate, ir):
    found = IR_NAME.findall(ir)
    assert evaluate(code.ir_function_name(F.col("t")), t=ir) == (found[0] if found else None)


def test_names(evaluate):
    assert evaluate(code.c_function_name(F.col("t")), t="static int f(int a, char *b) const ;\n") == "f"
    assert evaluate(code.c_function_name(F.col("t")), t="int x;") is None
    assert evaluate(code.quoted_name(F.col("t")), t="Writing 'cfg.f.dot'...") == "cfg.f.dot"
    assert evaluate(code.strip_plt(F.col("t")), t="memcpy@PLT") == "memcpy"


def test_strip_static(evaluate):
    raw = "static inline int f(void) { return 0; }\n  static int g(void);"
    assert evaluate(code.strip_static(F.col("t")), t=raw) == "int f(void) { return 0; }\nint g(void);"
    assert evaluate(code.strip_static(F.col("t")), t="#define X 1") == "#define X 1"


def test_c_block_and_markers(evaluate):
    assert evaluate(code.c_block(F.col("t")), t="x```C\n int f;\n ```y") == "int f;"
    assert evaluate(code.c_block(F.col("t")), t="none") is None
    assert evaluate(code.clean_sequence_markers(F.col("t")), t="a</s><s>b") == "a\nb"


def test_suite(evaluate):
    output = "# TOTAL:  9\n# PASS:  2\n# SKIP:  1\n# FAIL:  0\n# TOTAL:  3\n"
    counts = code.suite_counts(F.col("t"))
    assert evaluate(counts, t=output) == {"TOTAL": 3, "PASS": 2, "SKIP": 1, "FAIL": 0}
    assert evaluate(code.suite_passed(counts), t=output) is True
    assert evaluate(code.suite_passed(counts), t=output.replace("FAIL:  0", "FAIL:  1")) is False
    assert evaluate(code.suite_passed(counts), t="nothing") is False


def test_paths(evaluate):
    sub = text.path_from_component(F.col("t"), "Bench")
    assert evaluate(sub, t="/a/MyBench/b/Bench/c.ll") == "MyBench/b/Bench/c.ll"
    assert evaluate(sub, t="a/b") == "a/b"
    assert evaluate(text.drop_suffix(F.col("t"), ".ll"), t="x/all.ll") == "x/all"
    assert evaluate(text.drop_suffix(F.col("t"), ".ll"), t="x/all") == "x/all"


def test_preview(evaluate):
    assert evaluate(text.preview(F.col("t")), t="x" * 51) == "x" * 50 + "..."
    assert evaluate(text.preview(F.col("t")), t="x" * 50) == "x" * 50


def test_instructions(evaluate):
    norm = instructions.normalize_operands(F.col("t"))
    assert evaluate(norm, t="r0, #0x1f, [sp, #-12]") == "r0,#himm,[sp,himm]"
    full = instructions.normalize_instruction(F.lit("MOV"), F.col("t"))
    assert evaluate(full, t="eax, 0x10") == "mov_eax,himm"
    assert evaluate(full, t="") == "mov"
    for language, arch in {
        "ARM:LE:32:v8": "arm-32",
        "AARCH64:LE:64:v8A": "unknown",
        "x86:LE:64:default": "x86-64",
        "x86:LE:32:default": "x86-32",
    }.items():
        assert evaluate(instructions.arch_label(F.col("t")), t=language) == arch


def test_dependency_text_and_key(evaluate):
    deps = code.dependency_text(F.col("t"), F.array(F.lit("int g();")))
    assert evaluate(deps, t="typedef int bool;\nint x;") == "\nint x;\nint g();\n"
    assert evaluate(code.composite_key(F.col("t"), F.lit(None).cast("string")), t="a.c") == "a.c:None"
