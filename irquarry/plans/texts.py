"""Text queries: listings, modules, model output, names, error texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from irquarry.functions import code, errors, instructions, text
from irquarry.operators import error_stats
from irquarry.operators.records import training_pairs
from irquarry.plans import views
from irquarry.plans.registry import query
from irquarry.plans.sqltext import sql_strip
from irquarry.plans.views import ctes

@query(
    """
SELECT doc_id AS idx, text AS input, text AS output, 'corpus/' || md5(text) || '.c' AS file FROM documents
WHERE text IS NOT NULL"""
)
def training_projection(spark, sf_dir):
    return training_pairs(views.functions(spark, sf_dir), end=None)


@query(
    f"""
WITH t AS (SELECT doc_id, list_filter(string_split(
    '  .ident "clang version 17" x' || chr(10) || chr(9) || '.file "a.c" # c' || chr(10) || text, chr(10)),
    lambda l: NOT (contains(l, '.ident') AND contains(l, 'clang version'))) AS ls FROM documents)
SELECT doc_id, array_to_string(list_transform(ls, lambda l:
    CASE WHEN contains(l, '.file') THEN '.file   "-"'
         WHEN contains(l, '#') THEN {sql_strip("string_split(l, '#')[1]")} ELSE l END), chr(10)) AS listing
FROM t"""
)
def normalize_listing(spark, sf_dir):
    """Documents behind directive lines, normalised without comments."""
    head = F.lit('  .ident "clang version 17" x\n\t.file "a.c" # c\n')
    doc = views.table(spark, sf_dir, "documents")
    listing = text.normalize_listing(F.concat(head, "text"), remove_comments=True)
    return doc.select("doc_id", listing.alias("listing"))


@query(
    """
SELECT doc_id, '; ModuleID = ''<stdin>''' || chr(10) || 'source_filename = "-"' || chr(10) || text AS module
FROM documents"""
)
def normalize_module(spark, sf_dir):
    head = F.concat(F.lit("; ModuleID = '"), F.col("source"), F.lit("'\nsource_filename = \"x\"\n"))
    doc = views.table(spark, sf_dir, "documents")
    return doc.select("doc_id", text.normalize_module(F.concat(head, "text")).alias("module"))


@query(
    f"""
SELECT conv_id AS idx, CAST(turn AS INTEGER) AS choice,
  CASE WHEN turn % 4 = 2 THEN '' ELSE text END AS code FROM conversations"""
)
def extract_fenced_code(spark, sf_dir):
    """First code block of every answer; a bare answer has none."""
    return views.responses(spark, sf_dir).select(
        "idx", "choice", code.response_code(F.col("content")).alias("code")
    )


@query(
    f"""
SELECT conv_id AS idx, CAST(turn AS INTEGER) AS choice, {sql_strip('''CASE turn % 4
  WHEN 0 THEN '```llvm' || chr(10) || text || chr(10) || '```'
  WHEN 1 THEN '<code>' || text || '</code>'
  WHEN 2 THEN text
  ELSE 'again</think>```llvm' || chr(10) || text || chr(10) || '```' || chr(10) || '```llvm' || chr(10) || 'second' || chr(10) || '```' END''')} AS answer
FROM conversations"""
)
def strip_think(spark, sf_dir):
    """Answers behind the first closing think tag."""
    return views.responses(spark, sf_dir).select(
        "idx", "choice", code.strip_think(F.col("content")).alias("answer")
    )


@query(
    """
SELECT page_id,
  regexp_extract(html, 'href="([^"]*)"', 1) <> '' AS has_link,
  NULLIF(regexp_extract(html, '''(.*?)''', 1), '') AS quoted,
  NULLIF(regexp_extract(url || ' f' || page_id || '(int a) const ;', '\\b([a-zA-Z_][a-zA-Z0-9_]*)\\s*\\([^)]*\\)\\s*(const)?\\s*(;)?\\s*$', 1), '') AS c_name,
  'main' || page_id AS ir_name,
  array_to_string(list_slice(string_split(url, '/'), greatest(1, coalesce(list_position(list_transform(string_split(url, '/'), lambda c: contains(c, 'example')), TRUE), 1)), len(string_split(url, '/'))), '/') AS sub_path,
  'int f' || page_id || '(void) {}' || chr(10) || 'int g(void);' AS plain_def,
  replace(html, '<p>', chr(10)) AS cleaned
FROM pages"""
)
def code_names(spark, sf_dir):
    """Names and paths drawn out of page texts."""
    page = views.table(spark, sf_dir, "pages")
    number = F.col("page_id").cast("string")
    ir = F.concat(F.lit("x\ndefine dso_local i32 @main"), number, F.lit("(i32 %0) #0 {\n ret i32 0\n}\n"))
    static = F.concat(F.lit("static inline int f"), number, F.lit("(void) {}\nstatic int g(void);"))
    markers = F.replace("html", F.lit("<p>"), F.lit(code.SEQUENCE_MARKERS[0]))
    return page.select(
        "page_id",
        (F.regexp_extract("html", 'href="([^"]*)"', 1) != "").alias("has_link"),
        code.quoted_name(F.col("html")).alias("quoted"),
        code.c_function_name(F.concat("url", F.lit(" f"), number, F.lit("(int a) const ;"))).alias("c_name"),
        code.ir_function_name(ir).alias("ir_name"),
        text.path_from_component(F.col("url"), "example").alias("sub_path"),
        code.strip_static(static).alias("plain_def"),
        code.clean_sequence_markers(markers).alias("cleaned"),
    )


@query(
    """
SELECT o_orderkey AS idx, o_orderkey % 5 + 3 AS total, o_orderkey % 4 AS failures, o_orderkey % 4 = 0 AS passed
FROM orders"""
)
def suite_verdict(spark, sf_dir):
    """Test-suite texts of orders parsed and judged; a repeated key keeps its last value."""
    n = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    output = F.concat(
        F.lit("# TOTAL: 0\nnoise\n# TOTAL:  "), s(n % 5 + 3), F.lit("\n# PASS:  "), s(n % 5 + 1),
        F.lit("\n# SKIP: 2\n# FAIL:  "), s(n % 4), F.lit("\n"),
    )
    counts = code.suite_counts(output)
    parsed = views.table(spark, sf_dir, "orders").select(n.alias("idx"), counts.alias("counts"))
    return parsed.select(
        "idx",
        F.col("counts")["TOTAL"].cast("long").alias("total"),
        F.col("counts")["FAIL"].cast("long").alias("failures"),
        code.suite_passed(F.col("counts")).alias("passed"),
    )


@query(
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  'mov_' || CASE WHEN l_partkey % 2 = 0 THEN '[rax_+_himm],himm' ELSE 'rax,#himm' END AS norm,
  CASE l_suppkey % 4 WHEN 0 THEN 'arm-32' WHEN 1 THEN 'arm-64' WHEN 2 THEN 'x86-64' ELSE 'unknown' END AS arch,
  base64(encode('b' || l_partkey)) AS b64, strlen('b' || l_partkey) AS bb_len, lower(hex('b' || l_partkey)) AS hex
FROM lineitem"""
)
def instruction_text(spark, sf_dir):
    """Instructions made of line items: normal form, architecture, byte text."""
    item = views.table(spark, sf_dir, "lineitem")
    part = F.col("l_partkey")
    operands = F.when(
        part % 2 == 0, F.concat(F.lit("[RAX + 0x"), F.hex(part), F.lit("], #-"), part.cast("string"))
    ).otherwise(F.concat(F.lit("rax, #0x"), F.hex(part)))
    lowered = F.replace(operands, F.lit("RAX"), F.lit("rax"))
    language = (
        F.when(F.col("l_suppkey") % 4 == 0, "ARM:LE:32:v7")
        .when(F.col("l_suppkey") % 4 == 1, "AARCH64:LE:64:ARM")
        .when(F.col("l_suppkey") % 4 == 2, "x86:LE:64:default")
        .otherwise("MIPS:BE:32")
    )
    packed = instructions.byte_text(F.concat(F.lit("b"), part.cast("string")).cast("binary"))
    return item.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        instructions.normalize_instruction(F.lit("MOV"), lowered).alias("norm"),
        instructions.arch_label(language).alias("arch"),
        packed["b64_bytes"].alias("b64"),
        packed["bb_len"].cast("long").alias("bb_len"),
        packed["hex_bytes"].alias("hex"),
    )


@query(
    ctes("ev")
    + """
SELECT idx, retry, choice, 'note' || chr(10) ||
  CASE WHEN event_id % 6 = 5 THEN 'input module cannot be verified'
       ELSE 'llc: error: ' || CASE event_id % 6 WHEN 0 THEN 'expected top-level entity'
         WHEN 1 THEN 'use of undefined value ''%' || (event_id % 4) || ''''
         WHEN 2 THEN 'instruction forward referenced with type ''label'''
         WHEN 3 THEN 'base element of getelementptr must be sized'
         ELSE 'something nobody listed' END END || chr(10) || '%9 = load' || chr(10) AS message
FROM ev WHERE error_msg <> ''"""
)
def clean_errors(spark, sf_dir):
    """Error texts without paths, positions and caret lines."""
    rows = views.evaluations(spark, sf_dir).where("error_msg <> ''")
    return rows.select("idx", "retry", "choice", errors.clean_message(F.col("error_msg")).alias("message"))


@query(ctes("ev", "typed") + " SELECT error_type, count(*) AS n FROM typed GROUP BY 1")
def error_types(spark, sf_dir):
    return error_stats.error_counts(error_stats.typed_errors(views.evaluations(spark, sf_dir)))


@query(ctes("ev", "typed") + " SELECT error_type, idx, retry, choice FROM typed")
def error_index(spark, sf_dir):
    """The inverted index of error types, in long form."""
    return error_stats.error_index(views.evaluations(spark, sf_dir), ["idx", "retry", "choice"])


_CATEGORY = """
, cat AS (SELECT CASE
    WHEN contains(error_type, 'input module cannot be verified') THEN 'input module cannot be verified'
    WHEN contains(error_type, 'expected top-level entity') THEN 'expected top-level entity'
    WHEN contains(error_type, 'use of undefined value') THEN 'use of undefined value'
    WHEN contains(error_type, 'forward referenced with type ''label''') THEN 'instruction forward referenced with type ''label'''
    WHEN contains(error_type, 'base element') THEN 'base element of getelementptr must be sized' END AS category
  FROM typed)"""


@query(
    ctes("ev", "typed")
    + _CATEGORY
    + " SELECT category, count(*) AS n FROM cat WHERE category IS NOT NULL GROUP BY 1"
)
def error_rollup(spark, sf_dir):
    typed = error_stats.typed_errors(views.evaluations(spark, sf_dir))
    return error_stats.category_counts(error_stats.error_counts(typed))


@query(
    ctes("ev", "typed")
    + _CATEGORY
    + """, c AS (SELECT category, count(*) AS n FROM cat WHERE category IS NOT NULL GROUP BY 1),
s AS (SELECT CASE WHEN n / sum(n) OVER () < 0.2 THEN 'other' ELSE category END AS slice, n FROM c
  UNION ALL SELECT 'other', 0)
SELECT slice, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY 1"""
)
def error_pie(spark, sf_dir):
    """Category slices with those below a fifth folded: the five categories here lie on both sides."""
    typed = error_stats.typed_errors(views.evaluations(spark, sf_dir))
    counts = error_stats.category_counts(error_stats.error_counts(typed))
    return error_stats.folded_slices(counts, least=0.2)


@query(
    ctes("ev", "typed")
    + """, bad AS (SELECT idx, retry FROM ev GROUP BY 1, 2 HAVING NOT bool_or(comp))
SELECT error_type, count(*) AS n FROM typed SEMI JOIN bad USING (idx, retry) GROUP BY 1"""
)
def error_types_unfixed(spark, sf_dir):
    """Error types of the record rounds in which no choice compiled."""
    unfixed = error_stats.unfixed_only(views.evaluations(spark, sf_dir), ["idx", "retry"])
    return error_stats.error_counts(error_stats.typed_errors(unfixed))


@query(
    """
SELECT doc_id, contains(text, 'the') AS differs FROM documents"""
)
def differ_logs(spark, sf_dir):
    """Differ logs made of documents: lines with "the" report a difference, others one side only."""
    doc = views.table(spark, sf_dir, "documents")
    log = F.array_join(
        F.transform(
            text.newline_split(F.col("text")),
            lambda line: F.when(line.contains("the"), F.concat(F.lit("in block: predicates differ "), line)).otherwise(
                F.lit("function f exists only in left module, different")
            ),
        ),
        "\n",
    )
    return doc.select("doc_id", errors.module_differs(log).alias("differs"))
