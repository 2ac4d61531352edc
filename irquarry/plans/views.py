"""Stand-in views: the given tables in the shape of the corpus tables.

Each view is a row-wise expression over whole tables, and ``SQL`` holds the same expression for
the check.  They add no shuffle and drop no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from irquarry.functions.text import let, newline_split
from irquarry.schemas import FUNC_INFO


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _words(line: Column) -> Column:
    return F.size(F.split(line, " ", -1))


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as function records: lines are blocks, words are instructions."""
    doc = table(spark, sf_dir, "documents")
    lines = newline_split(F.col("text"))
    sizes = F.transform(lines, _words)
    number = F.col("doc_id")
    info = F.struct(
        F.array(
            F.struct(
                F.concat(F.lit("f"), number.cast("string")).alias("name"),
                F.array_repeat(F.col("source"), (number % 4).cast("int")).alias("called_functions"),
                (number % 3).cast("int").alias("num_loops"),
                (number % 5 == 0).alias("has_defined_structs"),
                F.lit(False).alias("has_globals"),
                F.lit(False).alias("struct_args"),
                F.array_repeat(F.lit(0), (number % 2).cast("int")).alias("unused_args"),
                sizes.alias("bbcount"),
                (number % 10 == 0).alias("all_struct_fields_accessed"),
            )
        ).alias("functions")
    ).cast(FUNC_INFO)
    return doc.select(
        number.alias("idx"),
        (number % 8).cast("int").alias("shard"),
        F.when(number % 2 == 0, "valid_synth").otherwise("test_synth").alias("split"),
        F.concat(F.lit("corpus/"), F.md5("text"), F.lit(".c")).alias("path"),
        F.col("text").alias("func_def"),
        F.col("lang").alias("func_head"),
        F.concat("lang", F.lit(" f()")).alias("func_head_types"),
        F.concat(F.lit("f"), number.cast("string")).alias("fname"),
        F.struct(F.array("text").alias("code"), F.array(F.lit("x86")).alias("target")).alias("asm"),
        F.struct(
            F.array("text").alias("code"),
            F.array(F.lit("x86")).alias("target"),
            F.struct(
                F.concat(F.lit("f"), number.cast("string")).alias("func_name"),
                F.size(lines).alias("bbcount"),
                sizes.alias("bb_list_size"),
            ).alias("bb_count"),
        ).alias("llvm_ir"),
        info.alias("func_info"),
        F.col("n_chars").cast("int").alias("token_length"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents and the benchmark texts as predictions; the labels are the flags."""
    doc = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    quality, toxic = F.col("quality") == 1, F.col("toxic") == 1
    path = F.concat(F.lit("corpus/"), F.md5("text"), F.lit(".c"))
    labelled = doc.select(
        F.col("doc_id").alias("idx"),
        path.alias("file"),
        F.concat("lang", F.lit(" f()")).alias("func_head_types"),
        F.array(F.concat(F.lit("<code>"), "text", F.lit("</code>")), F.col("text")).alias("predict"),
        F.array(quality, toxic).alias("predict_compile_success"),
        F.array(quality & ~toxic & (F.col("doc_id") % 3 == 0), toxic & (F.col("doc_id") % 7 == 0)).alias(
            "predict_execution_success"
        ),
        quality.alias("target_compile_success"),
        (quality & (F.col("doc_id") % 2 == 0)).alias("target_execution_success"),
    )
    bench = table(spark, sf_dir, "benchmark").select(
        (F.col("item_id") + 1_000_000_000_000).alias("idx"),
        path.alias("file"),
        F.lit("en f()").alias("func_head_types"),
        F.array("text").alias("predict"),
        F.array(F.lit(True)).alias("predict_compile_success"),
        F.array(F.col("item_id") % 2 == 0).alias("predict_execution_success"),
        F.lit(True).alias("target_compile_success"),
        F.lit(False).alias("target_execution_success"),
    )
    return labelled.unionByName(bench)


def evaluations(spark: SparkSession, sf_dir: str, run: str = "a") -> DataFrame:
    """Events as evaluations: 88 events are one record of eleven rounds of eight choices."""
    event = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    number = F.col("event_id")
    compiles = F.col("event_type").isin("purchase", "signup")
    # every fourth record never executes in run a, every third never in run b
    record = F.expr("div(event_id, 88)")
    executed = {
        "a": (F.col("event_type") == "purchase") & (number % 6 == 0) & (record % 4 != 3),
        "b": (F.col("event_type") == "signup") & (number % 5 == 1) & (record % 3 != 0),
    }[run]
    place = F.concat(
        F.lit("/tmp/u"), F.col("user_id").cast("string"), F.lit("/predict.ll:"), (number % 90).cast("string"), F.lit(":5:")
    )
    texts = (
        F.when(number % 6 == 0, F.lit("expected top-level entity"))
        .when(number % 6 == 1, F.concat(F.lit("use of undefined value '%"), (number % 4).cast("string"), F.lit("'")))
        .when(number % 6 == 2, F.lit("instruction forward referenced with type 'label'"))
        .when(number % 6 == 3, F.lit("base element of getelementptr must be sized"))
        .otherwise(F.lit("something nobody listed"))
    )
    line = F.when(
        number % 6 == 5, F.lit("llc: error: input module cannot be verified")
    ).otherwise(F.concat(F.lit("llc: error: llc: "), place, F.lit(" error: "), texts))
    message = F.concat(F.lit("note\n  "), line, F.lit("\n  %9 = load\n     ^\n"))
    return event.select(
        F.expr("div(event_id, 88)").alias("idx"),
        (F.expr("div(event_id % 88, 8)") - 1).cast("int").alias("retry"),
        (number % 8).cast("int").alias("choice"),
        compiles.alias("compile_success"),
        executed.alias("execution_success"),
        F.when(compiles, F.lit("")).otherwise(message).alias("error_msg"),
        F.concat(F.lit("define @e"), number.cast("string")).alias("llvm_ir"),
        F.concat(F.lit("asm # "), number.cast("string")).alias("assembly"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as model output: fenced, tagged, bare, or thought over twice."""
    turn = table(spark, sf_dir, "conversations")
    think = F.concat(F.lit("<think>"), "role", F.lit("</think>\n"))
    fence = F.concat(F.lit("```llvm\n"), "text", F.lit("\n```\n"))
    content = (
        F.when(F.col("turn") % 4 == 0, F.concat(think, fence))
        .when(F.col("turn") % 4 == 1, F.concat(think, F.lit("<code>"), "text", F.lit("</code>")))
        .when(F.col("turn") % 4 == 2, F.concat(think, "text"))
        .otherwise(F.concat(think, F.lit("again</think>"), fence, F.lit("```llvm\nsecond\n```")))
    )
    return turn.select(
        F.col("conv_id").alias("idx"),
        F.lit(-1).alias("retry"),
        F.col("turn").cast("int").alias("choice"),
        content.alias("content"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("point_id"),
        (F.col("vec_id") % 8).cast("int").alias("shard"),
        F.expr("div(vec_id, 8)").alias("record_id"),
        "embedding",
        "label",
    )


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as assembly listings: one function per line, calling the line's first word."""
    doc = table(spark, sf_dir, "documents").select("doc_id", "text")

    def callee(line: Column) -> Column:
        return F.concat(F.lit("g_"), F.regexp_replace(F.substring_index(line, " ", 1), "[^A-Za-z]", ""))

    def body(line: Column, i: Column) -> Column:
        words = F.length(line) - F.length(F.replace(line, F.lit(" "))) + 1
        return let(words, lambda n: function(line, i, n))

    def function(line: Column, i: Column, words: Column) -> Column:
        name = F.concat(F.lit("f"), (words % 5).cast("string"), F.lit("_"), (i % 4).cast("string"))
        return F.concat(
            F.lit("\t.globl\t"),
            name,
            F.lit("\n"),
            name,
            F.lit(":\n\tmovl\t$"),
            words.cast("string"),
            F.when(words % 2 == 0, F.lit(", %edi\n\tleaq\t8(%rsp), %rsi\n\tcallq\t")).otherwise(
                F.lit(", %edi\n\tnop\n\tmovq\t%rax, %rdx\n\tcallq\t")
            ),
            callee(line),
            F.when(words % 3 != 0, F.lit("@PLT\n\t.cfi_endproc\n\t.size\tx")).otherwise(F.lit("@PLT\n\tretq\n\t.size\tx")),
        )

    lines = newline_split(F.col("text"))
    listing = F.array_join(F.transform(lines, body), "\n")
    return doc.select("doc_id", listing.alias("listing"), callee(F.get(lines, F.lit(0))).alias("symbol"))


def cfg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as graph edges: an order is a graph, every row an edge of both sides.

    Returned rows lead elsewhere on the predicted side.
    """
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    target = F.col("l_partkey") % 7 + 1
    predicted = F.when(F.col("l_returnflag") == "R", F.col("l_suppkey") % 7 + 1).otherwise(target)
    sides = F.array(
        F.struct(F.lit("target").alias("side"), target.alias("dst")),
        F.struct(F.lit("predict").alias("side"), predicted.alias("dst")),
    )
    return item.select(
        F.col("l_orderkey").alias("graph_id"),
        F.col("l_linenumber").cast("long").alias("src"),
        F.inline(sides),
    ).select("graph_id", "side", "src", "dst")


# The same views as common table expressions.
SQL = {
    "fn": """
fn AS (
  SELECT doc_id AS idx, CAST(doc_id % 8 AS INTEGER) AS shard, doc_id % 2 = 0 AS is_valid,
         'corpus/' || md5(text) || '.c' AS path, lang AS func_head, lang || ' f()' AS head,
         text AS code, CAST(n_chars AS INTEGER) AS token_length,
         CAST(len(string_split(text, chr(10))) AS INTEGER) AS bbcount,
         CAST(list_sum(list_transform(string_split(text, chr(10)), lambda l: len(string_split(l, ' ')))) AS BIGINT) AS inst,
         doc_id % 3 AS num_loops, doc_id % 4 AS n_called, doc_id % 2 AS n_unused,
         doc_id % 5 = 0 AS has_structs, doc_id % 10 = 0 AS all_fields
  FROM documents)""",
    "pred": """
pred AS (
  SELECT d.doc_id AS idx, 'corpus/' || md5(d.text) || '.c:' || d.lang || ' f()' AS key, d.text AS text,
         l.quality = 1 OR l.toxic = 1 AS any_compile,
         (l.quality = 1 AND l.toxic <> 1 AND d.doc_id % 3 = 0) OR (l.toxic = 1 AND d.doc_id % 7 = 0) AS any_exec,
         l.quality = 1 AS t_compile, l.quality = 1 AND d.doc_id % 2 = 0 AS t_exec
  FROM documents d JOIN labels l USING (doc_id)
  UNION ALL
  SELECT item_id + 1000000000000, 'corpus/' || md5(text) || '.c:en f()', text, TRUE, item_id % 2 = 0, TRUE, FALSE
  FROM benchmark),
pred_last AS (
  SELECT * FROM pred QUALIFY row_number() OVER (PARTITION BY key ORDER BY idx DESC) = 1)""",
    "corpus": """
corpus AS (
  SELECT doc_id AS row_idx, 'corpus/' || md5(text) || '.c:' || lang || ' f()' AS key
  FROM documents
  QUALIFY row_number() OVER (PARTITION BY 'corpus/' || md5(text) || '.c:' || lang || ' f()' ORDER BY doc_id DESC) = 1)""",
    "ev": """
ev AS (
  SELECT event_id // 88 AS idx, CAST((event_id % 88) // 8 - 1 AS INTEGER) AS retry,
         CAST(event_id % 8 AS INTEGER) AS choice,
         event_type IN ('purchase', 'signup') AS comp,
         event_type = 'purchase' AND event_id % 6 = 0 AND event_id // 88 % 4 <> 3 AS exec_a,
         event_type = 'signup' AND event_id % 5 = 1 AND event_id // 88 % 3 <> 0 AS exec_b,
         CASE WHEN event_type IN ('purchase', 'signup') THEN '' ELSE
           'note' || chr(10) || '  ' ||
           CASE WHEN event_id % 6 = 5 THEN 'llc: error: input module cannot be verified' ELSE
             'llc: error: llc: /tmp/u' || user_id || '/predict.ll:' || (event_id % 90) || ':5: error: ' ||
             CASE event_id % 6 WHEN 0 THEN 'expected top-level entity'
               WHEN 1 THEN 'use of undefined value ''%' || (event_id % 4) || ''''
               WHEN 2 THEN 'instruction forward referenced with type ''label'''
               WHEN 3 THEN 'base element of getelementptr must be sized'
               ELSE 'something nobody listed' END END
           || chr(10) || '  %9 = load' || chr(10) || '     ^' || chr(10) END AS error_msg,
         'define @e' || event_id AS llvm_ir, 'asm # ' || event_id AS assembly, event_id
  FROM events)""",
    "typed": """
typed AS (
  SELECT *, CASE event_id % 6 WHEN 0 THEN 'expected top-level entity'
      WHEN 1 THEN 'use of undefined value ''%' || (event_id % 4) || ''''
      WHEN 2 THEN 'instruction forward referenced with type ''label'''
      WHEN 3 THEN 'base element of getelementptr must be sized'
      WHEN 5 THEN 'input module cannot be verified'
      ELSE 'something nobody listed' END AS error_type
  FROM ev WHERE error_msg <> '')""",
    "lst": """
raw AS (
  SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
raw_lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS line FROM raw),
fun AS (
  SELECT doc_id, i, len(string_split(line, ' ')) AS w,
         'f' || (len(string_split(line, ' ')) % 5) || '_' || ((i - 1) % 4) AS nm,
         'g_' || regexp_replace(string_split(line, ' ')[1], '[^A-Za-z]', '', 'g') AS callee
  FROM raw_lines),
lst_lines AS (
  SELECT doc_id, i, w, nm, callee, k, txt FROM (
    SELECT doc_id, i, w, nm, callee, unnest([
      {'k': 1, 'txt': chr(9) || '.globl' || chr(9) || nm},
      {'k': 2, 'txt': nm || ':'},
      {'k': 3, 'txt': chr(9) || 'movl' || chr(9) || '$' || w || ', %edi'},
      {'k': 4, 'txt': CASE WHEN w % 2 = 0 THEN chr(9) || 'leaq' || chr(9) || '8(%rsp), %rsi' ELSE chr(9) || 'nop' END},
      {'k': 5, 'txt': CASE WHEN w % 2 = 0 THEN NULL ELSE chr(9) || 'movq' || chr(9) || '%rax, %rdx' END},
      {'k': 6, 'txt': chr(9) || 'callq' || chr(9) || callee || '@PLT'},
      {'k': 7, 'txt': CASE WHEN w % 3 <> 0 THEN chr(9) || '.cfi_endproc' ELSE chr(9) || 'retq' END},
      {'k': 8, 'txt': chr(9) || '.size' || chr(9) || 'x'}], recursive := true)
    FROM fun) WHERE txt IS NOT NULL),
lst AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) AS n FROM lst_lines)""",
    "edge": """
edge AS (
  SELECT DISTINCT graph_id, side, src, dst FROM (
    SELECT l_orderkey AS graph_id, 'target' AS side, CAST(l_linenumber AS BIGINT) AS src, l_partkey % 7 + 1 AS dst FROM lineitem
    UNION ALL
    SELECT l_orderkey, 'predict', CAST(l_linenumber AS BIGINT),
           CASE WHEN l_returnflag = 'R' THEN l_suppkey % 7 + 1 ELSE l_partkey % 7 + 1 END FROM lineitem)),
node AS (
  SELECT graph_id, side, src AS node FROM edge UNION SELECT graph_id, side, dst FROM edge)""",
}


def ctes(*names: str) -> str:
    """A WITH clause of the named views."""
    return "WITH " + ",".join(SQL[n] for n in names)
