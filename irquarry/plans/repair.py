"""Prompt, stage and repair-loop queries."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from irquarry.config import JobConfig
from irquarry.operators import prompt_texts as texts
from irquarry.operators import prompts, repair, stages
from irquarry.plans import views
from irquarry.plans.registry import query
from irquarry.plans.sqltext import UNCOMMENTED, quote, sql_render, sql_strip
from irquarry.plans.views import ctes
from irquarry.session import new_work_path


_SIMILAR = sql_render(
    texts.SIMILAR,
    asm_code=UNCOMMENTED.format("text"),
    similar_asm_code="lang || ' listing'",
    similar_llvm_ir="source",
)


@query(
    f"""
SELECT doc_id AS idx, {_SIMILAR} AS similar, {sql_render(texts.BASIC, asm_code="text")} AS basic,
  {sql_render(texts.PCODE, p_code="text")} AS pcode,
  {sql_render(texts.PCODE_SIMILAR, pcode="text", similar_pcode="lang || ' listing'", similar_llvm_ir="source")} AS pcode_similar,
  {sql_render(texts.WITH_C, asm_code="text", ghidra_c_code="source")} AS with_c
FROM documents"""
)
def initial_prompts(spark, sf_dir):
    """First prompts of every strategy."""
    rows = views.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("idx"),
        F.col("text").alias("asm"),
        F.col("text").alias("pcode"),
        F.concat("lang", F.lit(" listing")).alias("similar_asm"),
        F.concat("lang", F.lit(" listing")).alias("similar_pcode"),
        F.col("source").alias("similar_ir"),
        F.col("source").alias("c_code"),
    )
    plain = dict(remove_comments=False)
    strategies = {
        "similar": JobConfig(prompt_type="in-context-learning"),
        "basic": JobConfig(prompt_type="basic", **plain),
        "pcode": JobConfig(prompt_type="ghidra-decompile", use_pcode=True),
        "pcode_similar": JobConfig(prompt_type="in-context-learning", use_pcode=True),
        "with_c": JobConfig(prompt_type="ghidra-decompile", **plain),
    }
    return rows.select("idx", *[prompts.initial_prompt(c).alias(n) for n, c in strategies.items()])


_FIX_COMPILE = sql_render(texts.COMPILE_ERROR, predict="fp", error_msg="fe")
_FIX_RUN = sql_render(texts.EXECUTION_ERROR, predict="bp", predict_assembly="'asm'")


@query(
    ctes("ev")
    + f"""
, p AS (SELECT *, {sql_strip("error_msg")} AS msg FROM ev),
g AS (SELECT idx, retry, count(*) FILTER (comp) AS n,
  arg_min(msg, choice) FILTER (msg <> '') AS fe,
  coalesce(arg_min(llvm_ir, choice) FILTER (msg <> ''), arg_min(llvm_ir, choice)) AS fp,
  arg_min(llvm_ir, choice) FILTER (comp) AS bp FROM p GROUP BY 1, 2)
SELECT idx, retry + 1 AS retry, 'P' || idx || CASE WHEN n = 0 THEN {_FIX_COMPILE} ELSE {_FIX_RUN} END AS prompt FROM g"""
)
def fix_prompts(spark, sf_dir):
    """The prompt that would follow every round of every record."""
    unknown = F.lit(None).cast("array<double>")
    rounds = views.evaluations(spark, sf_dir).withColumns(
        {"embedding": unknown, "target_embedding": unknown}
    )
    initial = F.concat(F.lit("P"), F.col("idx").cast("string"))
    return prompts.fix_basis(rounds, ("idx", "retry")).select(
        "idx",
        (F.col("retry") + 1).alias("retry"),
        prompts.fix_prompt(JobConfig(), initial).alias("prompt"),
    )


_ANALYSIS = f"""{quote(texts.ANALYSIS_ROLE)} ||
  CASE WHEN idx % 2 = 0 THEN {quote(chr(10) * 2 + texts.ANALYSIS_REFERENCE)} || 'target' || idx ELSE '' END ||
  {quote(chr(10) * 2 + texts.ANALYSIS_PREDICTED)} || llvm_ir ||
  {quote(chr(10) * 2 + texts.ANALYSIS_ASSEMBLY)} || assembly ||
  CASE WHEN error_msg <> '' THEN {quote(chr(10) * 2 + texts.ANALYSIS_DIAGNOSTICS)} || error_msg ELSE '' END ||
  {quote(chr(10) * 2 + texts.ANALYSIS_INSTRUCTIONS)}"""


@query(ctes("ev") + f" SELECT idx, retry, choice, {_ANALYSIS} AS prompt FROM ev")
def analysis_prompts(spark, sf_dir):
    """Failure-analysis requests; every other record has no reference assembly."""
    rows = views.evaluations(spark, sf_dir)
    target = F.when(
        F.col("idx") % 2 == 0, F.concat(F.lit("target"), F.col("idx").cast("string"))
    ).otherwise(F.lit(""))
    prompt = prompts.analysis_prompt(target, F.col("llvm_ir"), F.col("assembly"), F.col("error_msg"))
    return rows.select("idx", "retry", "choice", prompt.alias("prompt"))


_TEMPLATE = {
    "prompt_input": "### Instruction:\n{instruction}\n\n### Input:\n{input}\n\n### Response:\n",
    "prompt_no_input": "### Instruction:\n{instruction}\n\n### Response:\n",
    "response_split": "### Response:",
}


@query(
    f"""
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN {sql_render(_TEMPLATE["prompt_input"], instruction="role", input="text")}
    ELSE {sql_render(_TEMPLATE["prompt_no_input"], instruction="role")} END || 'yes ' AS prompt,
  'yes' AS response FROM conversations"""
)
def instruction_prompts(spark, sf_dir):
    """Instruction prompts with and without input, and the response cut out again."""
    rows = views.table(spark, sf_dir, "conversations")
    given = F.when(F.col("turn") % 2 == 0, F.col("text"))
    prompt = prompts.instruction_prompt(_TEMPLATE, F.col("role"), given, F.lit("yes "))
    return rows.select("conv_id", "turn", prompt.alias("prompt")).withColumn(
        "response", prompts.instruction_response(_TEMPLATE, F.col("prompt"))
    )


@query(
    """
SELECT doc_id AS idx, 0 AS rc, strlen(text) AS n_bytes, FALSE AS timed_out FROM documents"""
)
def command_stage(spark, sf_dir):
    """Every document through an external byte counter."""
    doc = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), "text")
    ran = stages.command_stage(doc, ["wc", "-c"], "text", tasks=_tasks(spark), threads=2)
    return ran.select(
        "idx", "tool.rc", F.trim("tool.stdout").cast("long").alias("n_bytes"), "tool.timed_out"
    )


def _tasks(spark) -> int:
    return max(spark.sparkContext.defaultParallelism, 1)


@query(
    """
WITH l AS (SELECT doc_id AS idx, unnest(string_split(text, chr(10))) AS line FROM documents),
c AS (SELECT idx, count(*) FILTER (contains(translate(line, 'the', 'THE'), 'THE')) AS n FROM l GROUP BY 1)
SELECT idx, CASE WHEN n > 0 THEN n END AS n_lines, CASE WHEN n = 0 THEN 'count: ' END AS error FROM c"""
)
def command_chain(spark, sf_dir):
    """Two commands in a row; a document without a hit stops with the second one's failure."""
    doc = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), "text")
    steps = [("upper", ["tr", "a-z", "A-Z"]), ("count", ["grep", "-a", "-c", "THE"])]
    ran = stages.command_chain(doc.repartition(_tasks(spark), "idx"), "text", steps, threads=2)
    return ran.select("idx", F.trim(F.replace("result", F.lit("\n"), F.lit(""))).cast("long").alias("n_lines"), "error")


_DIGIT = "substr(md5(idx || ':' || retry || ':' || choice), 1, 1)"


@query(
    f"""
WITH a AS (SELECT doc_id AS idx, unnest(range(-1, 10)) AS retry FROM documents),
b AS (SELECT idx, retry, unnest(range(0, 8)) AS choice FROM a),
e AS (SELECT idx, retry, choice, {_DIGIT} < '8' AS compile_success, {_DIGIT} < '3' AS execution_success FROM b),
r AS (SELECT idx, retry, bool_or(execution_success) AS ok FROM e GROUP BY 1, 2),
k AS (SELECT idx, coalesce(min(retry) FILTER (ok), 9) AS last FROM r GROUP BY 1)
SELECT idx, CAST(retry AS INTEGER) AS retry, CAST(choice AS INTEGER) AS choice, compile_success, execution_success
FROM e JOIN k USING (idx) WHERE retry <= last"""
)
def repair_loop(spark, sf_dir):
    """The retry dataflow over all documents, with a generator and an evaluator made of hashes."""
    config = JobConfig()

    def generate(batch):
        out = []
        for prompt in batch:
            digest = hashlib.md5(prompt.encode("utf-8")).hexdigest()
            out.append([f"```llvm\n{digest}{i}\n```" for i in range(config.num_generate)])
        return out

    def evaluate(rows):
        place = F.concat_ws(":", *[F.col(c).cast("string") for c in ("idx", "retry", "choice")])
        digit = F.left(F.md5(place), F.lit(1))
        return rows.withColumns(
            {
                "compile_success": digit < "8",
                "execution_success": digit < "3",
                "error_msg": F.when(digit < "8", F.lit("")).otherwise(F.lit("llc: error: x")),
                "assembly": F.concat(F.lit("asm "), F.col("llvm_ir")),
            }
        )

    records = views.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("idx"),
        F.col("text").alias("prompt"),
        F.col("text").alias("target_assembly"),
    )
    run = repair.RepairRun(
        store=new_work_path(spark, "repair"),
        config=config,
        generate=lambda df: stages.generation_stage(df, generate, tasks=_tasks(spark)),
        evaluate=evaluate,
    )
    rows = repair.repair_loop(records, run)
    return rows.select("idx", "retry", "choice", "compile_success", "execution_success")
