"""Runs end to end: guards, evaluation of predictions, fix prompts, whole repair runs and what follows them."""

from __future__ import annotations

import time
from dataclasses import replace

from pyspark.sql import functions as F

from irquarry.config import PROMPT_TYPES, JobConfig
from irquarry.functions.code import AARCH64_TRIPLE, c_block
from irquarry.functions.text import word_count
from irquarry.operators import graphs, outcomes, predicates, prompts, records, repair, reports, retrieval, scoring, stages
from irquarry.operators import prompt_texts as texts
from irquarry.plans import views
from irquarry.plans.graphs import cfg_json
from irquarry.plans.registry import query
from irquarry.plans.sqltext import quote, sql_render, sql_strip
from irquarry.plans.views import ctes
from irquarry.session import new_work_path

_WORDS = "len(regexp_extract_all({}, '[a-zA-Z0-9_]+'))"


@query(
    f"""
SELECT d.doc_id AS idx, {_WORDS.format("lang || ' ' || source")} AS input_length, {_WORDS.format("text")} AS predict_length
FROM documents d JOIN labels USING (doc_id) WHERE toxic = 0"""
)
def prediction_lengths(spark, sf_dir):
    """Lengths of input and first prediction; records without a prediction are left out."""
    doc = views.table(spark, sf_dir, "documents").join(views.table(spark, sf_dir, "labels"), "doc_id")
    rows = doc.select(
        F.col("doc_id").alias("idx"),
        F.concat_ws(" ", "lang", "source").alias("input"),
        F.when(F.col("toxic") == 0, F.array("text", "lang")).otherwise(F.array().cast("array<string>")).alias("predict"),
    )
    kept = records.attach_prediction_lengths(rows.where(predicates.has_prediction()), word_count)
    return kept.select("idx", F.col("input_length").cast("long"), F.col("predict_length").cast("long"))


@query(
    """
SELECT doc_id AS idx, CASE WHEN doc_id % 5 = 0 THEN 'func_' || doc_id ELSE 'f' || doc_id END AS name FROM documents"""
)
def function_names(spark, sf_dir):
    """Name of the first function, or one made of the position where there is none."""
    nothing = F.lit(None).cast("array<struct<name: string>>")
    info = F.when(F.col("idx") % 5 == 0, nothing).otherwise(
        F.transform("func_info.functions", lambda f: F.struct(f["name"].alias("name")))
    )
    rows = views.functions(spark, sf_dir).withColumn("func_info", F.struct(info.alias("functions")))
    return rows.select("idx", records.function_name().alias("name"))


@query(
    """
SELECT doc_id AS idx, doc_id % 3 = 0 AS parser_accepted,
  NOT (doc_id % 2 = 0 AND (doc_id % 3 <> 0 OR doc_id % 5 = 0)) AS source_parses FROM documents"""
)
def parser_flags(spark, sf_dir):
    """What the compiler's and the parser's exit codes and the parsed functions say of a source."""
    number = F.col("idx")
    empty = F.struct(F.slice("func_info.functions", F.lit(1), F.lit(0)).alias("functions"))
    rows = views.functions(spark, sf_dir).select(
        "idx",
        F.struct((number % 2).alias("rc")).alias("compiler"),
        F.struct((number % 3).alias("rc")).alias("parser"),
        F.when(number % 5 == 0, empty).otherwise(F.col("func_info")).alias("info"),
    )
    return rows.select(
        "idx",
        predicates.parser_accepted("parser").alias("parser_accepted"),
        predicates.source_parses("compiler", "parser", "info").alias("source_parses"),
    )


@query(
    ctes("fn")
    + """
SELECT idx, inst FROM fn WHERE idx >= 20 AND idx < 120 AND inst > 50"""
)
def slice_before_filter(spark, sf_dir):
    """A range of positions cut out before a costly predicate."""
    cut = records.row_range(views.functions(spark, sf_dir), 20, 120)
    return cut.where(predicates.many_instructions()).select("idx", records.inst_count().alias("inst"))


def _two_targets(spark, sf_dir):
    """Two predictions a record; the second of every fourth, and both of every eighth, are for the other machine."""
    doc = views.table(spark, sf_dir, "documents").join(views.table(spark, sf_dir, "labels"), "doc_id")
    number = F.col("doc_id")
    other = F.concat(F.lit(AARCH64_TRIPLE + '-linux"\n'), "text")
    first = F.when(number % 8 == 0, other).otherwise(F.col("text"))
    second = F.when(number % 4 == 0, other).otherwise(F.col("text"))
    quality, toxic = F.col("quality") == 1, F.col("toxic") == 1
    return doc.select(
        number.alias("idx"),
        F.array(first, second).alias("predict"),
        F.array(quality, F.lit(True)).alias("predict_compile_success"),
        F.array(toxic, quality).alias("predict_execution_success"),
        quality.alias("target_compile_success"),
        toxic.alias("target_execution_success"),
    )


@query(
    """
SELECT doc_id AS idx, quality = 1 AND doc_id % 8 <> 0 AS compile_0, doc_id % 4 <> 0 AS compile_1,
  toxic = 1 AND doc_id % 8 <> 0 AS execution_0, quality = 1 AND doc_id % 4 <> 0 AS execution_1
FROM documents JOIN labels USING (doc_id)"""
)
def guarded_predictions(spark, sf_dir):
    """Flags of every prediction; one for the other machine counts as failed."""
    rows = scoring.guard_target(_two_targets(spark, sf_dir))
    flags = {f"{n}_{i}": F.get(f"predict_{n}_success", F.lit(i)) for n in ("compile", "execution") for i in (0, 1)}
    return rows.select("idx", *[c.alias(n) for n, c in flags.items()])


@query(
    """
WITH p AS (SELECT doc_id, quality, toxic, md5(text) < '8' AS ok, md5(text) < '4' AS runs FROM documents JOIN labels USING (doc_id)),
f AS (SELECT ok AND doc_id % 8 <> 0 AS c, runs AND doc_id % 8 <> 0 AS e, quality = 1 AS tc, toxic = 1 AS te FROM p)
SELECT count(*) AS n_records, count(*) FILTER (c) AS predict_compile_success, count(*) FILTER (e) AS predict_execution_success,
  count(*) FILTER (tc) AS target_compile_success, count(*) FILTER (te) AS target_execution_success FROM f"""
)
def evaluated_predictions(spark, sf_dir):
    """Predictions evaluated one choice per row, and the totals; the evaluator judges a text by its digest."""

    def evaluate(rows):
        digest = F.md5("llvm_ir")
        return rows.withColumns({"compile_success": digest < "8", "execution_success": digest < "4"})

    return scoring.score_totals(scoring.evaluate_predictions(_two_targets(spark, sf_dir), evaluate))


@query(
    """
SELECT doc_id AS idx, quality = 1 AS predict_compile_success, quality = 1 AND toxic = 1 AS predict_execution_success,
  doc_id % 2 = 0 AS target_compile_success, FALSE AS target_execution_success,
  CASE WHEN quality = 1 THEN '' ELSE 'lift: failed' END AS error_msg FROM labels"""
)
def strategy_table(spark, sf_dir):
    """Outcomes of a chain of external steps; unknown flags count as failed."""
    number, good = F.col("doc_id"), F.col("quality") == 1
    rows = views.table(spark, sf_dir, "labels").select(
        number.alias("idx"),
        F.when(good, F.lit(True)).alias("predict_compile_success"),
        F.when(good, F.col("toxic") == 1).alias("predict_execution_success"),
        (number % 2 == 0).alias("target_compile_success"),
        F.lit(None).cast("boolean").alias("target_execution_success"),
        F.when(~good, F.lit("lift: failed")).alias("error"),
    )
    return stages.strategy_outcomes(rows)


@query(" SELECT doc_id AS idx FROM labels WHERE NOT (quality = 1 AND doc_id % 2 = 0)")
def failed_targets(spark, sf_dir):
    """Records whose target did not execute."""
    flag = F.when(F.col("quality") == 1, F.col("doc_id") % 2 == 0)
    rows = views.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx"), flag.alias("target_execution_success"))
    return outcomes.failed_targets(rows)


@query(ctes("ev") + " SELECT idx, comp AS compile_success, exec_a AS execution_success FROM ev WHERE retry = -1 AND choice = 0")
def first_target_flags(spark, sf_dir):
    """Target flags as recorded with the first attempt."""
    return outcomes.target_flags(views.evaluations(spark, sf_dir).where("choice = 0"))


@query(
    ctes("ev")
    + """
SELECT ev.idx, retry, choice, text AS content, comp AS compiled, 'corpus/' || md5(d.text2) || '.c' AS path
FROM ev JOIN (SELECT conv_id AS idx, CAST(turn AS INTEGER) AS choice, text FROM conversations) USING (idx, choice)
JOIN (SELECT doc_id AS idx, text AS text2 FROM documents) d USING (idx) WHERE retry = -1"""
)
def response_rows(spark, sf_dir):
    """Responses with their evaluations and records, by record, round and choice."""
    answers = views.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("idx"), F.lit(-1).alias("retry"), F.col("turn").cast("int").alias("choice"), F.col("text").alias("content")
    )
    functions = views.functions(spark, sf_dir).select("idx", "path")
    rows = scoring.choice_rows(answers, views.evaluations(spark, sf_dir), functions)
    return rows.select("idx", "retry", "choice", "content", F.col("compile_success").alias("compiled"), "path")


@query(
    f"""
SELECT conv_id, turn, CASE WHEN turn % 3 <> 0 THEN {sql_strip("text")} END AS code FROM conversations"""
)
def c_blocks(spark, sf_dir):
    """The first C block of an answer; answers without one have none."""
    fence = F.concat(F.lit("before\n```C\n"), "text", F.lit("\n```\n```C\nsecond```"))
    answer = F.when(F.col("turn") % 3 != 0, fence).otherwise(F.concat(F.lit("```llvm\n"), "text", F.lit("\n```")))
    rows = views.table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", c_block(answer).alias("code"))


@query(
    f"""
SELECT doc_id AS idx, [{", ".join(map(quote, PROMPT_TYPES))}][doc_id % {len(PROMPT_TYPES)} + 1] AS prompt_type FROM documents"""
)
def known_prompt_types(spark, sf_dir):
    """Every record with one of the known strategies passes the check."""
    names = F.array(*map(F.lit, PROMPT_TYPES))
    kind = F.get(names, (F.col("doc_id") % len(PROMPT_TYPES)).cast("int"))
    rows = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), kind.alias("prompt_type"))
    return prompts.validated_types(rows)


_BASIS = (
    ctes("ev")
    + f"""
, p AS (SELECT *, {sql_strip("error_msg")} AS msg, (choice * 5 + idx) % 8 AS near FROM ev),
g AS (SELECT idx, retry, count(*) FILTER (comp) AS n,
  arg_min(msg, choice) FILTER (msg <> '') AS fe,
  coalesce(arg_min(llvm_ir, choice) FILTER (msg <> ''), arg_min(llvm_ir, choice)) AS fp,
  arg_max(llvm_ir, near) FILTER (comp) AS bp, arg_max(assembly, near) FILTER (comp) AS ba FROM p GROUP BY 1, 2),
c AS (SELECT *, 'P' || idx AS i, {sql_strip("string_split(ba, '#')[1]")} AS bare FROM g)"""
)
_COMPILE = sql_render(texts.COMPILE_ERROR, predict="fp", error_msg="fe")


def _fix(template, **values):
    return f"i || CASE WHEN n = 0 THEN {_COMPILE} ELSE {sql_render(template, **values)} END"


@query(
    _BASIS
    + f"""
SELECT idx, retry, {_fix(texts.EXECUTION_ERROR, predict="bp", predict_assembly="bare")} AS plain,
  {_fix(texts.EXECUTION_ERROR, predict="bp", predict_assembly="ba")} AS with_comments,
  {_fix(texts.EXECUTION_ERROR_WITH_C, predict="bare", predict_ghidra_c_code="'int f' || idx")} AS with_c,
  CASE WHEN n > 0 THEN i || {sql_render(texts.ANALYSIS_FIX, predict_llvm_ir="bp", predict_assembly="ba", analysis="'why ' || idx")} END AS analysed,
  CASE WHEN n > 0 THEN i || {sql_render(texts.TRACE_FIX, predict_llvm_ir="bp", predict_assembly="ba", target_execution_trace="'t' || idx", predict_execution_trace="'p' || retry")} END AS traced,
  CASE WHEN n = 0 THEN i || {_COMPILE} END AS unsupported
FROM c"""
)
def fix_prompts_all(spark, sf_dir):
    """Every form of the next prompt; of several compiled choices the one most like the target is repaired."""
    near = F.col("choice") * 5 + F.col("idx")
    angle = (near % 8).cast("double")
    one, zero = F.lit(1.0), F.lit(0.0)
    rows = views.evaluations(spark, sf_dir).withColumns(
        {"embedding": F.array(angle + 1, one), "target_embedding": F.array(one, zero)}
    )
    number = F.col("idx").cast("string")
    initial = F.concat(F.lit("P"), number)
    basis = prompts.fix_basis(rows, ("idx", "retry")).withColumn("c_code", F.concat(F.lit("int f"), number))
    plain, predict, assembly = JobConfig(), F.col("best.llvm_ir"), F.col("best.assembly")
    compiled = F.col("n_compiled") > 0
    analysed = prompts.analysis_fix(initial, predict, assembly, F.concat(F.lit("why "), number))
    traced = prompts.trace_fix(
        initial, predict, assembly, F.concat(F.lit("t"), number), F.concat(F.lit("p"), F.col("retry").cast("string"))
    )
    # a strategy without a form for compiled code is asked for the others alone
    unsupported = prompts.fix_prompt(replace(plain, prompt_type="basic"), initial)
    forms = {
        "plain": prompts.fix_prompt(plain, initial),
        "with_comments": prompts.fix_prompt(replace(plain, remove_comments=False), initial),
        "with_c": prompts.fix_prompt(replace(plain, prompt_type="ghidra-decompile-with-predict"), initial),
        "analysed": F.when(compiled, analysed),
        "traced": F.when(compiled, traced),
        "unsupported": F.when(~compiled, unsupported),
    }
    return basis.select("idx", "retry", *[c.alias(n) for n, c in forms.items()])


CHOICES, RETRIES = 3, 2


def _run(spark, fix_prompt_type="compile-fix"):
    """A run whose generator and evaluator are digests of what they are given."""
    config = JobConfig(num_generate=CHOICES, num_retry=RETRIES, fix_prompt_type=fix_prompt_type)

    def generate(df):
        choices = F.posexplode(F.array(*[F.lit(str(i)) for i in range(CHOICES)])).alias("choice", "_c")
        digest = F.md5(F.concat(F.md5("prompt"), F.lit(":"), "_c"))
        content = F.concat(F.lit("<think>x</think>```llvm\n"), digest, F.lit("\n```"))
        rows = df.select("idx", "retry", "prompt", choices)
        return rows.select("idx", "retry", "choice", content.alias("content"), F.lit(None).cast("string").alias("reasoning"))

    def evaluate(rows):
        digit = F.left("llvm_ir", F.lit(1))
        failed = F.concat(F.lit("llc: error: "), "llvm_ir")
        return rows.withColumns(
            {
                "compile_success": digit < "6",
                "execution_success": digit < "2",
                "error_msg": F.when(digit < "6", F.lit("")).otherwise(failed),
                "assembly": F.concat(F.lit("asm "), "llvm_ir"),
            }
        )

    return repair.RepairRun(new_work_path(spark, "run"), config, generate, evaluate)


def _to_repair(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("idx"),
        F.concat(F.lit("P:"), F.md5("text")).alias("prompt"),
        F.concat(F.lit("T "), "source").alias("target_assembly"),
        F.md5("text").alias("target_ir"),
    )


def _rounds(name, prompts_sql, fix):
    """The rounds of a run as SQL: what each asks, answers and gets, and which records go on."""
    parts, asked = [], prompts_sql
    for r in range(-1, RETRIES):
        t = f"{name}{r + 1}"
        parts.append(
            f"""{t}q AS ({asked}),
{t}e AS (SELECT idx, {r} AS retry, choice, prompt, code, left(code, 1) < '6' AS comp, left(code, 1) < '2' AS ok
  FROM (SELECT idx, choice, prompt, md5(md5(prompt) || ':' || choice) AS code FROM {t}q, (SELECT unnest(range({CHOICES})) AS choice))),
{t}b AS (SELECT idx, count(*) FILTER (comp) AS n, arg_min(code, choice) FILTER (NOT comp) AS f, arg_min(code, choice) FILTER (comp) AS b
  FROM {t}e GROUP BY 1 HAVING NOT bool_or(ok))"""
        )
        if fix == "llm-fix":
            earlier = " UNION ALL ".join(f"SELECT * FROM {name}{k}e" for k in range(r + 2))
            parts.append(
                f"""{t}h AS (SELECT idx, code AS c, comp FROM ({earlier}) WHERE comp
  QUALIFY row_number() OVER (PARTITION BY idx ORDER BY retry <> {r}, retry, choice) = 1)"""
            )
        asked = f"SELECT idx, {_next_prompt(fix)} AS prompt FROM {t}b JOIN base USING (idx)"
        if fix == "llm-fix":
            asked += f" LEFT JOIN {t}h h USING (idx)"
    every = " UNION ALL ".join(f"SELECT * FROM {name}{k}e" for k in range(RETRIES + 1))
    return ",\n".join(parts) + f",\n{name} AS ({every})"


def _next_prompt(fix):
    compile_part = sql_render(texts.COMPILE_ERROR, predict="f", error_msg="'llc: error: ' || f")
    run_part = sql_render(texts.EXECUTION_ERROR, predict="b", predict_assembly="'asm ' || b")
    plain = f"base.prompt || CASE WHEN n = 0 THEN {compile_part} ELSE {run_part} END"
    if fix != "llm-fix":
        return plain
    request = f"""{quote(texts.ANALYSIS_ROLE)} || {quote(chr(10) * 2 + texts.ANALYSIS_REFERENCE)} || target ||
  {quote(chr(10) * 2 + texts.ANALYSIS_PREDICTED)} || h.c || {quote(chr(10) * 2 + texts.ANALYSIS_ASSEMBLY)} || 'asm ' || h.c ||
  {quote(chr(10) * 2 + texts.ANALYSIS_INSTRUCTIONS)}"""
    analysis = f"'```llvm' || chr(10) || md5(md5({request}) || ':0') || chr(10) || '```'"
    analysed = sql_render(texts.ANALYSIS_FIX, predict_llvm_ir="h.c", predict_assembly="'asm ' || h.c", analysis=analysis)
    return f"CASE WHEN h.c IS NOT NULL THEN base.prompt || {analysed} ELSE {plain} END"


_BASE = """WITH base AS (SELECT doc_id AS idx, 'P:' || md5(text) AS prompt, 'T ' || source AS target, md5(text) AS target_ir FROM documents),
"""
_SHOWN = "idx, CAST(retry AS INTEGER) AS retry, CAST(choice AS INTEGER) AS choice, md5(prompt) AS prompt, code, comp AS compiled, ok AS executed"


def _with_prompts(spark, run, rows):
    asked = spark.read.parquet(run.path("prompts")).select("idx", "retry", F.md5("prompt").alias("prompt"))
    return rows.join(asked, ["idx", "retry"]).select(
        "idx",
        "retry",
        "choice",
        "prompt",
        F.col("llvm_ir").alias("code"),
        F.col("compile_success").alias("compiled"),
        F.col("execution_success").alias("executed"),
    )


@query(_BASE + _rounds("r", "SELECT idx, prompt FROM base", "compile-fix") + f" SELECT {_SHOWN} FROM r")
def repair_run(spark, sf_dir):
    """A whole run: prompts, code and outcome of every round and choice."""
    run = _run(spark)
    return _with_prompts(spark, run, repair.repair_loop(_to_repair(spark, sf_dir), run))


@query(_BASE + _rounds("r", "SELECT idx, prompt FROM base", "llm-fix") + f" SELECT {_SHOWN} FROM r")
def repair_run_two_stage(spark, sf_dir):
    """A whole run in which a failure is analysed before it is repaired."""
    run = _run(spark, "llm-fix")
    return _with_prompts(spark, run, repair.repair_loop(_to_repair(spark, sf_dir), run))


@query(
    _BASE
    + _rounds("r", "SELECT idx, prompt FROM base", "compile-fix")
    + """,
p AS (SELECT idx, bool_or(comp) AS c, bool_or(ok) AS e FROM r GROUP BY 1)
SELECT count(*) AS n_records, count(*) FILTER (c) AS predict_compile_success, count(*) FILTER (e) AS predict_execution_success,
  count(*) FILTER (left(target_ir, 1) < '6') AS target_compile_success, count(*) FILTER (left(target_ir, 1) < '2') AS target_execution_success
FROM p JOIN base USING (idx)"""
)
def run_totals(spark, sf_dir):
    """The totals of a whole run and of its targets."""
    return repair.run_batch(_to_repair(spark, sf_dir), _run(spark))


@query(
    _BASE
    + _rounds("r", "SELECT idx, prompt FROM base", "compile-fix")
    + """,
todo AS (SELECT idx FROM r GROUP BY 1 HAVING bool_or(comp) AND NOT bool_or(ok)),
"""
    + _rounds("s", "SELECT idx, prompt FROM base SEMI JOIN todo USING (idx)", "llm-fix")
    + f" SELECT {_SHOWN} FROM s"
)
def rerun_two_stage(spark, sf_dir):
    """What compiled but never executed in a run, repaired again with the two-stage fix."""
    work, again = _to_repair(spark, sf_dir), _run(spark)
    before = repair.repair_loop(work, _run(spark))
    return _with_prompts(spark, again, repair.rerun_compiled_only(work, before, again))


@query(
    """
SELECT doc_id AS idx, -1 AS retry, md5(text) AS prompt FROM documents WHERE md5(text) LIKE '0%'"""
)
def quarantined_prompts(spark, sf_dir):
    """Prompts at which the generator fails: no answer is stored, the other prompts of the call keep theirs."""

    def generate(batch):
        if any(p.startswith("0") for p in batch):
            raise RuntimeError("refused")
        return [[p] for p in batch]

    store = new_work_path(spark, "run")
    doc = views.table(spark, sf_dir, "documents")
    asked = doc.select(F.col("doc_id").alias("idx"), F.lit(-1).alias("retry"), F.lit("basic").alias("prompt_type"), F.md5("text").alias("prompt"))
    run = repair.RepairRun(
        store, JobConfig(num_retry=0), lambda df: stages.generation_stage(df, generate, batch_size=4), lambda df: df
    )
    asked.write.partitionBy("retry").parquet(run.path("prompts"))
    stages.cached_stage(asked, ["idx", "retry"], run.path("responses"), repair.RESPONSES, run.generate, ["retry"])
    return repair.quarantined_prompts(spark, run).select("idx", "retry", "prompt")


@query("SELECT item_id AS idx, CAST(-1 AS INTEGER) AS retry, md5(text) AS prompt FROM benchmark WHERE md5(text) < '10'")
def late_prompts(spark, sf_dir):
    """Prompts at which the generator hangs: the call ends at its deadline, the other prompts of the call keep their answers."""

    def generate(batch):
        if any(p < "10" for p in batch):
            time.sleep(600)
        return [[p] for p in batch]

    store = new_work_path(spark, "run")
    items = views.table(spark, sf_dir, "benchmark")
    asked = items.select(F.col("item_id").alias("idx"), F.lit(-1).alias("retry"), F.lit("basic").alias("prompt_type"), F.md5("text").alias("prompt"))
    run = repair.RepairRun(store, JobConfig(num_retry=0), lambda df: stages.generation_stage(df, generate, tasks=8, timeout=1.0), lambda df: df)
    asked.write.partitionBy("retry").parquet(run.path("prompts"))
    stages.cached_stage(asked, ["idx", "retry"], run.path("responses"), repair.RESPONSES, run.generate, ["retry"])
    return repair.quarantined_prompts(spark, run).select("idx", "retry", "prompt")


@query(
    ctes("fn")
    + """
SELECT t.idx, t.path, t.func_head FROM fn t WHERE NOT is_valid AND EXISTS (SELECT 1 FROM fn s JOIN labels ON s.idx = doc_id
  WHERE s.path = t.path AND s.func_head = t.func_head)"""
)
def leak_matches(spark, sf_dir):
    """The rows of the test split that a sample function matches."""
    rows = views.functions(spark, sf_dir).select("idx", "path", "func_head", "split")
    labels = views.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx"))
    found = scoring.matching_rows(rows.join(labels, "idx", "left_semi"), rows.where("split = 'test_synth'"))
    return found.select("idx", "path", "func_head")


@query(
    """
WITH v AS (SELECT vec_id AS id, vec_id % 8 AS shard, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
b AS (SELECT q.id, p.shard % 2 AS c, max(round(list_cosine_similarity(q.e, p.e), 9)) AS score FROM v q, v p WHERE q.label < 3 GROUP BY 1, 2)
SELECT count(*) FILTER (score > 0.95) AS n_near FROM b"""
)
def hard_case_count(spark, sf_dir):
    """Near copies of the hard cases in two collections; a case found in both counts twice."""
    vectors = views.vectors(spark, sf_dir).withColumn("collection", F.col("shard") % 2)
    hard = vectors.where("label < 3").select(F.col("point_id").alias("query_id"), "embedding")
    hits = retrieval.topk(hard, vectors, 1, "collection")
    return retrieval.near_copies(hits, ["collection"])


@query(
    ctes("ev")
    + """
, fx AS (SELECT idx, event_id FROM ev WHERE exec_a QUALIFY row_number() OVER (PARTITION BY idx ORDER BY retry, choice) = 1),
l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
e AS (SELECT DISTINCT doc_id, src, len(string_split(line, ' ')) % n AS dst FROM
  (SELECT doc_id, len(ls) AS n, generate_subscripts(ls, 1) - 1 AS src, unnest(ls) AS line FROM l)),
m AS (SELECT max(doc_id) + 1 AS n FROM documents)
SELECT idx AS graph_id, 'target' AS side, src, dst FROM (SELECT DISTINCT idx FROM ev) JOIN e ON doc_id = idx
UNION ALL SELECT idx, 'predict', src, dst FROM fx, m, e WHERE e.doc_id = fx.event_id % m.n"""
)
def first_executed_graphs(spark, sf_dir):
    """Graphs of each record's first executed candidate and of its target, whatever other candidates look like."""
    parsed = cfg_json(spark, sf_dir)
    number = F.substring_index("llvm_ir", "@e", -1).cast("long")
    size = views.table(spark, sf_dir, "documents").agg(F.max("doc_id") + 1).scalar()
    rows = views.evaluations(spark, sf_dir)
    program = parsed.select(F.col("doc_id").alias("_doc"), "json")
    candidates = rows.withColumn("_doc", number % size).join(program, "_doc")
    own = rows.select("idx").distinct().join(parsed.withColumnRenamed("doc_id", "idx"), "idx")
    return graphs.compare_first_executed(candidates, own, "json", "json")


_CHART = ctes("ev") + ", r AS (SELECT idx, retry, count(*) FILTER (exec_a) AS n_executed, count(*) FILTER (comp) AS n_compiled FROM ev GROUP BY 1, 2)"


@query(
    _CHART
    + """
, t AS (SELECT retry, sum(n_executed) AS e, sum(n_compiled) AS c FROM r GROUP BY 1)
SELECT 'run:n_executed' AS series, CAST(retry AS VARCHAR) AS x, CAST(e AS DOUBLE) AS y FROM t
UNION ALL SELECT 'run:n_compiled', CAST(retry AS VARCHAR), CAST(c AS DOUBLE) FROM t"""
)
def chart_table(spark, sf_dir):
    """Executed and compiled choices per round as chart rows."""
    rounds = outcomes.round_summary(views.evaluations(spark, sf_dir))
    sums = rounds.groupBy("retry").agg(F.sum("n_executed").alias("n_executed"), F.sum("n_compiled").alias("n_compiled"))
    return reports.chart_rows(sums, "run", "retry", ["n_executed", "n_compiled"])


@query(
    ctes("fn")
    + """
SELECT idx, path, func_head, quality = 1 AS predict_compile_success, toxic = 1 AS predict_execution_success,
  quality = 1 AS target_compile_success, TRUE AS target_execution_success
FROM fn JOIN labels ON doc_id = idx WHERE idx = (SELECT max(doc_id) FROM labels)"""
)
def one_sample(spark, sf_dir):
    """The report of one record."""
    labels = views.table(spark, sf_dir, "labels")
    good = F.col("quality") == 1
    flags = labels.select(
        F.col("doc_id").alias("idx"),
        good.alias("predict_compile_success"),
        (F.col("toxic") == 1).alias("predict_execution_success"),
        good.alias("target_compile_success"),
        F.lit(True).alias("target_execution_success"),
    )
    wanted = labels.agg(F.max("doc_id")).scalar()
    return reports.sample_report(views.functions(spark, sf_dir), flags, wanted)


@query(
    ctes("ev")
    + """
SELECT idx, retry, choice, comp AS compiled, exec_a AS executed,
  CASE WHEN length(error_msg) > 50 THEN left(error_msg, 50) || '...' ELSE error_msg END AS error FROM ev
UNION ALL SELECT o_orderkey, -1, NULL, o_orderkey % 2 = 0, FALSE, '' FROM orders"""
)
def generations_and_targets(spark, sf_dir):
    """The per-generation table with a line per target."""
    key = F.col("o_orderkey")
    targets = views.table(spark, sf_dir, "orders").select(
        key.alias("idx"),
        F.lit(-1).alias("retry"),
        (key % 2 == 0).alias("compile_success"),
        F.lit(None).cast("boolean").alias("execution_success"),
    )
    return reports.generation_table(views.evaluations(spark, sf_dir), targets)
