"""Reading and writing: whole tables written by a sink and read back by its reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from irquarry.config import JobConfig
from irquarry.operators import error_stats, outcomes, records, repair, reports, retrieval, scoring, stages
from irquarry.plans import views
from irquarry.plans.registry import query
from irquarry.plans.views import ctes
from irquarry.schemas import PROMPTS
from irquarry.session import new_work_path
from irquarry.sources import readers, sinks
from irquarry.streaming.predictions import current_scores, score_stream


@query(
    ctes("fn")
    + """
SELECT idx, path, 'f' || idx AS fname, token_length, bbcount, TRUE AS no_wrapper FROM fn"""
)
def dataset_round_trip(spark, sf_dir):
    """A corpus saved and loaded with its fixed schema; columns it lacks are null."""
    path = new_work_path(spark, "corpus")
    sinks.save_dataset(views.functions(spark, sf_dir), path)
    rows = readers.dataset(spark, path)
    return rows.select(
        "idx",
        "path",
        "fname",
        "token_length",
        F.col("llvm_ir.bb_count.bbcount").alias("bbcount"),
        F.col("synth_exe_wrapper").isNull().alias("no_wrapper"),
    )


@query(ctes("fn") + " SELECT idx, path FROM fn WHERE NOT is_valid")
def named_split(spark, sf_dir):
    """One split of a corpus partitioned by split."""
    path = new_work_path(spark, "splits")
    views.functions(spark, sf_dir).write.partitionBy("split").parquet(path)
    return readers.split(spark, path, "test_synth").select("idx", "path")


@query(ctes("fn") + " SELECT idx, shard, path FROM fn")
def shards_by_template(spark, sf_dir):
    """Eight shards found by an index template."""
    path = new_work_path(spark, "shards")
    views.functions(spark, sf_dir).select("idx", "path", "shard").write.partitionBy("shard").parquet(path)
    return readers.shards(spark, path + "/shard={idx}", list(range(8))).select("idx", "shard", "path")


PER_FILE = 250


@query(
    f"""
WITH p AS (SELECT d.doc_id, text, doc_id % 3 AS kind, quality, toxic,
    row_number() OVER (ORDER BY d.doc_id) - 1 AS idx FROM documents d JOIN labels USING (doc_id))
SELECT idx, 'd' || doc_id AS file, CASE WHEN kind = 1 THEN 2 ELSE 1 END AS n_predict,
  CASE kind WHEN 0 THEN text WHEN 1 THEN 'first' ELSE '[' || text END AS first_predict,
  CASE WHEN kind = 1 THEN text END AS second_predict, quality = 1 AS compiled,
  CASE WHEN kind = 1 THEN toxic = 1 END AS second_compiled FROM p"""
)
def prediction_files(spark, sf_dir):
    """Prediction files of one JSON array each; a prediction is a text, a list, or a text that starts like a list."""
    doc = views.table(spark, sf_dir, "documents").join(views.table(spark, sf_dir, "labels"), "doc_id")
    kind, quality, toxic = F.col("doc_id") % 3, F.col("quality") == 1, F.col("toxic") == 1

    def entry(predict, compiled):
        fields = F.struct(
            F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file"),
            predict.alias("predict"),
            compiled.alias("predict_compile_success"),
        )
        return F.to_json(fields)

    line = (
        F.when(kind == 0, entry(F.col("text"), quality))
        .when(kind == 1, entry(F.array(F.lit("first"), "text"), F.array(quality, toxic)))
        .otherwise(entry(F.concat(F.lit("["), "text"), quality))
    )
    part = F.lpad(F.expr(f"div(doc_id, {PER_FILE})").cast("string"), 15, "0")
    files = doc.groupBy(part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("doc_id", line.alias("line")))).alias("rows"))
    path = new_work_path(spark, "predictions")
    files.select("part", F.concat(F.lit("["), F.array_join("rows.line", ",\n"), F.lit("]"))).write.partitionBy("part").text(path)
    return readers.predictions(spark, path).select(
        "idx",
        "file",
        F.size("predict").cast("long").alias("n_predict"),
        F.get("predict", F.lit(0)).alias("first_predict"),
        F.get("predict", F.lit(1)).alias("second_predict"),
        F.get("predict_compile_success", F.lit(0)).alias("compiled"),
        F.get("predict_compile_success", F.lit(1)).alias("second_compiled"),
    )


@query(
    ctes("pred")
    + """
SELECT idx, key, CASE WHEN idx < 1000000000000 THEN 2 ELSE 1 END AS n_predict, text, any_compile, any_exec, t_compile, t_exec FROM pred"""
)
def results_as_lines(spark, sf_dir):
    """Validation results written as JSON lines and read as predictions."""
    path = new_work_path(spark, "results")
    sinks.save_results_json(views.predictions(spark, sf_dir), path)
    rows = scoring.with_prediction_key(readers.predictions_lines(spark, path))
    return rows.select(
        "idx",
        "key",
        F.size("predict").cast("long").alias("n_predict"),
        F.element_at("predict", -1).alias("text"),
        scoring.any_true(F.col("predict_compile_success")).alias("any_compile"),
        scoring.any_true(F.col("predict_execution_success")).alias("any_exec"),
        F.col("target_compile_success").alias("t_compile"),
        F.col("target_execution_success").alias("t_exec"),
    )


#: Small files that one task writes, about.
FILES_A_TASK = 256


def _error_files(spark, sf_dir):
    """One error file per supplier, in a folder of its nation."""
    number = F.col("s_suppkey")
    place = F.concat(F.lit("llc: error: llc: /tmp/"), "s_name", F.lit(":"), number.cast("string"), F.lit(":5: error: "))
    text = F.concat(
        place,
        F.when(number % 2 == 0, F.lit("expected top-level entity")).otherwise(
            F.concat(F.lit("use of undefined value '%"), (number % 5).cast("string"), F.lit("'"))
        ),
        F.lit("\n  %9 = load\n     ^"),
    )
    rows = views.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), number.alias("supplier"), text)
    path = new_work_path(spark, "errors")
    # a file costs far more than its row, so a small table is still many tasks
    tasks = rows.count() // FILES_A_TASK + 1
    rows.repartition(tasks, "nation", "supplier").write.partitionBy("nation", "supplier").text(path)
    return path


def _supplier():
    return F.regexp_extract("file", r"/supplier=(\d+)/", 1).cast("long").alias("supplier")


@query(
    """
SELECT s_suppkey AS supplier, 3 AS n_lines, s_suppkey % 2 = 0 AS top_level FROM supplier"""
)
def error_file_tree(spark, sf_dir):
    """All error files below a folder, found by name, each as one text."""
    files = readers.error_files(spark, _error_files(spark, sf_dir), "part-*.txt")
    lines = F.size(F.split(F.rtrim(F.col("error_msg"), F.lit("\n")), "\n"))
    return files.select(
        _supplier(), lines.cast("long").alias("n_lines"), F.contains("error_msg", F.lit("top-level")).alias("top_level")
    )


@query(
    """
SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'expected top-level entity'
    ELSE 'use of undefined value ''%' || (s_suppkey % 5) || '''' END AS error_type, s_suppkey AS supplier
FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 4 = 1"""
)
def error_index_of_manifests(spark, sf_dir):
    """Error types of the files that two manifests list; a file that both list counts once."""
    root = _error_files(spark, sf_dir)
    listed = readers.error_paths(spark, root, "part-*.txt").select("file", _supplier())
    manifests = []
    for wanted in ("supplier % 3 = 0", "supplier % 4 = 1 OR supplier % 6 = 0"):
        manifests.append(new_work_path(spark, "manifest"))
        listed.where(wanted).select(F.concat(F.lit("  "), "file", F.lit(" \n"))).write.text(manifests[-1])
    messages = readers.manifest_errors(spark, manifests, root, "part-*.txt")
    return error_stats.error_index(messages.select(_supplier(), "error_msg"), ["supplier"])


@query(ctes("ev") + " SELECT idx, retry, choice, comp AS compiled, exec_a AS executed, error_msg, llvm_ir FROM ev")
def run_round_trip(spark, sf_dir):
    """Evaluations of a run, saved by round and loaded."""
    path = new_work_path(spark, "run")
    sinks.save_run(views.evaluations(spark, sf_dir), path)
    rows = readers.run_results(spark, path)
    return rows.select(
        "idx",
        "retry",
        "choice",
        F.col("compile_success").alias("compiled"),
        F.col("execution_success").alias("executed"),
        "error_msg",
        "llvm_ir",
    )


@query(ctes("ev") + " SELECT idx, retry, choice, llvm_ir, strlen(llvm_ir) % 2 = 0 AS compiled FROM ev WHERE retry < 4 AND retry <> 2")
def rescored_run(spark, sf_dir):
    """Stored responses of the rounds before a limit, evaluated again; a round that is not there is skipped."""
    store = new_work_path(spark, "run")
    content = F.concat(F.lit("```llvm\n"), "llvm_ir", F.lit("\n```"))
    rows = views.evaluations(spark, sf_dir).where("retry <> 2")
    answers = rows.select("idx", "retry", "choice", content.alias("content"), F.lit(None).cast("string").alias("reasoning"))
    answers.write.partitionBy("retry").parquet(f"{store}/responses")

    def evaluate(df):
        return df.withColumn("compiled", F.octet_length("llvm_ir") % 2 == 0)

    run = repair.RepairRun(store, JobConfig(), lambda df: df, evaluate)
    return repair.rescore(spark, run, 4)


@query(
    ctes("ev")
    + """
SELECT retry, count(*) AS n, CAST(sum(strlen(llvm_ir)) AS BIGINT) AS n_bytes FROM ev WHERE retry < 6 GROUP BY 1"""
)
def stored_responses(spark, sf_dir):
    """Sizes of the stored responses of each round before a limit."""
    path = new_work_path(spark, "run")
    rows = views.evaluations(spark, sf_dir)
    nothing = F.lit(None).cast("string")
    answers = rows.select("idx", "retry", "choice", F.col("llvm_ir").alias("content"), nothing.alias("reasoning"))
    answers.write.partitionBy("retry").parquet(f"{path}/responses")
    saved = readers.saved_responses(spark, path, 6)
    return saved.groupBy("retry").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("content").cast("long")).alias("n_bytes")
    )


@query(ctes("fn") + " SELECT bbcount AS n_blocks, count(*) AS n FROM fn WHERE idx % 3 <> 0 GROUP BY 1")
def project_blocks(spark, sf_dir):
    """Block counts of a project table's entries that have them."""
    path = new_work_path(spark, "project")
    entry = F.col("func_info.functions")[0]
    rows = views.functions(spark, sf_dir)
    rows.select(entry["name"].alias("name"), F.when(F.col("idx") % 3 != 0, entry["bbcount"]).alias("bbcount")).write.parquet(path)
    return readers.project_block_counts(spark, path).groupBy("n_blocks").agg(F.count(F.lit(1)).alias("n"))


@query(
    """
SELECT CAST(vec_id % 8 AS INTEGER) AS shard, vec_id // 8 AS record_id, count(*) AS n FROM embeddings
WHERE vec_id % 8 < 3 OR vec_id % 16 >= 8 GROUP BY ALL"""
)
def rebuilt_shards(spark, sf_dir):
    """A collection whose shards 3 to 7 are built again from half of their vectors, scanned for its record ids."""
    path = new_work_path(spark, "collection")
    vectors = views.vectors(spark, sf_dir)
    sinks.save_vectors(vectors, path)
    sinks.save_vectors(vectors.where("shard between 3 and 7 and point_id % 16 >= 8"), path)
    return readers.collection_ids(spark, path).groupBy("shard", "record_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    """
WITH v AS (SELECT vec_id % 8 AS shard, vec_id // 8 AS record_id, vec_id FROM embeddings WHERE vec_id % 8 BETWEEN 3 AND 7),
p AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY record_id) - 1 AS point_id FROM v)
SELECT CAST(shard AS INTEGER) AS shard, point_id, record_id, 'v' || vec_id AS path FROM p"""
)
def built_shard_list(spark, sf_dir):
    """Points of the shards 3 to 7, built and saved in one job."""
    vectors = views.vectors(spark, sf_dir).where("shard between 3 and 7")
    name = F.concat(F.lit("v"), F.col("point_id").cast("string")).alias("path")
    path = new_work_path(spark, "collection")
    sinks.save_vectors(retrieval.build_points(vectors.select("shard", "record_id", name), vectors), path)
    return spark.read.parquet(path).select("shard", "point_id", "record_id", "path")


@query(
    """
SELECT doc_id AS idx, quality FROM labels ORDER BY md5(doc_id || ':42'), doc_id LIMIT 20"""
)
def saved_sample(spark, sf_dir):
    """A seeded sample saved once and read back."""
    path = new_work_path(spark, "sample")
    sinks.save_sample(views.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx"), "quality"), path, 20)
    return spark.read.parquet(path)


@query(ctes("fn") + " SELECT idx, ';cpath: ' || path || chr(10) || code AS text FROM fn")
def ir_dump(spark, sf_dir):
    """IR texts under a line that names their source."""
    path = new_work_path(spark, "ir")
    sinks.dump_ir(views.functions(spark, sf_dir), path)
    return spark.read.parquet(path)


@query(ctes("ev") + " SELECT idx, llvm_ir FROM ev WHERE exec_a AND retry = 2 QUALIFY row_number() OVER (PARTITION BY idx ORDER BY choice) = 1")
def exported_correct_code(spark, sf_dir):
    path = new_work_path(spark, "correct")
    sinks.export_correct_ir(views.evaluations(spark, sf_dir), 2, path)
    return spark.read.parquet(path)


@query(
    """
SELECT doc_id AS idx, -1 AS retry, 'basic' AS prompt_type, CASE WHEN doc_id % 2 = 0 THEN text ELSE 'later ' || lang END AS prompt
FROM documents"""
)
def prompts_stored_once(spark, sf_dir):
    """Prompts stored in two runs; what the first one stored stays."""
    doc = views.table(spark, sf_dir, "documents")
    path = new_work_path(spark, "prompts")

    def store(rows, prompt):
        asked = rows.select(
            F.col("doc_id").alias("idx"), F.lit(-1).alias("retry"), F.lit("basic").alias("prompt_type"), prompt.alias("prompt")
        )
        return stages.cached_stage(asked, ["idx", "retry"], path, PROMPTS, lambda df: df, ["retry"])

    store(doc.where("doc_id % 2 = 0"), F.col("text"))
    return store(doc, F.concat(F.lit("later "), "lang"))


@query(
    """
SELECT doc_id AS idx, text AS func_def, TRUE AS no_path, 0 AS n_signature, 0 AS n_code, 0 AS n_inputs, TRUE AS no_counts FROM documents"""
)
def normalized_records(spark, sf_dir):
    """Raw rows of two columns brought to the record schema: absent lists are empty, other absent values null."""
    raw = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), F.col("text").alias("func_def"))
    rows = records.normalize_record(raw)
    size = lambda c: F.size(c).cast("long")
    return rows.select(
        "idx",
        "func_def",
        F.col("path").isNull().alias("no_path"),
        size("signature").alias("n_signature"),
        size("llvm_ir.code").alias("n_code"),
        size("synth_io_pairs.input").alias("n_inputs"),
        F.col("llvm_ir.bb_count.bbcount").isNull().alias("no_counts"),
    )


@query(
    ctes("ev")
    + """
, r AS (SELECT idx, retry, count(*) FILTER (comp) AS c, count(*) FILTER (exec_a) AS e FROM ev GROUP BY 1, 2)
SELECT '| idx | retry | n_executed | n_compiled |' AS line UNION ALL SELECT '|---|---|---|---|'
UNION ALL SELECT '# Rounds' UNION ALL SELECT '' UNION ALL SELECT '' UNION ALL SELECT 'All rounds.'
UNION ALL SELECT '| ' || idx || ' | ' || retry || ' | ' || e || ' | ' || c || ' |' FROM r"""
)
def markdown_report(spark, sf_dir):
    """A report of all rounds as the lines of a Markdown text."""
    rows = outcomes.round_summary(views.evaluations(spark, sf_dir)).select("idx", "retry", "n_executed", "n_compiled")
    path = new_work_path(spark, "report")
    reports.write_markdown(rows, path, ["idx", "retry"], "Rounds", "All rounds.")
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(
    ctes("pred", "corpus")
    + """
SELECT 'run' AS run, idx, key, any_compile AS predict_compile, any_exec AS predict_execution, t_compile AS target_compile,
  t_exec AS target_execution FROM pred_last SEMI JOIN corpus USING (key)"""
)
def streamed_scores(spark, sf_dir):
    """Prediction tables that arrive in two steps, scored as they come; the last row of a key counts."""
    source, store = new_work_path(spark, "arrivals"), new_work_path(spark, "scores")
    corpus, rows = views.functions(spark, sf_dir), views.predictions(spark, sf_dir)
    for part in (F.col("idx") % 2 == 0, F.col("idx") % 2 == 1):
        rows.where(part).write.mode("append").parquet(source)
        score_stream(spark, source, corpus, store, f"{store}-progress", "run").awaitTermination()
    return current_scores(spark.read.parquet(store))
