"""Readers.  Every reader gives rows a stable position ``idx`` where the source has none."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from irquarry.functions.text import strip
from irquarry.operators.ranking import chunked_rank
from irquarry.operators.stages import read_store
from irquarry.schemas import EVALUATIONS, FUNCTIONS, PREDICTIONS, RESPONSES
from irquarry.session import new_work_path


def positioned(spark: SparkSession, paths: str | list[str], schema: str | None = None) -> DataFrame:
    """Parquet rows with ``idx``: files in name order, rows in file order.

    The position comes from the file itself (path and row index); one small row per file gives
    the offsets, and no row is sorted.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = reader.parquet(*paths)
    rows = df.drop("idx").select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.row_index").alias("_row"),
    )
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("_file")
        .agg((F.max("_row") + 1).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .select("_file", "_offset")
    )
    return (
        rows.join(offsets, "_file")
        .withColumn("idx", F.col("_offset") + F.col("_row"))
        .drop("_file", "_row", "_offset")
    )


def dataset(spark: SparkSession, path: str, schema: str = FUNCTIONS) -> DataFrame:
    """A saved corpus; rows already carry their position."""
    return spark.read.schema(schema).parquet(path)


def split(spark: SparkSession, path: str, name: str, schema: str = FUNCTIONS) -> DataFrame:
    """A named split of a corpus partitioned by ``split``."""
    return spark.read.schema(schema).parquet(path).where(F.col("split") == name)


def shards(spark: SparkSession, template: str, ids: list[int], schema: str = FUNCTIONS) -> DataFrame:
    """Shards found by an index template such as ``.../part_{idx}``, with their ``shard``."""
    frames = [
        spark.read.schema(schema)
        .parquet(template.format(idx=i))
        .withColumn("shard", F.lit(i))
        for i in ids
    ]
    return reduce(DataFrame.unionByName, frames)


def merged(sharded: DataFrame, shard: str = "shard") -> DataFrame:
    """All shards as one table in shard order: ``idx`` becomes the position in the whole."""
    earlier = Window.orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sharded.groupBy(shard)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .select(shard, "_before")
    )
    ranked = chunked_rank(sharded, "idx", "_rank", by=[shard])
    return (
        ranked.join(offsets, shard)
        .withColumn("idx", F.col("_before") + F.col("_rank") - 1)
        .drop("_rank", "_before")
    )


def _as_array(text: Column, element: str) -> Column:
    """A value that is a JSON list or a single value, as an array; a text that only starts like a list is single."""
    many = F.from_json(text, f"array<{element}>")
    one = F.array(text.cast(element) if element != "string" else text)
    return F.when(text.startswith("["), F.coalesce(many, one)).when(text.isNotNull(), one)


def json_array_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, element, text) of the objects in files that hold one JSON array each; ``element`` counts within the file.

    Spark's splittable text reader cuts the files at closing braces.  A piece's quotes and braces say how it changes the state, inside
    a string or not and how deep, for either state it may start in; running sums over pieces, then over splits (one row each), settle
    the state everywhere, and an object ends where a brace outside of strings closes the last open one.  No file is
    read by one task, and what an element's text spans only decides which pieces are joined.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)
    pieces = pieces.withColumn("_parts", parts)

    def opened(inside: int) -> Column:
        text = F.array_join(F.filter("_parts", lambda p, i: i % 2 == inside), "")
        return F.length(text) - F.length(F.replace(text, F.lit("{")))

    flips = (F.size("_parts") - 1) % 2
    pieces = pieces.withColumns(
        {"_flips": flips} | {f"_d{inside}": opened(inside) - (flips == inside).cast("int") for inside in (0, 1)}
    ).drop("_parts")

    split = Window.partitionBy("file", "block").orderBy("at")
    before, upto = (split.rowsBetween(Window.unboundedPreceding, last) for last in (-1, 0))
    pieces = pieces.withColumn("_state", F.coalesce(F.sum("_flips").over(before), F.lit(0)) % 2)
    changed = {start: F.when(F.col("_state") == start, F.col("_d0")).otherwise(F.col("_d1")) for start in (0, 1)}
    pieces = pieces.withColumns({f"_r{start}": F.sum(change).over(upto) for start, change in changed.items()})
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = pieces.groupBy("file", "block").agg(
        (F.sum("_flips") % 2).alias("_flips"), F.max_by("_r0", "at").alias("_r0"), F.max_by("_r1", "at").alias("_r1")
    )
    blocks = blocks.withColumn("_start", F.coalesce(F.sum("_flips").over(earlier), F.lit(0)) % 2)
    moved = F.when(F.col("_start") == 0, F.col("_r0")).otherwise(F.col("_r1"))
    blocks = blocks.select("file", "block", "_start", F.coalesce(F.sum(moved).over(earlier), F.lit(0)).alias("_depth"))

    placed = pieces.join(blocks, ["file", "block"])
    depth = F.col("_depth") + F.when(F.col("_start") == 0, F.col("_r0")).otherwise(F.col("_r1"))
    outside = (F.col("_start") + F.col("_state") + F.col("_flips")) % 2 == 0
    placed = placed.withColumn("_ends", (outside & (depth == 0)).cast("long"))
    ended = placed.groupBy("file", "block").agg(F.sum("_ends").alias("_n"))
    ended = ended.select("file", "block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    numbered = placed.join(ended, ["file", "block"]).withColumn(
        "element", F.col("_first") + F.coalesce(F.sum("_ends").over(before), F.lit(0))
    )
    found = numbered.groupBy("file", "element").agg(
        F.sort_array(F.collect_list(F.struct("block", "at", "value"))).alias("_pieces"), F.max("_ends").alias("_whole")
    )
    text = F.concat(F.array_join("_pieces.value", "}"), F.lit("}"))
    return found.where("_whole = 1").select("file", "element", F.regexp_replace(text, r"^[^{]*", "").alias("text"))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction files holding one JSON array of objects each; scalars and lists become arrays.

    ``idx`` counts through all files, in name order.
    """
    fields = "file STRING, func_head_types STRING, input STRING, instruction STRING, output STRING, "
    fields += "predict STRING, predict_compile_success STRING, predict_execution_success STRING, "
    fields += "target_compile_success BOOLEAN, target_execution_success BOOLEAN"
    elements = json_array_elements(spark, path)
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    sizes = elements.groupBy("file").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    rows = elements.join(offsets, "file").select(
        (F.col("_offset") + F.col("element")).alias("idx"), F.from_json("text", fields).alias("_r")
    )
    return _unioned(rows.select("idx", "_r.*"))


def predictions_lines(spark: SparkSession, path: str) -> DataFrame:
    """Prediction rows as JSON lines with their own ``idx``; splittable, for large files."""
    fields = "idx LONG, file STRING, func_head_types STRING, input STRING, instruction STRING, "
    fields += "output STRING, predict STRING, predict_compile_success STRING, "
    fields += "predict_execution_success STRING, target_compile_success BOOLEAN, "
    fields += "target_execution_success BOOLEAN"
    return _unioned(spark.read.schema(fields).json(path))


def _unioned(rows: DataFrame) -> DataFrame:
    strings = ("output", "predict")
    flags = ("predict_compile_success", "predict_execution_success")
    return rows.withColumns(
        {c: _as_array(F.col(c), "string") for c in strings}
        | {c: _as_array(F.col(c), "boolean") for c in flags}
    ).select(*[c.split()[0] for c in PREDICTIONS.split(", ")])


#: Tasks that list the folders of one level.
LISTING_TASKS = 64
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
#: Files whose states the driver holds at once, about, and folders that are counted at once.
LISTED_FILES = 20_000
COUNTED_AT_ONCE = 8


def _hidden(name: str) -> bool:
    """Spark passes over what has such a name below a folder."""
    if name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def _folder_batches(spark: SparkSession, root: str) -> list[list[str]]:
    """Paths that hold all files which Spark lists below a folder, in batches of about LISTED_FILES files, as patterns.

    Folders are counted, not listed; one of more files is replaced by what lies in it.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def counted(status) -> tuple:
        at = status.getPath()
        return at, status.isDirectory(), fs.getContentSummary(at).getFileCount() if status.isDirectory() else 1

    level, parts = list(fs.globStatus(path) or []), []
    with ThreadPoolExecutor(COUNTED_AT_ONCE) as pool:
        while level:
            found, level = list(pool.map(counted, level)), []
            if not parts and sum(n for *_, n in found) <= LISTED_FILES:
                break
            for at, folder, n in found:
                if folder and n > LISTED_FILES:
                    level += [child for child in fs.listStatus(at) if not _hidden(child.getPath().getName())]
                elif n:
                    parts.append((re.sub(r"([\\{}\[\]*?])", r"\\\1", at.toString()), n))
    batches, held = [], 0
    for part, n in parts:
        if not batches or held + n > LISTED_FILES:
            batches.append([])
            held = 0
        batches[-1].append(part)
        held += n
    return batches or [[root]]


def _named_files(spark: SparkSession, root: str | list[str], name: str, source: str = "text") -> DataFrame:
    """Files of one name below a folder.  A task lists many folders: a task for each is what Spark does with up to 10,000 of them."""
    before = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, str(min(int(before), LISTING_TASKS)))
    try:
        reader = spark.read.format(source).option("recursiveFileLookup", True).option("pathGlobFilter", name)
        return reader.options(**({"wholetext": True} if source == "text" else {})).load(root)
    finally:
        spark.conf.set(_LISTING, before)


def _texts_of(files: DataFrame) -> DataFrame:
    return files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("error_msg"))


def error_files(spark: SparkSession, root: str, name: str = "error_predict.error") -> DataFrame:
    """All files of one exact name below a folder: (file, text) rows."""
    return _texts_of(_named_files(spark, root, name))


def error_paths(spark: SparkSession, root: str, name: str = "error_predict.error") -> DataFrame:
    """The paths of the same files, of which none is opened.  Runs jobs where they are too many to be listed at once."""
    batches = _folder_batches(spark, root)
    return _paths_below(spark, root, name) if len(batches) == 1 else _stored_paths(spark, batches, name).select("file")


def _paths_below(spark: SparkSession, root: str | list[str], name: str) -> DataFrame:
    return _named_files(spark, root, name, "binaryFile").select(F.col("_metadata.file_path").alias("file"))


def _stored_paths(spark: SparkSession, batches: list[list[str]], name: str) -> DataFrame:
    """Paths of the files of all batches and the number of each one's batch (``part``); the driver lists a batch at a time."""
    path = new_work_path(spark, "paths")
    for part, folders in enumerate(batches):
        paths = _paths_below(spark, folders, name).withColumn("part", F.lit(part))
        paths.coalesce(LISTING_TASKS).write.mode("append").parquet(path)
    return spark.read.schema("file string, part int").parquet(path)


def manifest_paths(spark: SparkSession, manifests: str | list[str]) -> DataFrame:
    """File paths of one or more manifests, one per line, stripped."""
    return spark.read.text(manifests).select(strip(F.col("value")).alias("file")).where("file <> ''")


#: Listed files that are read at once.
MANIFEST_BATCH = 10_000


def _uris(path: str, root: str) -> list[str]:
    """The ways the path of a listed file may be spelled by Spark."""
    scheme = root.split("://")[0] + "://" + root.split("://")[1].split("/")[0] if "://" in root else "file://"
    bare = re.sub(r"^(?:file:)?/+", "/", path)
    if not bare.startswith("/"):
        return [bare, quote(bare, safe="/:=")]
    names = {bare, quote(bare, safe="/=:@!$&'()*+,;~")}
    return [prefix + name for name in names for prefix in ("", scheme, "file:", "file://")]


def listed_files(files: DataFrame, paths: list[str], root: str) -> DataFrame:
    """Rows of those files only: the filter on the path is settled when files are listed, so no other file is opened."""
    return files.where(F.col("_metadata.file_path").isin([u for p in paths for u in _uris(p, root)]))


def listed_files(files: DataFrame, paths: list[str], root: str) -> DataFrame:
    """Rows of those files only: the filter on the path is settled when files are listed, so no other file is opened."""
    return files.where(F.col("_metadata.file_path").isin([u for p in paths for u in _uris(p, root)]))


def manifest_errors(
    spark: SparkSession, manifests: str | list[str], root: str, name: str = "*", batch: int = MANIFEST_BATCH
) -> DataFrame:
    """Texts of the files below ``root`` that manifests list, each once; listed files that do not exist are passed over.

    Which listed files exist is settled by a join with the paths below ``root``, as Spark spells them.  Those that do come to the driver
    in batches of about ``batch`` paths, and a batch's texts are stored before the next one comes; only listed files are opened.  The driver
    holds the states of about LISTED_FILES files at a time, however many there are below ``root``.  Runs jobs.
    """
    folders = _folder_batches(spark, root)
    listed = manifest_paths(spark, manifests).select(F.regexp_replace("file", r"^(?:file:)?/+", "/").alias("path")).distinct()
    spelled = F.udf(lambda path: _uris(path, root), "array<string>")
    uris = listed.select(F.explode(spelled("path")).alias("file")).distinct()
    found = new_work_path(spark, "manifest-files")
    _stored_paths(spark, folders, name).join(uris, "file", "left_semi").write.parquet(found)
    known = spark.read.schema("file string, part int").parquet(found)
    stored = new_work_path(spark, "manifest-texts")
    schema = "file string, error_msg string"
    spark.createDataFrame([], schema).write.parquet(stored)
    for part, n in sorted(known.groupBy("part").count().collect()):
        files, batches = _named_files(spark, folders[part], name), n // batch + 1
        for turn in range(batches):
            mine = known.where((F.col("part") == part) & (F.pmod(F.xxhash64("file"), F.lit(batches)) == turn))
            paths = [r["file"] for r in mine.collect()]
            if paths:
                chosen = files.where(F.col("_metadata.file_path").isin(paths))
                _texts_of(chosen).coalesce(LISTING_TASKS).write.mode("append").parquet(stored)
    return spark.read.schema(schema).parquet(stored)


def run_results(spark: SparkSession, run_dir: str) -> DataFrame:
    """Saved evaluations of a run."""
    return read_store(spark, f"{run_dir.rstrip('/')}/evaluations", EVALUATIONS)


def saved_responses(spark: SparkSession, run_dir: str, num_retry: int = 10) -> DataFrame:
    """Saved responses of the rounds -1..num_retry-1; absent rounds are simply not there."""
    table = read_store(spark, f"{run_dir.rstrip('/')}/responses", RESPONSES)
    return table.where(F.col("retry") < num_retry)


def project_block_counts(spark: SparkSession, path: str) -> DataFrame:
    """Block counts of the functions of a project table, of entries that have them."""
    table = spark.read.schema("name STRING, bbcount ARRAY<INT>").parquet(path)
    return table.where(F.col("bbcount").isNotNull()).select(F.size("bbcount").alias("n_blocks"))


def collection_ids(spark: SparkSession, path: str) -> DataFrame:
    """Record ids held by a vector collection, per shard; no other column is read."""
    return spark.read.parquet(path).select("shard", "record_id")
