"""Row enrichment of function records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from irquarry.functions.code import normalize_prediction
from irquarry.functions.text import word_count
from irquarry.schemas import BB_COUNT_FIELDS, FUNC_INFO, FUNCTION_ENTRY, FUNCTIONS, struct


def last_code(block: str) -> Column:
    """Last code version of a nested block; null for an empty one."""
    return F.try_element_at(F.col(f"{block}.code"), F.lit(-1))


def first_code(block: str) -> Column:
    return F.get(F.col(f"{block}.code"), F.lit(0))


def inst_count() -> Column:
    """Instructions of a record, summed over its blocks; null without counts."""
    sizes = F.col("llvm_ir.bb_count.bb_list_size")
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda acc, x: acc + x)


def training_pairs(functions: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """Last assembly as input, first IR as output, for the positions ``[start, end)``.

    Positions are cut before the empty-IR filter, so fewer rows than ``end - start`` may remain.
    """
    return (
        row_range(functions, start, end)
        .where(F.size("llvm_ir.code") > 0)
        .select(
            "idx",
            last_code("asm").alias("input"),
            first_code("llvm_ir").alias("output"),
            F.col("path").alias("file"),
        )
    )


def row_range(df: DataFrame, start: int, end: int | None) -> DataFrame:
    """Rows of the positions ``[start, end)``, to the last one without an ``end``.

    It is a filter that reaches the scan, not a limit.
    """
    rows = df.where(F.col("idx") >= start) if start else df
    return rows if end is None else rows.where(F.col("idx") < end)


def normalize_record(raw: DataFrame) -> DataFrame:
    """Bring a raw table to the fixed record schema: absent values null, absent lists empty."""
    schema = struct(FUNCTIONS)
    given = set(raw.columns)

    def value(field):
        column = F.col(field.name) if field.name in given else F.lit(None)
        return column.cast(field.dataType)

    def filled(column, dtype):
        if isinstance(dtype, T.ArrayType):
            return F.coalesce(column, F.array().cast(dtype))
        if isinstance(dtype, T.StructType) and column_has_lists(dtype):
            return F.struct(*[filled(column[f.name], f.dataType).alias(f.name) for f in dtype])
        return column

    def column_has_lists(dtype):
        return dtype.fieldNames() != struct(BB_COUNT_FIELDS).fieldNames()

    return raw.select(*[filled(value(f), f.dataType).alias(f.name) for f in schema])


def attach_bb_count(functions: DataFrame, counts: DataFrame) -> DataFrame:
    """Attach block counts by ``idx``; rows without a count get null."""
    side = counts.select("idx", F.col("bb_count").alias("_bb_count"))
    return (
        functions.join(side, "idx", "left")
        .withColumn("llvm_ir", F.col("llvm_ir").withField("bb_count", F.col("_bb_count")))
        .drop("_bb_count")
    )


def default_func_info() -> Column:
    """The single empty function that stands for unparsable IR."""
    entry = F.from_json(
        F.lit(
            '{"name": "", "called_functions": [], "num_loops": 0, "has_defined_structs": false,'
            ' "has_globals": false, "struct_args": false, "unused_args": []}'
        ),
        FUNCTION_ENTRY,
    )
    return F.struct(F.array(entry).alias("functions"))


def attach_func_info(functions: DataFrame, info_json: str, strict: bool = False) -> DataFrame:
    """Parse the analysis output of column ``info_json`` into ``func_info``.

    Unless ``strict``, output without a function list becomes the default entry.
    """
    parsed = F.from_json(F.col(info_json), FUNC_INFO)
    if not strict:
        parsed = F.when(parsed["functions"].isNull(), default_func_info()).otherwise(parsed)
    return functions.withColumn("func_info", parsed)


def attach_token_length(functions: DataFrame, measure=word_count) -> DataFrame:
    return functions.withColumn("token_length", measure(last_code("asm")).cast("int"))


def attach_prediction_lengths(predictions: DataFrame, measure=word_count) -> DataFrame:
    """Lengths of the input and of the first prediction; rows without prediction are dropped."""
    return (
        predictions.where(F.size("predict") > 0)
        .withColumn("input_length", measure(F.col("input")))
        .withColumn("predict_length", measure(F.get(F.col("predict"), F.lit(0))))
    )


def single_function_view(functions: DataFrame) -> DataFrame:
    """The typed view of one-function records; other records carry a quarantine reason."""
    size = F.coalesce(F.size("func_info.functions"), F.lit(0))
    entry = F.get(F.col("func_info.functions"), F.lit(0))
    fields = (
        "called_functions",
        "num_loops",
        "has_defined_structs",
        "has_globals",
        "struct_args",
        "unused_args",
    )
    return functions.select(
        "idx",
        entry["name"].alias("func_name"),
        *[entry[f].alias(f) for f in fields],
        F.col("llvm_ir.bb_count.bb_list_size").alias("bb_count_list"),
        F.when(size != 1, F.concat(F.lit("functions: "), size.cast("string"))).alias("quarantine"),
    )


def function_name() -> Column:
    """Name of the first function, or a name made of the position."""
    name = F.get(F.col("func_info.functions"), F.lit(0))["name"]
    return F.coalesce(name, F.concat(F.lit("func_"), F.col("idx").cast("string")))


def function_names() -> Column:
    """Names of all functions of a module."""
    return F.transform(F.col("func_info.functions"), lambda f: f["name"])


def normalize_predictions(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn("predict", normalize_prediction(F.col("predict")))


def sample_view(functions: DataFrame, predictions: DataFrame, choice: int) -> DataFrame:
    """Flat rows for a viewer: original texts, the chosen prediction and the four flags.

    A choice outside a record's predictions gives a message instead of a prediction.
    """
    picked = F.get(F.col("predict"), F.lit(choice))
    flag = lambda name: F.coalesce(F.get(F.col(name), F.lit(choice)), F.lit(False))
    return functions.select(
        "idx",
        "path",
        last_code("llvm_ir").alias("target_ir"),
        last_code("asm").alias("target_assembly"),
    ).join(
        predictions.select(
            "idx",
            F.coalesce(picked, F.lit("")).alias("predict"),
            F.when(picked.isNull(), F.lit("choice out of range")).alias("message"),
            flag("predict_compile_success").alias("predict_compile_success"),
            flag("predict_execution_success").alias("predict_execution_success"),
            "target_compile_success",
            "target_execution_success",
        ),
        "idx",
    )
