"""Prompt assembly as column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from irquarry.config import PROMPT_TYPES, JobConfig
from irquarry.functions.text import is_blank, normalize_listing, strip
from irquarry.functions.vectors import cosine
from irquarry.operators import prompt_texts as texts

_SCORE_DIGITS = 9


def render(template: str, **values: Column) -> Column:
    """The template with its placeholders replaced by columns; null counts as empty."""
    parts: list[Column] = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name:
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*parts)


def initial_prompt(config: JobConfig) -> Column:
    """First prompt of a record, by the run's strategy.

    Reads the columns the strategy needs among asm, pcode, similar_asm, similar_ir,
    similar_pcode and c_code.
    """

    def listing(name: str) -> Column:
        return normalize_listing(F.col(name), remove_comments=config.remove_comments)

    if config.prompt_type == "in-context-learning":
        if config.use_pcode:
            return render(
                texts.PCODE_SIMILAR,
                pcode=F.col("pcode"),
                similar_pcode=F.col("similar_pcode"),
                similar_llvm_ir=F.col("similar_ir"),
            )
        return render(
            texts.SIMILAR,
            asm_code=listing("asm"),
            similar_asm_code=listing("similar_asm"),
            similar_llvm_ir=F.col("similar_ir"),
        )
    if config.prompt_type == "ghidra-decompile" and not config.use_pcode:
        return render(texts.WITH_C, asm_code=listing("asm"), ghidra_c_code=F.col("c_code"))
    if config.use_pcode:
        return render(texts.PCODE, p_code=F.col("pcode"))
    return render(texts.BASIC, asm_code=listing("asm"))


def compile_fix(initial: Column, predict: Column, error: Column) -> Column:
    return F.concat(initial, render(texts.COMPILE_ERROR, predict=predict, error_msg=error))


def execution_fix(initial: Column, predict: Column, assembly: Column) -> Column:
    return F.concat(
        initial, render(texts.EXECUTION_ERROR, predict=predict, predict_assembly=assembly)
    )


def execution_fix_with_c(initial: Column, predict: Column, c_code: Column) -> Column:
    return F.concat(
        initial,
        render(texts.EXECUTION_ERROR_WITH_C, predict=predict, predict_ghidra_c_code=c_code),
    )


def analysis_fix(initial: Column, predict: Column, assembly: Column, analysis: Column) -> Column:
    return F.concat(
        initial,
        render(
            texts.ANALYSIS_FIX, predict_llvm_ir=predict, predict_assembly=assembly, analysis=analysis
        ),
    )


def trace_fix(
    initial: Column, predict: Column, assembly: Column, target_trace: Column, predict_trace: Column
) -> Column:
    return F.concat(
        initial,
        render(
            texts.TRACE_FIX,
            predict_llvm_ir=predict,
            predict_assembly=assembly,
            target_execution_trace=target_trace,
            predict_execution_trace=predict_trace,
        ),
    )


def analysis_prompt(target: Column, predict: Column, assembly: Column, error: Column) -> Column:
    """Request for a failure analysis; absent parts leave their section out."""

    def section(heading: str, body: Column, present: Column) -> Column:
        return F.when(F.coalesce(present, F.lit(False)), F.concat(F.lit(heading), body))

    return F.concat_ws(
        "\n\n",
        F.lit(texts.ANALYSIS_ROLE),
        section(texts.ANALYSIS_REFERENCE, target, target != ""),
        F.concat(F.lit(texts.ANALYSIS_PREDICTED), F.coalesce(predict, F.lit(""))),
        section(texts.ANALYSIS_ASSEMBLY, assembly, assembly != ""),
        section(texts.ANALYSIS_DIAGNOSTICS, error, ~is_blank(error)),
        F.lit(texts.ANALYSIS_INSTRUCTIONS),
    )


def instruction_prompt(
    template: dict, instruction: Column, input: Column, label: Column | None = None
) -> Column:
    """Instruction template with its input when there is one, and the label appended."""
    with_input = render(template["prompt_input"], instruction=instruction, input=input)
    without = render(template["prompt_no_input"], instruction=instruction)
    prompt = F.when(F.coalesce(input != "", F.lit(False)), with_input).otherwise(without)
    return prompt if label is None else F.concat(prompt, F.coalesce(label, F.lit("")))


def instruction_response(template: dict, output: Column) -> Column:
    """Text between the first and second response marker; null without a marker."""
    marker = F.lit(template["response_split"])
    return F.when(F.contains(output, marker), strip(F.split_part(output, marker, F.lit(2))))


def candidate_preference() -> Column:
    """Order of the choices a repair may start from: compiled, most like the target, earliest."""
    ok = F.coalesce("compile_success", F.lit(False))
    score = F.round(cosine(F.col("embedding"), F.col("target_embedding")), _SCORE_DIGITS)
    unknown = F.lit(-2.0)
    return F.struct(
        ok.alias("ok"),
        F.when(ok, F.coalesce(score, unknown)).otherwise(unknown).alias("score"),
        (-F.col("choice")).alias("early"),
    )


def fix_basis(previous: DataFrame, by: tuple[str, ...] = ("idx",)) -> DataFrame:
    """One row per record with all a fix prompt needs of the previous round.

    ``previous`` holds the round's evaluations with columns embedding and target_embedding
    (null where unknown).  Groups are bounded by the number of generated choices.  Several rounds
    at once are told apart by ``by``.
    """
    ok = F.coalesce("compile_success", F.lit(False))
    message = strip(F.coalesce("error_msg", F.lit("")))
    with_error = F.when(message != "", F.col("choice"))
    chosen = F.struct("choice", "llvm_ir", "assembly")
    return previous.groupBy(*by).agg(
        F.count_if(F.coalesce("execution_success", F.lit(False))).alias("n_executed"),
        F.count_if(ok).alias("n_compiled"),
        F.min_by(F.struct(message.alias("error"), F.col("llvm_ir").alias("predict")), with_error).alias("failed"),
        F.min_by("llvm_ir", "choice").alias("first_predict"),
        F.max_by(chosen, candidate_preference()).alias("best"),
    )


def fix_prompt(config: JobConfig, initial: Column) -> Column:
    """Next prompt from a ``fix_basis`` row (and c_code, for the strategy that needs it).

    A prompt type without a form for code that compiled fails at such a record; the others get the compile fix.
    """
    failed_predict = F.coalesce(F.nullif(F.col("failed.predict"), F.lit("")), F.col("first_predict"))
    compile_part = compile_fix(initial, failed_predict, F.coalesce("failed.error", F.lit("")))
    assembly = normalize_listing(F.col("best.assembly"), remove_comments=config.remove_comments)
    if config.prompt_type in ("ghidra-decompile", "in-context-learning"):
        run_part = execution_fix(initial, F.col("best.llvm_ir"), assembly)
    elif config.prompt_type == "ghidra-decompile-with-predict":
        # The assembly stands in the place of the prediction here.
        run_part = execution_fix_with_c(initial, assembly, F.col("c_code"))
    else:
        run_part = F.raise_error(F.lit(f"no fix prompt for prompt type {config.prompt_type}"))
    return F.when(F.col("n_compiled") == 0, compile_part).otherwise(run_part)


def validated_types(df: DataFrame, column: str = "prompt_type") -> DataFrame:
    """Rows with a known prompt strategy; an unknown one fails the job."""
    known = F.col(column).isin(*PROMPT_TYPES)
    message = F.concat(F.lit("unknown prompt type: "), F.col(column))
    return df.withColumn(column, F.when(known, F.col(column)).otherwise(F.raise_error(message)))
