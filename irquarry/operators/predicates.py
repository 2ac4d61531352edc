"""Structural predicates, filter cascades and one-pass stage counts.

Predicates are column expressions over the nested record, so a cascade of them is one filter
in one scan, and its stage counts are one aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from irquarry.operators.records import inst_count, last_code

# Thresholds of the predicates.
MIN_INSTRUCTIONS = 50
HARD_BLOCKS = 3
MAX_TOKENS = 4096
BLOCK_THRESHOLDS = (5, 10, 20, 50)

_FUNCTIONS = "func_info.functions"


def _any(test) -> Column:
    return F.coalesce(F.exists(F.col(_FUNCTIONS), test), F.lit(False))


def no_unused_args() -> Column:
    return F.coalesce(F.forall(F.col(_FUNCTIONS), lambda f: F.size(f["unused_args"]) == 0), F.lit(True))


def uses_structs() -> Column:
    return _any(lambda f: f["has_defined_structs"])


def leaves_struct_fields_unread() -> Column:
    """Some struct-using function does not access all fields."""
    return _any(lambda f: f["has_defined_structs"] & ~f["all_struct_fields_accessed"])


def many_instructions(threshold: int = MIN_INSTRUCTIONS) -> Column:
    return F.coalesce(inst_count() > threshold, F.lit(False))


def has_loops() -> Column:
    return _any(lambda f: f["num_loops"] > 0)


def has_calls() -> Column:
    return _any(lambda f: F.size(f["called_functions"]) > 0)


def first_function_calls() -> Column:
    first = F.get(F.col(_FUNCTIONS), F.lit(0))
    return F.coalesce(F.size(first["called_functions"]) > 0, F.lit(False))


def _bbcount() -> Column:
    return F.col("llvm_ir.bb_count.bbcount")


def more_blocks_than(threshold: int = HARD_BLOCKS) -> Column:
    return F.coalesce(_bbcount() > threshold, F.lit(False))


def one_block() -> Column:
    return F.coalesce(_bbcount() == 1, F.lit(False))


def some_function_at_most(max_blocks: int = 20) -> Column:
    return _any(lambda f: F.size(f["bbcount"]) <= max_blocks)


def some_function_at_least(min_blocks: int) -> Column:
    return _any(lambda f: F.size(f["bbcount"]) >= min_blocks)


def short_enough(limit: int = MAX_TOKENS) -> Column:
    return F.coalesce(F.col("token_length") < limit, F.lit(False))


def last_code_present(block: str) -> Column:
    return F.coalesce(F.length(last_code(block)) > 0, F.lit(False))


def code_array_present(block: str) -> Column:
    return F.size(F.col(f"{block}.code")) > 0


def has_prediction() -> Column:
    return F.size("predict") > 0


def parser_accepted(tool: str = "tool") -> Column:
    """The external parser's exit code is zero."""
    return F.coalesce(F.col(f"{tool}.rc") == 0, F.lit(False))


def source_parses(compile_tool: str, parse_tool: str, info: str) -> Column:
    """False only for source that compiled but gave no function; the rest is caught later."""
    compiled = F.coalesce(F.col(f"{compile_tool}.rc") == 0, F.lit(False))
    no_function = F.coalesce(F.size(f"{info}.functions"), F.lit(0)) <= 0
    return ~(compiled & (~parser_accepted(parse_tool) | no_function))


def target_executes(compiled: str = "target_compile_success", executed: str = "target_execution_success") -> Column:
    return F.coalesce(F.col(compiled) & F.col(executed), F.lit(False))


def similar_enough(score: str = "score", threshold: float = 0.9) -> Column:
    return F.coalesce(F.col(score) > threshold, F.lit(False))


def cascade(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """Rows that pass every stage."""
    return df.where(reduce(lambda a, b: a & b, stages.values()))


def stage_counts(df: DataFrame, stages: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Rows left after each stage, as one row per group, from a single pass."""
    counts = [F.count(F.lit(1)).alias("n_input")]
    passed = F.lit(True)
    for name, test in stages.items():
        passed = passed & test
        counts.append(F.count_if(passed).alias(f"n_{name}"))
    return df.groupBy(*(by or [])).agg(*counts)


def hard_set_stages() -> dict[str, Column]:
    """The hard set: clean arguments, calls, several blocks, structs, many instructions."""
    return {
        "no_unused_args": no_unused_args(),
        "first_calls": first_function_calls(),
        "blocks": more_blocks_than(HARD_BLOCKS),
        "structs": uses_structs(),
        "instructions": many_instructions(MIN_INSTRUCTIONS),
    }


def prepared_set_stages() -> dict[str, Column]:
    """Rows whose code survived compilation in both forms."""
    return {"ir": last_code_present("llvm_ir"), "asm": last_code_present("asm")}


def motivation_sets() -> dict[str, Column]:
    """The evaluation sets below the token limit; executed targets where the set needs them."""
    short = short_enough()
    return {
        "loops": short & has_loops(),
        "without_loops": short & ~has_loops(),
        "one_block": short & one_block(),
        "calls": short & has_calls() & target_executes(),
        "without_calls": short & ~has_calls() & target_executes(),
    }


def min_block_counts(df: DataFrame, thresholds: tuple[int, ...] = BLOCK_THRESHOLDS) -> DataFrame:
    """Records having a function of at least n blocks, and their share in percent."""
    total = F.count(F.lit(1))
    counts = df.agg(
        total.alias("n_total"),
        *[F.count_if(some_function_at_least(n)).alias(f"n_{n}") for n in thresholds],
    )
    pairs = F.array(
        *[
            F.struct(F.lit(n).alias("threshold"), F.col(f"n_{n}").alias("n_records"))
            for n in thresholds
        ]
    )
    return counts.select(F.inline(pairs), F.col("n_total")).select(
        "threshold",
        "n_records",
        F.round(F.try_divide(F.col("n_records") * 100.0, F.col("n_total")), 2).alias("percent"),
    )


def row_flags(df: DataFrame) -> DataFrame:
    """Every structural predicate of a record as a column."""
    return df.select(
        "idx",
        many_instructions().alias("many_instructions"),
        has_loops().alias("loops"),
        has_calls().alias("calls"),
        no_unused_args().alias("no_unused_args"),
        uses_structs().alias("structs"),
        leaves_struct_fields_unread().alias("unread_fields"),
        more_blocks_than().alias("blocks"),
        one_block().alias("one_block"),
        some_function_at_most().alias("small_function"),
        short_enough().alias("short"),
        (last_code_present("asm") & code_array_present("llvm_ir")).alias("has_code"),
    )
