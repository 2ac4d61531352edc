"""Fixed schemas of the tables."""

from __future__ import annotations

from pyspark.sql import types as T

FUNCTION_ENTRY = (
    "STRUCT<name: STRING, called_functions: ARRAY<STRING>, num_loops: INT, "
    "has_defined_structs: BOOLEAN, has_globals: BOOLEAN, struct_args: BOOLEAN, "
    "unused_args: ARRAY<INT>, bbcount: ARRAY<INT>, all_struct_fields_accessed: BOOLEAN>"
)
FUNC_INFO = f"STRUCT<functions: ARRAY<{FUNCTION_ENTRY}>>"
BB_COUNT_FIELDS = "func_name STRING, bbcount INT, bb_list_size ARRAY<INT>"
BB_COUNT = f"STRUCT<{BB_COUNT_FIELDS}>"

FUNCTIONS = (
    "idx BIGINT, shard INT, split STRING, path STRING, func_def STRING, func_head STRING, "
    "func_head_types STRING, fname STRING, signature ARRAY<STRING>, "
    "asm STRUCT<code: ARRAY<STRING>, target: ARRAY<STRING>>, "
    f"llvm_ir STRUCT<code: ARRAY<STRING>, target: ARRAY<STRING>, bb_count: {BB_COUNT}>, "
    f"func_info {FUNC_INFO}, "
    "synth_io_pairs STRUCT<dummy_funcs: ARRAY<STRING>, dummy_funcs_seed: ARRAY<BIGINT>, "
    "input: ARRAY<MAP<STRING, STRING>>, output: ARRAY<MAP<STRING, STRING>>>, "
    "synth_deps STRING, real_deps STRING, real_io_pairs STRING, synth_exe_wrapper STRING, "
    "real_exe_wrapper STRING, ref STRING, synth_iospec STRING, real_iospec STRING, "
    "token_length INT"
)

PREDICTIONS = (
    "idx BIGINT, file STRING, func_head_types STRING, input STRING, instruction STRING, "
    "output ARRAY<STRING>, predict ARRAY<STRING>, predict_compile_success ARRAY<BOOLEAN>, "
    "predict_execution_success ARRAY<BOOLEAN>, target_compile_success BOOLEAN, "
    "target_execution_success BOOLEAN"
)

PROMPTS = "idx BIGINT, retry INT, prompt_type STRING, prompt STRING"
RESPONSES = "idx BIGINT, retry INT, choice INT, content STRING, reasoning STRING"
EVALUATIONS = (
    "idx BIGINT, retry INT, choice INT, compile_success BOOLEAN, execution_success BOOLEAN, "
    "error_msg STRING, llvm_ir STRING, assembly STRING"
)
TARGETS = "idx BIGINT, compile_success BOOLEAN, execution_success BOOLEAN, assembly STRING"
VECTORS = "shard INT, point_id BIGINT, record_id BIGINT, path STRING, embedding ARRAY<FLOAT>"
TOOL_RESULT = (
    "STRUCT<rc: INT, stdout: STRING, stderr: STRING, output: STRING, timed_out: BOOLEAN>"
)

CFG_BLOCK = (
    "STRUCT<bb_len: INT, bb_mnems: ARRAY<STRING>, bb_norm: ARRAY<STRING>, "
    "bb_disasm: ARRAY<STRING>, b64_bytes: STRING, bb_heads: ARRAY<BIGINT>>"
)
CFG_FUNCTION = (
    "STRUCT<elapsed_time: DOUBLE, nodes: ARRAY<BIGINT>, edges: ARRAY<ARRAY<BIGINT>>, "
    f"basic_blocks: MAP<STRING, {CFG_BLOCK}>>"
)


def struct(ddl: str) -> T.StructType:
    """A schema string as a StructType."""
    return T.StructType.fromDDL(ddl)
