"""Instruction text normalisation and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stands between operands that are normalised at once.
SEPARATOR = "\x01"

# The immediate placeholder and what it replaces.
IMMEDIATE = "himm"
HEX_IMMEDIATE = r"0x[0-9a-fA-F]+"
DECIMAL_IMMEDIATE = r"#-?\d+"


def normalize_operands(operands: Column) -> Column:
    """Immediates become a placeholder, spaces underscores, except behind commas."""
    out = F.regexp_replace(operands, HEX_IMMEDIATE, IMMEDIATE)
    out = F.regexp_replace(out, DECIMAL_IMMEDIATE, IMMEDIATE)
    out = F.replace(out, F.lit(" "), F.lit("_"))
    return F.replace(out, F.lit(",_"), F.lit(","))


def normalized_at_once(operands: Column) -> Column:
    """``normalize_operands`` of the texts of an array, null as empty, joined and cut again: more parts where a text holds the separator."""
    return F.split(normalize_operands(F.array_join(operands, SEPARATOR, "")), SEPARATOR, -1)


def normalized_each(operands: Column, parts: Column) -> Column:
    """The ``normalized_at_once`` parts if there is one for each of the operands, otherwise each normalised alone."""
    return F.when(F.size(parts) == F.size(operands), parts).otherwise(F.transform(operands, normalize_operands))


def with_operands(opcodes: Column, operands: Column, between: str) -> Column:
    """Each opcode followed by its operands, if it has any; arrays of one length."""

    def text(opcode: Column, rest: Column) -> Column:
        return F.when(rest != "", F.concat_ws(between, opcode, rest)).otherwise(F.coalesce(opcode, F.lit("")))

    return F.zip_with(opcodes, operands, text)


def normalize_instruction(mnemonic: Column, operands: Column) -> Column:
    rest = F.nullif(normalize_operands(operands), F.lit(""))
    return F.concat_ws("_", F.lower(mnemonic), rest)


def disassembly(mnemonic: Column, operands: Column) -> Column:
    return F.concat_ws(" ", F.lower(mnemonic), F.nullif(operands, F.lit("")))


def arch_label(language_id: Column) -> Column:
    """Architecture name of a processor language id."""
    arm = language_id.contains("ARM") | language_id.contains("arm")
    arm32 = language_id.contains("32") | language_id.contains("v7")
    x86 = language_id.contains("x86") | language_id.contains("X86")
    return (
        F.when(arm & arm32, "arm-32")
        .when(arm, "arm-64")
        .when(x86 & language_id.contains("64"), "x86-64")
        .when(x86, "x86-32")
        .otherwise("unknown")
    )


def base64_text(raw: Column) -> Column:
    """Base64 form on one line."""
    return F.replace(F.base64(raw), F.lit("\r\n"), F.lit(""))


def byte_text(raw: Column) -> Column:
    """Length, base64 (on one line) and hex form of a block's bytes."""
    return F.struct(
        F.octet_length(raw).alias("bb_len"),
        base64_text(raw).alias("b64_bytes"),
        F.lower(F.hex(raw)).alias("hex_bytes"),
    )
