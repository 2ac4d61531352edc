"""Job parameters.  Defaults are fixed values: results depend on them."""

from __future__ import annotations

from dataclasses import dataclass, field

# The prompt strategies a job may name.
PROMPT_TYPES = (
    "basic",
    "in-context-learning",
    "ghidra-decompile",
    "ghidra-pcode-decompile",
    "ghidra-decompile-with-predict",
    "compile-fix",
    "llm-fix",
    "angr-debug-trace",
)


@dataclass(frozen=True)
class Timeouts:
    """Seconds allowed per external call."""

    compile: int = 30
    analysis: int = 90
    command: int = 120
    generation: int = 7200


@dataclass(frozen=True)
class JobConfig:
    """Parameters of one generate-evaluate-repair run."""

    num_generate: int = 8
    num_retry: int = 10
    prompt_type: str = "in-context-learning"
    fix_prompt_type: str = "compile-fix"
    remove_comments: bool = True
    use_pcode: bool = False
    embedding_batch: int = 64
    num_shards: int = 8
    sample_size: int = 164
    timeouts: Timeouts = field(default_factory=Timeouts)

    def __post_init__(self) -> None:
        for value in (self.prompt_type, self.fix_prompt_type):
            if value not in PROMPT_TYPES:
                raise ValueError(f"unknown prompt type: {value}")
