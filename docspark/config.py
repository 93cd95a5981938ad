"""Settings, their bounds and their hashes."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from docspark.functions.spans import TOKENIZERS


@dataclass(frozen=True)
class Window:
    level: str
    min_tokens: int
    target_tokens: int
    max_tokens: int
    overlap_tokens: int

    def __post_init__(self):
        checks = {
            "min_tokens must be positive": self.min_tokens > 0,
            "target_tokens must not be below min_tokens": self.target_tokens >= self.min_tokens,
            "max_tokens must not be below target_tokens": self.max_tokens >= self.target_tokens,
            "overlap_tokens must not be negative": self.overlap_tokens >= 0,
            "overlap_tokens must be below target_tokens": self.overlap_tokens < self.target_tokens,
        }
        _require(checks)


def _require(checks: dict[str, bool]) -> None:
    if bad := [what for what, ok in checks.items() if not ok]:
        raise ValueError("; ".join(bad))


# Window sizes.
LEAF = Window("leaf", 220, 360, 520, 70)
PARENT = Window("parent", 700, 1100, 1500, 180)


@dataclass(frozen=True)
class Chunking:
    leaf: Window = LEAF
    parent: Window = PARENT
    tokenizer: str = "whitespace"
    min_leaf_tokens: int = 0
    #: File of byte-pair ranks for the tokenizers tiktoken and auto.
    vocabulary: str = ""

    def __post_init__(self):
        _require({"unknown tokenizer": self.tokenizer in TOKENIZERS, "min_leaf_tokens must not be negative": self.min_leaf_tokens >= 0})


@dataclass(frozen=True)
class Indexing:
    model: str = "local-hash-64"
    batch_size: int = 64
    timeout: float = 60.0
    max_retries: int = 5
    base_delay: float = 1.0

    def __post_init__(self):
        _require({"model is empty": bool(self.model.strip()), "batch_size must be positive": self.batch_size > 0, "timeout must be positive": self.timeout > 0, "max_retries must not be negative": self.max_retries >= 0, "base_delay must not be negative": self.base_delay >= 0})


# What the two answer modes take unless told otherwise.
MODES = {"recherche": {"top_k": 6, "per_source": 2, "context_tokens": 5000, "parents": False}, "resume": {"top_k": 12, "per_source": 3, "context_tokens": 8000, "parents": True}}


@dataclass(frozen=True)
class Prompts:
    """What stands around a question and its context; counted against the context's budget."""

    system: str = "Answer from the passages alone and cite them by their labels, such as [C1]. If they don't answer the question, reply UNKNOWN."
    before: str = "Question: "
    after: str = "\nPassages:"
    closing: str = "Reply as JSON with answer and citation_ids."


@dataclass(frozen=True)
class Retrieval:
    """Zero top_k, per_source or context_tokens: the mode's value."""

    mode: str = "recherche"
    top_k: int = 0
    per_source: int | None = None
    context_tokens: int = 0
    neighbor_depth: int = 1
    use_prev: bool = True
    use_next: bool = True
    parents: bool | None = None
    max_parents: int = 3
    mmr: bool = False
    mmr_lambda: float = 0.7
    mmr_gate: float = 0.4
    score_mode: str = "reference"
    soft_cap: bool = True
    filters: dict = field(default_factory=dict)
    prompts: Prompts = Prompts()

    def __post_init__(self):
        _require({
            "unknown mode": self.mode in MODES, "top_k must not be negative": self.top_k >= 0, "context_tokens must not be negative": self.context_tokens >= 0,
            "per_source must not be negative": self.per_source is None or self.per_source >= 0, "neighbor_depth must not be negative": self.neighbor_depth >= 0,
            "max_parents must not be negative": self.max_parents >= 0, "mmr_lambda must lie in 0 to 1": 0 <= self.mmr_lambda <= 1, "unknown score_mode": self.score_mode in ("reference", "similarity"),
        })

    def resolved(self, name: str):
        own = {"top_k": self.top_k or None, "per_source": self.per_source, "context_tokens": self.context_tokens or None, "parents": self.parents}[name]
        return MODES[self.mode][name] if own is None else own

    @property
    def initial_k(self) -> int:
        k = self.resolved("top_k")
        return min(max(4 * k, k), 200)


def config_hash(config) -> str:
    """SHA-256 of the settings as sorted ASCII JSON."""
    return hashlib.sha256(json.dumps(asdict(config), sort_keys=True, ensure_ascii=True).encode()).hexdigest()
