"""Secret scanning: all rules in one deterministic automaton, one pass over the bytes.

The rules' regular expressions are compiled together by subset construction and
minimised (see automata.py); the arrays are broadcast, a fixed size that rules,
not data, decide. The automaton reads each byte of a text once and tells which
rules match somewhere; for those few texts the rule's own expression then gives
the leftmost non-overlapping spans.

Defined results: a null text counts as empty and has no spans; rows are
independent, so ties, repeated rows and empty tables need no care; other columns,
whatever their names, are passed on.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docspark.llm.automata import Scanner
from docspark.llm.common import add_by_text, free_name


@dataclass(frozen=True)
class Rule:
    """``spans``: proposes, leftmost and apart. ``least``: what the automaton looks for; any confirmed span holds it.

    ``least`` asks for no more repeats than tell a secret from prose: matches that may
    overlap under way multiply states, and the expression checks the full length.
    """

    name: str
    spans: str
    least: str
    length: int  # least length of the span, or of its group ``measured``
    measured: int = 0


#: The three base kinds, then public token formats.
RULES = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6}", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{6}", 20),
    Rule("hex", r"[0-9a-f]+", r"[0-9a-f]{24}", 24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", r"gh[pousr]_[A-Za-z0-9]{4}", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", r"xox[abprs]-[A-Za-z0-9-]{2}", 15),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0),
)
BASE = ("assign", "access", "hex")

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def spans_of(data: bytes, rules, found: int) -> list[tuple[str, int, int]]:
    """Confirmed spans of the rules whose bits are set, by start, then rule; code points."""
    out = []
    for i, (rule, pattern) in enumerate(rules):
        if found >> i & 1:
            out += [(m.start(), i, rule.name, m.end()) for m in pattern.finditer(data) if m.end(rule.measured) - m.start(rule.measured) >= rule.length]
    out.sort()
    spans, at, chars = [], 0, 0
    for start, _, name, end in out:
        chars, at = chars + _chars(data[at:start]), start
        spans.append((name, chars, chars + _chars(data[start:end])))
    return spans


def _chars(data: bytes) -> int:
    return len(data) if data.isascii() else len(data.decode("utf-8", "ignore"))


def scan_secrets(docs: DataFrame, text_col: str = "text", out: str = "secrets", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``out``: array of (kind, start, end), by start, then rule as listed; end exclusive, code points."""
    compiled = docs.sparkSession.sparkContext.broadcast(Scanner([r.least for r in rules]))

    def make():
        scanner = compiled.value
        patterns = [(r, re.compile(r.spans.encode())) for r in rules]

        def per_batch(texts: pa.Array) -> pa.Array:
            found = []
            for text in texts:
                data = b"" if not text.is_valid else text.as_buffer().to_pybytes()
                hits = scanner.scan(data)
                found.append([dict(zip(("kind", "start", "end"), s)) for s in spans_of(data, patterns, hits)] if hits else [])
            return pa.array(found, _ARROW)

        return per_batch

    return add_by_text(docs, text_col, make, SPANS, free_name(docs, out))
