"""Personal data: regular expressions propose, checksums confirm, context adjusts.

Everything here is a Column expression, so a scan of the documents evaluates it
inside the JVM without any shuffle. Offsets come from lengths alone: splitting a
text at a pattern gives the gaps between the matches that extracting all of the
pattern gives, and running sums of both are code-point offsets.

Defined results: a null text counts as empty; no match gives an empty array;
rows are independent, so ties, repeated rows and empty tables need no care; other
columns, whatever their names, are passed on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import free_name

#: Matches whose context is read: so many code points before and after.
CONTEXT_BEFORE, CONTEXT_AFTER = 40, 20
#: Proposals of the added kinds below this score go; the four base kinds stay whatever they score.
LEAST_SCORE = 0.5
#: Gains of a score by a context word nearby.
CONTEXT_GAIN = 0.3


@dataclass(frozen=True)
class Kind:
    """``pattern`` has possessive quantifiers and a look-behind so that a run of
    characters is tried once only: linear time on texts of any length, with the
    same leftmost non-overlapping matches as the plain pattern."""

    name: str
    pattern: str
    needs: str  # a cheap pattern that any text with a match also has
    base: bool
    score: float
    context: str


KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True, 0.7, r"(?i)e-?mail|contact|write"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", True, 0.6, r"(?i)\bip\b|address|host|server"),
    Kind("card", r"(?<![0-9])[0-9](?:[ -]?[0-9]){15,}+", r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]", True, 0.7, r"(?i)card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", True, 0.6, r"(?i)phone|tel|call|mobile|fax"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", False, 0.6, r"(?i)iban|account|bank"),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", False, 0.3, r"(?i)ssn|social security"),
)

_BLOCK = 512
_NEAR = 1 + max(CONTEXT_BEFORE, CONTEXT_AFTER) // 3


def _running(a: Column) -> Column:
    """Inclusive running sums of a short array."""
    zero = F.struct(F.array().cast("array<bigint>").alias("all"), F.lit(0).cast("bigint").alias("sum"))
    step = lambda s, x: F.struct(F.concat(s["all"], F.array(s["sum"] + x)).alias("all"), (s["sum"] + x).alias("sum"))
    return F.aggregate(a, zero, step, lambda s: s["all"])


def _with_running(df: DataFrame, source: str, out: str, temp: str) -> DataFrame:
    """Inclusive running sums by blocks, so that thousands of matches in a text don't cost their square."""
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(source) / _BLOCK).cast("int") - 1, F.lit(0))), lambda b: _running(F.slice(source, b * _BLOCK + 1, F.lit(_BLOCK))))
    df = df.withColumn(temp, blocks)
    bases = _running(F.transform(temp, lambda p: F.coalesce(F.try_element_at(p, F.lit(-1)), F.lit(0).cast("bigint"))))
    joined = F.zip_with(temp, bases, lambda p, base: F.transform(p, lambda x: x + base - F.element_at(p, -1)))
    return df.withColumn(out, F.flatten(joined)).drop(temp)


def _luhn(m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)


def _ip(m: Column) -> Column:
    part = "0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
    return m.rlike(rf"^{part}(?:\.{part}){{3}}$")


def _phone(m: Column) -> Column:
    return F.length(F.regexp_replace(m, "[^0-9]", "")).between(8, 15)


def _mod97(m: Column) -> Column:
    plain = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    step = lambda s, c: F.when(c.between("0", "9"), s * 10 + F.ascii(c) - 48).otherwise(s * 100 + F.ascii(c) - 55) % 97
    return F.length(plain).between(15, 34) & (F.aggregate(F.split(turned, ""), F.lit(0), lambda s, c: F.when(c == "", s).otherwise(step(s, c))) == 1)


def _with_context(matches: Column, gaps: Column, rows: Column) -> Column:
    """``rows`` with ahead and behind: the text around each match, other matches included, as far as context is read.

    A match has three code points or more, so _NEAR matches and the gaps between them reach far enough.
    """
    pairs = lambda a, b: F.array_join(F.zip_with(a, b, lambda x, y: F.concat(F.coalesce(x, F.lit("")), F.coalesce(y, F.lit("")))), "")

    def row(x: Column, i: Column) -> Column:
        first, n = F.greatest(i - _NEAR, F.lit(0)) + 1, F.least(i, F.lit(_NEAR))
        ahead = F.concat(pairs(F.slice(gaps, first, n), F.slice(matches, first, n)), x["before"])
        behind = F.concat(x["after"], pairs(F.slice(matches, i + 2, F.lit(_NEAR)), F.slice(gaps, i + 3, F.lit(_NEAR))))
        return F.struct(x["value"].alias("value"), x["start"].alias("start"), x["before"].alias("before"), x["after"].alias("after"), ahead.alias("ahead"), behind.alias("behind"))

    return F.transform(rows, row)


def _iban(x: Column) -> Column:
    """The proposal, or, as capital words may follow a number, its longest row of groups that passes."""
    groups = F.split(x["value"], " ")
    tried = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(groups, 1, k), " "))
    value = F.coalesce(F.try_element_at(F.filter(tried, _mod97), F.lit(1)), x["value"])
    rest = F.substring(x["value"], F.length(value) + 1, F.lit(1 << 30))
    return F.struct(value.alias("value"), x["start"].alias("start"), x["before"].alias("before"), F.concat(rest, x["after"]).alias("after"), x["ahead"].alias("ahead"), F.concat(rest, x["behind"]).alias("behind"))


CONFIRM = {"email": lambda m: F.lit(True), "ip": _ip, "card": _luhn, "phone": _phone, "iban": _mod97, "ssn": lambda m: ~m.rlike("^(?:000|666|9)|-00-|0000$")}


def _confirmed(kind: Kind):
    """Whether a proposal passes its validator; added kinds must also stand alone."""
    alone = lambda x: ~F.right(x["before"], F.lit(1)).rlike("[A-Za-z0-9]") & ~F.substring(x["after"], 1, 1).rlike("[A-Za-z0-9]")
    return (lambda x: CONFIRM[kind.name](x["value"])) if kind.base else (lambda x: alone(x) & CONFIRM[kind.name](x["value"]))


def _scored(kind: Kind):
    near = lambda x: F.right(x["ahead"], F.lit(CONTEXT_BEFORE)).rlike(kind.context) | F.substring(x["behind"], 1, CONTEXT_AFTER).rlike(kind.context)
    score = lambda x: F.lit(kind.score) + F.when(near(x), F.lit(CONTEXT_GAIN)).otherwise(F.lit(0.0))
    return lambda x: F.struct(F.lit(kind.name).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["value"])).alias("end"), x["value"].alias("value"), score(x).alias("score"))


def find_pii(docs: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with ``out``: array of (kind, start, end, value, score), by kind as listed in KINDS, then start.

    ``start`` and ``end`` (exclusive) count code points.
    """
    out = free_name(docs, out)
    keep = [F.col(f"`{c}`") for c in docs.columns]
    taken, prefix = {c.lower() for c in docs.columns}, "__pii"
    while any(c.startswith(prefix) for c in taken):
        prefix += "_"
    names = {k.name: f"{prefix}{k.name}" for k in KINDS}
    df = docs
    for kind in KINDS:
        m, g, n, tmp = (names[kind.name] + x for x in ("_m", "_g", "_n", "_t"))
        text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
        found = text.contains(kind.needs) if kind.needs == "@" else text.rlike(kind.needs)
        df = df.withColumn(m, F.when(found, F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
        df = df.withColumn(g, F.when(F.size(m) > 0, F.split(text, kind.pattern, -1)).otherwise(F.array().cast("array<string>")))
        steps = F.zip_with(F.slice(g, 1, F.size(m)), F.concat(F.array(F.lit("")), F.slice(m, 1, F.greatest(F.size(m) - 1, F.lit(0)))), lambda a, b: (F.length(a) + F.length(b)).cast("bigint"))
        df = df.withColumn(n, F.when(F.size(m) > 0, steps).otherwise(F.array().cast("array<bigint>")))
        df = _with_running(df, n, tmp + "s", tmp)
        rows = _with_context(F.col(m), F.col(g), F.arrays_zip(F.col(m).alias("value"), F.col(tmp + "s").alias("start"), F.slice(g, 1, F.size(m)).alias("before"), F.slice(g, 2, F.size(m)).alias("after")))
        rows = F.transform(rows, _iban) if kind.name == "iban" else rows
        spans = F.transform(F.filter(rows, _confirmed(kind)), _scored(kind))
        df = df.withColumn(names[kind.name], spans if kind.base else F.filter(spans, lambda s: s["score"] >= LEAST_SCORE))
        df = df.drop(m, g, n, tmp + "s")
    return df.select(*keep, F.concat(*[F.col(names[k.name]) for k in KINDS]).alias(out))


def span_list(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end, comma-joined, of all spans or those of ``kinds``."""
    if kinds:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
