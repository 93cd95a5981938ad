"""Benchmark decontamination with a generalised suffix automaton over words.

The benchmark's normalised word sequences go into one suffix automaton. Each
document's words stream through it once; the state knows the longest suffix read
so far that occurs in some item. Wherever that length reaches the window, the
last ``window`` words are a passage of an item, and the state of exactly that
length names the items. Items shorter than the window, which count as a whole,
are found along the suffix links in the same pass.

The automaton is broadcast, so its size is bounded: a benchmark of more than
``shard_bytes`` of text is dealt by a hash of the item into that many automata
more, and the documents stream through one after the other, each pass written to
the shared folder and adding to the spans and items found before.

Defined results: a null text has no words; a null item identifier counts as the
empty string; items without words match nothing; items or documents that repeat
are counted once by identifier, or row by row; with an empty benchmark nothing is
hit; an empty table gives no rows; other columns are passed on.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.common import arrow_map, free_name, materialize

WINDOW = 10
SHARD_BYTES = 4_000_000
#: Of a document: a contaminated span of so many words goes, and with this share of hit words all of it.
SPAN_LIMIT, COVERAGE_LIMIT = 10, 0.8

HIT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("words", T.ArrayType(T.IntegerType())), T.StructField("bytes", T.ArrayType(T.IntegerType())),
])
_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("words", pa.list_(pa.int32())), ("bytes", pa.list_(pa.int32()))])
#: Bytes of words as they are after A-Z are lower-cased; all others separate words.
WORD_BYTES = bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
_BLANKED = bytes(c if c in WORD_BYTES else 0x20 for c in (bytes([b]).lower()[0] for b in range(256)))


def words_of(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode().translate(_BLANKED).split()


class Automaton:
    """A generalised suffix automaton of word sequences."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[str]] = [set()]  # items with a window that ends in the state
        whole: list[set[str]] = [set()]  # items shorter than a window that are the state's longest string
        self.shortest = window
        for name, words in items:
            if not words:
                continue
            last, states = 0, []
            for word in words:
                last = self._extend(last, self.vocabulary.setdefault(word, len(self.vocabulary)))
                states.append(last)
            ends += [set() for _ in range(len(self.next) - len(ends))]
            whole += [set() for _ in range(len(self.next) - len(whole))]
            for s in states:
                ends[s].add(name)
            if len(words) < window:
                self.shortest = min(self.shortest, len(words))
        for name, words in items:  # states are final now: clones may have split some
            if 0 < len(words) < window:
                s = 0
                for word in words:
                    s = self.next[s][self.vocabulary[word]]
                whole[s].add(name)
        order = sorted(range(1, len(self.next)), key=lambda s: -self.length[s])
        for s in order:
            if self.link[s] > 0:
                ends[self.link[s]] |= ends[s]
        # for each state: the items of the window that is a suffix of its strings, and of whole items likewise
        self.window_items: list[tuple[str, ...]] = [()] * len(self.next)
        self.whole_items: list[tuple[tuple[int, tuple[str, ...]], ...]] = [()] * len(self.next)
        for s in reversed(order):
            up = self.link[s]
            if self.length[s] >= window:
                self.window_items[s] = self.window_items[up] if self.length[up] >= window else tuple(sorted(ends[s]))
            own = ((self.length[s], tuple(sorted(whole[s]))),) if whole[s] else ()
            self.whole_items[s] = self.whole_items[up] + own

    def _extend(self, last: int, word: int) -> int:
        """Adds one word behind state ``last``; gives the state of the longer string."""
        seen = self.next[last].get(word)
        if seen is not None:
            return seen if self.length[seen] == self.length[last] + 1 else self._clone(last, word, seen)
        new = self._state({}, self.length[last] + 1)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
        else:
            seen = self.next[at][word]
            self.link[new] = seen if self.length[seen] == self.length[at] + 1 else self._clone(at, word, seen)
        return new

    def _clone(self, at: int, word: int, seen: int) -> int:
        copy = self._state(dict(self.next[seen]), self.length[at] + 1)
        self.link[copy], self.link[seen] = self.link[seen], copy
        while at >= 0 and self.next[at].get(word) == seen:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _state(self, moves: dict[int, int], length: int) -> int:
        self.next.append(moves)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Spans of hit words, [first, end) in order and apart, and the items with occurring windows."""
        moves, link, length, window = self.next, self.link, self.length, self.window
        window_items, whole_items = self.window_items, self.whole_items
        spans: list[list[int]] = []
        items: set[str] = set()
        state = matched = 0
        for i, word in enumerate(map(self.vocabulary.get, words)):
            if word is None:
                state = matched = 0
                continue
            while state and word not in moves[state]:
                state = link[state]
                matched = length[state]
            to = moves[state].get(word)
            if to is None:
                continue
            state, matched = to, matched + 1
            first = i + 1
            if matched >= window:
                items.update(window_items[state])
                first = i + 1 - window
            for n, names in whole_items[state]:
                if n <= matched:
                    items.update(names)
                    first = min(first, i + 1 - n)
            if first <= i:
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append([first, i + 1])
        return spans, items


def _merged(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted([*a, *b]):
        if out and out[-1][1] >= s:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return out


def _places(data: bytes, spans: list[list[int]]) -> list[int]:
    """First and end byte of the spans of words."""
    out, word, at = [], 0, 0
    blank = data.translate(_BLANKED)
    n = len(blank)
    wanted = iter([x for s, e in spans for x in (s, e - 1)])
    goal, first = next(wanted, None), True
    while goal is not None:
        while at < n and blank[at] == 0x20:
            at += 1
        end = blank.find(b" ", at)
        end = n if end < 0 else end
        while goal is not None and goal == word:
            out.append(at if first else end)
            first, goal = not first, next(wanted, None)
        word, at = word + 1, end
    return out


class Finder:
    """Marks texts by an automaton; ``old`` is what automata before this one found."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def mark(self, text: str | None, old: dict | None) -> dict:
        words = words_of(text)
        spans, items = self.automaton.scan(words) if len(words) >= self.automaton.shortest else ([], set())
        if old:
            flat = old["words"]
            spans, items = _merged(spans, [flat[i : i + 2] for i in range(0, len(flat), 2)]), items | set(old["items"])
        return {"n_words": len(words), "n_hit": sum(e - s for s, e in spans), "items": sorted(items), "words": [x for s in spans for x in s], "bytes": _places(text.encode(), spans) if spans else []}


def _without(text: str, mark: dict, span_limit: int) -> str:
    """``text`` without the hit spans of ``span_limit`` words or more."""
    data, end, kept = text.encode(), 0, []
    words, places = mark["words"], mark["bytes"]
    for i in range(0, len(places), 2):
        if words[i + 1] - words[i] >= span_limit:
            kept.append(data[end : places[i]])
            end = places[i + 1]
    return b"".join([*kept, data[end:]]).decode()


def _marked(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, out: str, window: int, shard_bytes: int, last) -> DataFrame:
    """Streams ``docs`` through each shard's automaton; ``last`` makes the last pass from (frame, automaton, whether marks exist)."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{item_text_col}`").alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 16).alias("n")).first()["n"] or 0
    shards = max(1, -(-size // shard_bytes))
    df, fields = docs, docs.columns
    for k in range(shards):
        part = items if shards == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(shards)) == k)
        loaded = [(r["item"], words_of(r["text"])) for r in part.toLocalIterator()]  # about shard_bytes
        automaton = spark.sparkContext.broadcast(Automaton(loaded, window))
        if k + 1 == shards:
            return last(df, automaton, k > 0)
        df = materialize(_pass(df, fields, docs.schema, text_col, out, automaton, k > 0), "decontamination-pass")


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", out: str = "contamination", window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with ``out``: n_words, n_hit, items (sorted), words and bytes (flat first/end pairs of hit spans)."""
    out = free_name(docs, out)
    last = lambda df, automaton, again: _pass(df, docs.columns, docs.schema, text_col, out, automaton, again)
    return _marked(docs, benchmark, text_col, item_col, item_text_col, out, window, shard_bytes, last)


def _marks(batch: pa.RecordBatch, at: int, n_fields: int, again: bool, finder: Finder) -> list[dict]:
    before = batch.column(n_fields).to_pylist() if again else [None] * batch.num_rows
    return [finder.mark(text.as_py(), old) for text, old in zip(batch.column(at), before)]


def _pass(df: DataFrame, fields: list[str], schema: T.StructType, text_col: str, out: str, automaton, again: bool) -> DataFrame:
    at = fields.index(text_col)

    def run(batches):
        finder = Finder(automaton.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], pa.array(_marks(batch, at, len(fields), again, finder), _ARROW)], [*fields, out])

    return arrow_map(df, run, T.StructType([*schema.fields, T.StructField(out, HIT)]))


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span_limit: int = SPAN_LIMIT, coverage_limit: float = COVERAGE_LIMIT, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` without the hit spans of ``span_limit`` words or more, nor documents of which more than ``coverage_limit`` is hit.

    Columns stay; a document from which nothing is removed stays as it is, byte for byte. The last automaton's pass cuts too.
    """
    fields = docs.columns
    at, out = fields.index(text_col), free_name(docs, "contamination")

    def last(df: DataFrame, automaton, again: bool) -> DataFrame:
        def run(batches):
            finder = Finder(automaton.value)
            for batch in batches:
                marks = _marks(batch, at, len(fields), again, finder)
                stay = [m["n_hit"] <= coverage_limit * m["n_words"] for m in marks]
                texts = [_without(t.as_py(), m, span_limit) if m["bytes"] else t.as_py() for t, m, s in zip(batch.column(at), marks, stay) if s]
                columns = list(batch.select(fields).filter(pa.array(stay, pa.bool_())).columns)
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, fields)

        return arrow_map(df, run, docs.schema)

    return _marked(docs, benchmark, text_col, item_col, item_text_col, out, window, shard_bytes, last)
