"""Byte-level BPE encoding and decoding with a minimal acyclic transducer lexicon.

The corpus's frequent words (counted over all documents) and their ids are
compiled into an acyclic automaton whose equal suffixes are shared: the numbers on
a word's path add up to its place in the table of ids. The lexicon is laid out as
flat arrays and memory-mapped by each worker. Words that it lacks are merged
exactly, pair by pair, in order of rank, as are the lexicon's own when it is
compiled. So the lexicon decides speed, not results. Before both stands a memo: a
worker asks the transducer at a word's first use, and keeps the answer.

Texts are cut into words by the tokenizer's own pattern: directly where a text has
only letters whose class all libraries agree on (ASCII, Latin-1, Latin Extended-A),
else by the library's pre-tokenizer.

Defined results: a null text counts as empty and has no ids; the special token's
string inside a text is that token; repeated rows are encoded alike; an empty
table gives no rows (and an empty lexicon); other columns are passed on.
"""

from __future__ import annotations

import json
import mmap
import re
import struct
import tempfile
from collections import Counter
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.common import add_by_text, arrow_map, free_name, most_frequent
from docspark.llm.token_counts import DIGITS, LETTERS, PLAIN, SPACES, byte_letters

LEXICON_WORDS = 60_000
#: Words whose ids a worker keeps besides.
MEMO = 240_000
#: Bytes of a word that is merged together with others.
SHORT = 64
#: Characters of texts that are encoded together.
TOGETHER = 1_000_000
_ODD = re.compile(f"[^{PLAIN}]")
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^{SPACES}{LETTERS}{DIGITS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")


class Merges:
    """A tokenizer file's words and merges, as workers need them."""

    def __init__(self, data: str):
        from tokenizers import pre_tokenizers

        spec = json.loads(data)
        model, cutter = spec["model"], spec["pre_tokenizer"]
        plain = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")
        if model["type"] != "BPE" or any(model.get(k) for k in plain) or spec["normalizer"] or cutter["type"] != "ByteLevel" or cutter["add_prefix_space"]:
            raise ValueError("not a plain byte-level BPE tokenizer")
        self.pre = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=cutter["use_regex"])
        letters, vocab = byte_letters(), model["vocab"]
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.first = [vocab[c] for c in letters]
        self.size = max(vocab.values()) + 1
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.none, self.ranks = len(pairs), {}
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.rank_of = np.argsort(keys, kind="stable")
        self.keys, self.first_of = keys[self.rank_of], np.array(self.first, np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def words(self, text: str) -> list[str]:
        if not _ODD.search(text):
            return _WORDS.findall(text)
        of = self.byte_of
        return [bytes(of[c] for c in w).decode("utf-8", "surrogateescape") for w, _ in self.pre.pre_tokenize_str(text)]

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of words, four bytes each: in each word the pair of least rank is merged first, the leftmost of equals, until none is left.

        Words of SHORT bytes at most go all at once, a merge of each in a step.
        """
        out: list = [b""] * len(words)
        short = [i for i, w in enumerate(words) if 0 < len(w) <= SHORT]
        for i, w in enumerate(words):
            if len(w) > SHORT:
                out[i] = np.array(self._merge_long([self.first[b] for b in w]), "<u4").tobytes()
        if not short:
            return out
        symbols = self.first_of[np.frombuffer(b"".join([words[i] for i in short]), np.uint8)]
        of = np.repeat(np.arange(len(short)), [len(words[i]) for i in short])
        left, right = symbols[:-1], symbols[1:]
        ranks = np.append(np.where(of[:-1] == of[1:], self._ranks(left, right), self.none), self.none)
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            sizes = np.diff(np.append(starts, len(of)))
            least = np.minimum.reduceat(ranks, starts)
            done = least == self.none
            if done.any():
                data = symbols.astype("<u4").tobytes()
                for k, s, n in zip(of[starts[done]].tolist(), starts[done].tolist(), sizes[done].tolist()):
                    out[short[k]] = data[4 * s : 4 * (s + n)]
                keep = ~np.repeat(done, sizes)
                symbols, of, ranks = symbols[keep], of[keep], ranks[keep]
                least, sizes = least[~done], sizes[~done]
                if not len(symbols):
                    break
            at = np.flatnonzero(ranks == np.repeat(least, sizes))
            at = at[np.concatenate([[True], of[at[1:]] != of[at[:-1]]])]  # the leftmost of each word
            symbols[at] = self.made[least]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # as places once the merged ones are gone
            symbols, of, ranks = symbols[keep], of[keep], ranks[keep]
            for i in (at, at[at > 0] - 1):  # the pairs that begin and that end with what was made
                j = np.minimum(i + 1, len(of) - 1)
                ranks[i] = np.where((of[i] == of[j]) & (i < j), self._ranks(symbols[i], symbols[j]), self.none)
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank_of[at], self.none)

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same for one word, by a heap of (rank, place) over linked places: n log n."""
        if not self.ranks:
            self.ranks = dict(zip(self.keys.tolist(), self.rank_of.tolist()))
        size, find = self.size, self.ranks.get
        after, before = list(range(1, len(ids))) + [-1], list(range(-1, len(ids) - 1))
        heap = [(r, i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := find(a * size + b)) is not None]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or find(ids[i] * size + ids[j]) != rank:
                continue  # merged away or changed since
            ids[i], ids[j], after[i] = int(self.made[rank]), -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (r := find(ids[left] * size + ids[right])) is not None:
                    heappush(heap, (r, left))
        return [x for x in ids if x >= 0]


def byte_table(data: str) -> dict[int, bytes]:
    """The bytes of each id; special tokens are their strings."""
    spec = json.loads(data)
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    table = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t, i in spec["model"]["vocab"].items()}
    return table | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}


class Lexicon:
    """Word to ids by a minimal acyclic transducer over bytes, in one buffer.

    Layout, little-endian: a head of 4 counts (states, arcs, words, ids), then for
    each state its first arc, for each arc the state it leads to and the number of
    words it skips, for each word its first id, the ids, whether a state ends a word,
    and the arcs' bytes.
    """

    def __init__(self, buffer):
        states, arcs, words, ids = struct.unpack_from("<4I", buffer, 0)
        view, at, parts = memoryview(buffer), 16, []
        for n in (states + 1, arcs, arcs, words + 1, ids):
            parts.append(view[at : at + 4 * n].cast("I"))
            at += 4 * n
        self.first, self.to, self.skip, self.begin, _ = parts
        self.ids = view[at - 4 * ids : at]
        self.final = view[at : at + states]
        self.labels, self.root = bytes(view[at + states : at + states + arcs]), states - 1

    def get(self, word: bytes) -> bytes | None:
        """The word's ids, four bytes each; None if the lexicon lacks it."""
        state, number = self.root, 0
        first, find, skip, to = self.first, self.labels.find, self.skip, self.to
        for byte in word:
            arc = find(byte, first[state], first[state + 1])
            if arc < 0:
                return None
            number += skip[arc]
            state = to[arc]
        if not self.final[state]:
            return None
        return bytes(self.ids[4 * self.begin[number] : 4 * self.begin[number + 1]])

    @classmethod
    def mapped(cls, data: bytes) -> Lexicon:
        """From a file without a name in the worker's own temporary folder, mapped read-only."""
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """Adds words in order; a state that no later word can change is replaced by an equal one that exists."""
    registry: dict[tuple, int] = {}
    done: list[tuple[bool, tuple[tuple[int, int], ...]]] = []  # final, arcs (byte, state)
    path: list[tuple[bool, list[tuple[int, int]]]] = [(False, [])]

    def close(depth: int, last: bytes) -> None:
        while len(path) > depth + 1:
            final, arcs = path.pop()
            key = (final, tuple(arcs))
            number = registry.get(key)
            if number is None:
                number = registry[key] = len(done)
                done.append(key)
            path[-1][1].append((last[len(path) - 1], number))

    last = b""
    order = sorted(words)
    for word in order:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        close(common, last)
        path.extend((False, []) for _ in range(len(word) - common))
        path[len(word)] = (True, path[len(word)][1])
        last = word
    close(0, last)
    done.append((path[0][0], tuple(path[0][1])))  # the root, last
    # words below each state, in order of numbers as arcs lead to lower ones
    size: list[int] = []
    first, to, skip, labels = [], [], [], bytearray()
    for final, arcs in done:
        first.append(len(to))
        n = int(final)
        for byte, state in arcs:
            labels.append(byte)
            to.append(state)
            skip.append(n)
            n += size[state]
        size.append(n)
    first.append(len(to))
    begin = np.concatenate([[0], np.cumsum([len(words[w]) for w in order])])
    ids = [x for w in order for x in words[w]]
    parts = [np.array(x, "<u4").tobytes() for x in (first, to, skip, begin, ids)]
    return b"".join([struct.pack("<4I", len(done), len(to), len(order), len(ids)), *parts, bytes(f for f, _ in done), bytes(labels)])


@lru_cache(maxsize=2)
def _merges(data: str) -> Merges:
    return Merges(data)


class Encoder:
    """Keeps the ids of words, four bytes each, of MEMO words at most; those not kept are looked up in the lexicon or merged."""

    def __init__(self, tokenizer: str, lexicon: bytes):
        self.merges, self.lexicon, self.memo = _merges(tokenizer), Lexicon.mapped(lexicon), {}

    def _learn(self, words: list[str]) -> None:
        memo, found = self.memo, self.lexicon.get
        missing = set(words) - memo.keys()
        if len(memo) + len(missing) > MEMO:
            memo.clear()
            missing = set(words)
        unseen = []
        for word in missing:
            data = word.encode("utf-8", "surrogateescape")
            ids = found(data)
            if ids is None:
                unseen.append((word, data))
            else:
                memo[word] = ids
        memo.update(zip((w for w, _ in unseen), self.merges.merge([d for _, d in unseen])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, four bytes each; of about TOGETHER characters at once."""
        out, some, size = [], [], 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size > TOGETHER:
                out += self._encode(some)
                some, size = [], 0
        return out + self._encode(some)

    def _encode(self, texts: list[str]) -> list[bytes]:
        merges, rows = self.merges, []
        for text in texts:
            special = merges.cut and any(s in text for s in merges.special)
            rows.append([x for piece in merges.cut.split(text) for x in (((piece,),) if piece in merges.special else (merges.words(piece),))] if special else [merges.words(text)])
        self._learn([w for row in rows for part in row if isinstance(part, list) for w in part])
        of = self.memo.__getitem__
        return [b"".join(b"".join(map(of, part)) if isinstance(part, list) else struct.pack("<I", merges.special[part[0]]) for part in row) for row in rows]


class Decoder:
    """Ids to text; bytes that are no UTF-8 become the replacement character."""

    def __init__(self, table: dict[int, bytes]):
        self.of = table.__getitem__

    def decode(self, ids) -> str:
        return b"".join(map(self.of, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def frequent_words(docs: DataFrame, tokenizer: str, text_col: str = "text", most: int = LEXICON_WORDS) -> list[bytes]:
    """The corpus's most frequent words of 2 to 64 bytes: at most ``most``, counted over all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches):
        merges = _merges(sent.value)
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column(0):
                counts.update(merges.words(text.as_py() or ""))
            words = [(w.encode("utf-8", "surrogateescape"), n) for w, n in counts.items()]
            words = [x for x in words if 2 <= len(x[0]) <= 64]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in words], pa.binary()), pa.array([n for _, n in words], pa.int64())], ["word", "n"])

    counted = arrow_map(docs.select(F.col(f"`{text_col}`").cast("string")), run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    return [bytes(r["word"]) for r in most_frequent(counted, "n", most, "word").select("word").toLocalIterator()]


def _lexicon(docs: DataFrame, tokenizer: str, text_col: str, most: int) -> bytes:
    merges = _merges(tokenizer)
    words = frequent_words(docs, tokenizer, text_col, most)
    return compile_lexicon({w: np.frombuffer(ids, "<u4").tolist() for w, ids in zip(words, merges.merge(words))})


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", out: str = "ids", lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """``docs`` with ``out``: the text's ids as binary, little-endian unsigned 32-bit integers."""
    tokenizer = _read(tokenizer_path)
    sent = docs.sparkSession.sparkContext.broadcast((tokenizer, _lexicon(docs, tokenizer, text_col, lexicon_words)))  # the file, and at most lexicon_words short words

    def make():
        encoder = Encoder(*sent.value)
        return lambda texts: pa.array(encoder.encode([t.as_py() or "" for t in texts]), pa.binary())

    return add_by_text(docs, text_col, make, T.BinaryType(), free_name(docs, out))


def decode(docs: DataFrame, tokenizer_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with ``out``: the text of the ids; bytes that are no UTF-8 become the replacement character."""
    sent = docs.sparkSession.sparkContext.broadcast(byte_table(_read(tokenizer_path)))  # of the vocabulary's fixed size
    at, out = docs.columns.index(ids_col), free_name(docs, out)

    def run(batches):
        decoder = Decoder(sent.value)
        for batch in batches:
            texts = [decoder.decode(x.as_buffer()) if x.is_valid else None for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out])

    return arrow_map(docs, run, T.StructType([*docs.schema.fields, T.StructField(out, T.StringType())]))


ROUND_TRIP = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])


def round_trip(docs: DataFrame, tokenizer_path: str, text_col: str = "text", out: str = "bpe", lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """``docs`` with ``out``: (ids, decoded: the text of these ids), both in one worker for each task."""
    tokenizer = _read(tokenizer_path)
    sent = docs.sparkSession.sparkContext.broadcast((tokenizer, _lexicon(docs, tokenizer, text_col, lexicon_words), byte_table(tokenizer)))

    def make():
        tokenizer, lexicon, table = sent.value
        encoder, decoder = Encoder(tokenizer, lexicon), Decoder(table)

        def per_batch(texts: pa.Array) -> pa.Array:
            ids = encoder.encode([t.as_py() or "" for t in texts])
            return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(map(decoder.decode, ids), pa.string())], names=["ids", "decoded"])

        return per_batch

    return add_by_text(docs, text_col, make, ROUND_TRIP, free_name(docs, out))
