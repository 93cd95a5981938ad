"""Tokens as (start, end) spans of a text, for the Arrow pass that chunks documents."""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Callable
from functools import lru_cache
from itertools import accumulate

import numpy as np

_WORD = re.compile(r"\S+")

#: Which code points are white space, to Python and to the regular expressions of Spark, which leave out four separators: all that are lie below the table's end.
BLANK = np.array([chr(c).isspace() for c in range(0x3001)] + [False])
WHITE_SPACE = BLANK & ~np.isin(np.arange(len(BLANK)), [0x1C, 0x1D, 0x1E, 0x1F])

#: How a text may be cut; auto is byte-pair tokens where a vocabulary is at hand, else words.
TOKENIZERS = ("auto", "whitespace", "tiktoken")

Spans = tuple[list[int], list[int]]


def word_places(text: str, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of other characters than white space begin and end."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.r_[False, ~blank[np.minimum(points, len(blank) - 1)], False]
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return turns[::2], turns[1::2]


def word_spans(text: str) -> Spans:
    found = [m.span() for m in _WORD.finditer(text)]
    return [s for s, _ in found], [e for _, e in found]


def char_of_byte(offsets: list[int], byte: int) -> int:
    """The character that holds a byte; ``offsets``: where each character begins, and the end."""
    return bisect_right(offsets, byte) - 1


def spans_of_pieces(text: str, pieces: list[bytes]) -> Spans | None:
    """Spans of consecutive byte strings that make up a text; pieces inside a character have none. None if they don't make it up."""
    ends = list(accumulate(map(len, pieces)))
    if (ends[-1] if ends else 0) != len(text.encode()):
        return None
    if text.isascii():
        chars = ends
    else:
        offsets = [0, *accumulate(len(c.encode()) for c in text)]
        chars = [char_of_byte(offsets, e) for e in ends]
    found = [(s, e) for s, e in zip([0, *chars], chars) if e > s]
    return [s for s, _ in found], [e for _, e in found]


@lru_cache(maxsize=2)
def _encoding(vocabulary: str, pattern: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: Fixed value: how byte-pair vocabularies of this kind cut a text into words first.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def bpe_spans(vocabulary: str, pattern: str = PATTERN) -> Callable[[str], Spans | None]:
    encoding = _encoding(vocabulary, pattern)
    return lambda text: spans_of_pieces(text, encoding.decode_tokens_bytes(encoding.encode(text, disallowed_special=())))


def spanner(tokenizer: str, vocabulary: str = "") -> Callable[[str], tuple[Spans, str]]:
    """A function from a text to its spans and the name of what cut it. ``vocabulary``: a file of ranks.

    ``auto`` falls back to words where there is no vocabulary or its pieces don't make up a text; ``tiktoken`` fails there.
    """
    if tokenizer not in TOKENIZERS:
        raise ValueError(f"unknown tokenizer: {tokenizer}")
    pieces = None
    if tokenizer != "whitespace":
        try:
            pieces = bpe_spans(vocabulary)
        except (ImportError, OSError) as e:
            if tokenizer == "tiktoken":
                raise RuntimeError("the tiktoken tokenizer needs its library and a vocabulary") from e

    def cut(text: str) -> tuple[Spans, str]:
        found = pieces(text) if pieces else None
        if found is not None:
            return found, "tiktoken"
        if tokenizer == "tiktoken":
            raise RuntimeError("the vocabulary's pieces do not make up the text")
        return word_spans(text), "whitespace"

    return cut
