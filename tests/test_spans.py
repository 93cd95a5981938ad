"""Tokens as spans: words, and pieces of a byte-pair vocabulary."""

import base64

import pytest

from docspark.functions import spans


@pytest.fixture(scope="module")
def vocabulary(tmp_path_factory):
    """All single bytes, and a few pairs."""
    path = tmp_path_factory.mktemp("ranks") / "own.tiktoken"
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b" a", b"abab"]
    path.write_text("\n".join(f"{base64.b64encode(t).decode()} {i}" for i, t in enumerate(tokens)))
    return str(path)


def test_pieces_to_characters(vocabulary):
    cut = spans.bpe_spans(vocabulary)
    assert cut("abab ab") == ([0, 4, 5], [4, 5, 7]) and cut("") == ([], [])
    starts, ends = cut("é漢 a")  # single bytes inside a character have no span
    assert starts == [0, 1, 2] and ends == [1, 2, 4]
    assert spans.char_of_byte([0, 2, 5], 1) == 0 and spans.char_of_byte([0, 2, 5], 2) == 1
    assert spans.spans_of_pieces("abc", [b"ab"]) is None


def test_modes(vocabulary, monkeypatch):
    assert spans.spanner("whitespace")(" a  bc") == (([1, 4], [2, 6]), "whitespace")
    assert spans.spanner("auto", vocabulary)("ab ab")[1] == spans.spanner("tiktoken", vocabulary)("ab ab")[1] == "tiktoken"
    assert spans.spanner("auto", "/nowhere")("ab ab") == (([0, 3], [2, 5]), "whitespace")
    with pytest.raises(RuntimeError):
        spans.spanner("tiktoken", "/nowhere")
    with pytest.raises(ValueError):
        spans.spanner("letters")


def test_chunks_by_byte_pairs(spark, vocabulary):
    from docspark.config import Chunking, Window
    from docspark.operators.chunking import chunk

    config = Chunking(Window("leaf", 4, 8, 12, 2), Window("parent", 10, 20, 30, 5), "tiktoken", vocabulary=vocabulary)
    text = "abab ab é漢 " * 12
    rows = chunk(spark.createDataFrame([("s", text, None)], "source_id string, text string, units array<struct<unit_type:string,unit_index:int,start_char:int,end_char:int>>"), config).collect()
    assert {r["tokenizer"] for r in rows} == {"tiktoken"} and {r["level"] for r in rows} == {"leaf", "parent"}
    assert all(r["text"] == text[r["start_char"] : r["end_char"]] == r["text"].strip() for r in rows)
