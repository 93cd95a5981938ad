import pytest

from docspark.config import Chunking, Indexing, Retrieval, config_hash


def test_settings_are_checked_and_hashed():
    assert all(Chunking(tokenizer=name).tokenizer == name for name in ("auto", "whitespace", "tiktoken"))
    for bad in (lambda: Chunking(tokenizer="letters"), lambda: Chunking(min_leaf_tokens=-1), lambda: Indexing(model=" "), lambda: Indexing(timeout=0), lambda: Indexing(max_retries=-1), lambda: Indexing(base_delay=-0.1), lambda: Retrieval(context_tokens=-1), lambda: Retrieval(score_mode="x")):
        with pytest.raises(ValueError):
            bad()
    assert config_hash(Chunking()) == config_hash(Chunking()) != config_hash(Chunking(min_leaf_tokens=1))


def test_modes_and_over_fetch():
    assert (Retrieval().initial_k, Retrieval(mode="resume").initial_k, Retrieval(top_k=80).initial_k) == (24, 48, 200)
    assert Retrieval(mode="resume").resolved("parents") and not Retrieval(mode="resume", parents=False).resolved("parents")
