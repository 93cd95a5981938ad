"""Language identification with rare labels and with runs of letters without spaces."""

import numpy as np

from docspark.llm import language_id

SCHEMA = "doc_id bigint, text string, lang string"


def speech(seed):
    rng = np.random.default_rng(seed)
    stock = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 9))) for _ in range(300)]
    odds = 1 / np.arange(1, 301)
    return lambda n: " ".join(rng.choice(stock, n, p=odds / odds.sum()))


def test_a_label_of_few_rows_is_learned_and_wins_only_its_own(spark):
    """Small beside more than sample_rows others, and one without a letter."""
    big, other, small = speech(1), speech(2), speech(3)
    rows = [(big(30), "aa") for _ in range(3000)] + [(other(30), "bb") for _ in range(2000)] + [(small(30), "cc") for _ in range(6)] + [("12 34", "dd")]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    model = language_id.train(docs, sample_rows=600)
    scorer = model.scorer()
    assert model.langs == ["aa", "bb", "cc"]
    for speak, lang in ((big, "aa"), (other, "bb"), (small, "cc")):
        assert {scorer.guess(speak(40))[0] for _ in range(100)} == {lang}


def test_rows_are_shared_out_by_language():
    assert language_id.row_share([3000, 2000, 6], 600) == 297
    assert language_id.row_share([5, 7], 20) == 7 and language_id.row_share([], 5) == 0 and language_id.row_share([50, 50], 20) == 10


def test_all_letters_of_a_long_run_count(spark):
    """One run that begins in a language and goes on in another, in prediction and in training."""
    one, other = ((lambda n, s=s: s(n).replace(" ", "")) for s in (speech(4), speech(5)))
    rows = [(i, (one(20), other(20))[i % 2], ("aa", "bb")[i % 2]) for i in range(60)]
    scorer = language_id.train(spark.createDataFrame(rows, SCHEMA)).scorer()
    assert scorer.guess(one(12)[:64] + other(200))[0] == "bb" and scorer.guess(other(12)[:64] + one(200))[0] == "aa"
    late = [(0, "x" * 64 + "abcde" * 30, "aa"), (1, "x" * 64 + "vwpqr" * 30, "bb")]
    scorer = language_id.train(spark.createDataFrame(late, SCHEMA)).scorer()
    assert scorer.guess("abcde")[0] == "aa" and scorer.guess("vwpqr")[0] == "bb"


def test_every_word_of_the_sample_is_kept(spark):
    """140,000 words, each seen once, of two languages that share their letters: a word seen is its own language's, by its own count."""
    rng = np.random.default_rng(8)
    words = list(dict.fromkeys("".join(w) for w in rng.choice(list("abcdefghij"), (150_000, 9))))[:140_000]
    rows = [(i, " ".join(words[i * 700 : (i + 1) * 700]), ("aa", "bb")[i % 2]) for i in range(200)]
    model = language_id.train(spark.createDataFrame(rows, SCHEMA))
    scorer = model.scorer()
    assert len(model.words.hashes) == 140_000 and (model.words.find(words) >= 0).all() and (model.words.find(["zz", ""]) == -1).all()
    assert all(scorer.guess(words[k])[0] == ("aa", "bb")[k // 700 % 2] for k in range(0, 140_000, 97))
    # a text of more words than are looked up together, and than the memo holds
    for many in (language_id.PART + 5, 140_000):
        lot = words[:700] + [w + "k" for w in words[:many]]
        assert scorer.guess(" ".join(lot)) == model.scorer().guess(" ".join(lot))
