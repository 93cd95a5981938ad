"""Columns whose names the operators use on their way, and context that other matches stand in."""

import pytest

from docspark.llm import exact_dedup, pii

NAMES = ["__email", "__email_m", "__pii", "__piiemail_m", "pii", "stay_id", "stay_raw", "__id", "__raw", "digest", "id", "norm"]
EXTRA = ", ".join(f"`{n}` string" for n in NAMES)


def test_any_column_passes(spark):
    docs = spark.createDataFrame([(i, t, *NAMES) for i, t in enumerate(["mail a@b.org", "mail a@b.org ", None])], f"doc_id bigint, text string, {EXTRA}")
    found = pii.find_pii(docs)
    assert found.columns == [*docs.columns, "pii_"] and {r["doc_id"]: len(r["pii_"]) for r in found.collect()} == {0: 1, 1: 1, 2: 0}
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns and {r["doc_id"]: r["stay_id"] for r in kept.collect()} == {1: "stay_id", 2: "stay_id"}


@pytest.mark.parametrize(("text", "want"), [
    ("my ssn 123-45-6789, 123-45-6780", 2), ("ssn 123-45-6789 and 123-45-6780", 2), ("123-45-6789, 123-45-6780 ssn", 2), ("ssn " + "123-45-6789 " * 3, 3), ("ssn " + "123-45-6789 " * 9, 4),
    ("ssn" + " " * 41 + "123-45-6789", 0), ("123-45-6789 and 123-45-6780", 0), ("ssn \U0001f600\U0001f600 123-45-6789", 1),
])
def test_context_is_the_text_around(spark, text, want):
    """A number is near a context word whether or not other numbers lie between: 40 code points before, 20 behind."""
    spans = pii.find_pii(spark.createDataFrame([(text,)], "text string")).first()["pii"]
    assert len([s for s in spans if s["kind"] == "ssn"]) == want and all(text[s["start"] : s["end"]] == s["value"] for s in spans)
