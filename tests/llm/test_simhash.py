import numpy as np

from docspark.llm import simhash
from docspark.llm.components import components


def test_a_repeated_identifier_joins_texts_of_which_it_is_not_the_smallest(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    docs = spark.createDataFrame([(1, a), (5, a), (2, b), (5, b), (3, c), (None, a)], "doc_id bigint, text string")
    got = simhash.near_duplicates(docs).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (5, 1), (2, 1), (3, 3), (None, 1)} and len(got) == 6


def test_large_buckets_go_in_pairs_of_blocks(spark):
    """Fingerprints close together, in blocks of 5 as in one block and as by brute force."""
    rng, base = np.random.default_rng(3), 0x0123_4567_89AB_CDEF
    fps = sorted({base ^ sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, 7)).tolist())) for _ in range(150)})
    of = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and of[i] != of[j]:
                low, high = sorted((of[i], of[j]))
                of = [low if x == high else x for x in of]
    signed = [x - (x >> 63 << 64) for x in fps]
    nodes = spark.createDataFrame(list(zip(signed, range(len(fps)))), "fp bigint, node bigint")
    for block in (simhash.BLOCK, 5):
        found = dict(map(tuple, components(simhash.near_links(nodes, block=block)).collect()))
        assert [found.get(i, i) for i in range(len(fps))] == of
