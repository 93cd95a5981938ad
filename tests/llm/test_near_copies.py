"""The pipeline's near-copy stage against brute-force Jaccard similarity of five-word shingles."""

import numpy as np

from docspark.llm import near_copies
from docspark.llm.components import components


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def test_planted_copies_of_all_similarities_are_dropped(spark):
    """Words changed so that similarities lie from 0.7 to 0.97; what stays is what brute force says."""
    import corpus_pipeline

    rng, texts, planted = np.random.default_rng(7), [], []
    for k in range(240):
        words = [f"w{x}" for x in rng.integers(0, 5000, 120 + 3 * (k % 60))]
        copy = list(words)
        for at in rng.choice(len(words), 1 + k % 6, replace=False):
            copy[at] = f"new{k}x{at}"
        planted.append((len(texts), len(texts) + 1))
        texts += [" ".join(words), " ".join(copy)]
    sets = [shingles(t) for t in texts]
    near = [(a, b) for a, b in planted if alike(sets[a], sets[b])]
    assert 60 < len(near) < 240
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    left = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert left == set(range(len(texts))) - {b for _, b in near}


def test_exactly_the_bound_counts_and_chains_join():
    base = [f"a{i}" for i in range(60)]
    texts = [" ".join(base + [f"b{i}" for i in range(13)]), " ".join(["start", *base])]  # 56 of 70 shingles
    sets = [near_copies.shingle_set(t) for t in texts]
    assert near_copies.exact_links([4, 9], sets) == [(4, 9)]
    assert near_copies.exact_links([4, 9], [sets[0], sets[1][:-1]]) == []
    a, b, c, d = (np.arange(s, s + 100, dtype=np.uint64) for s in (0, 10, 20, 500))
    assert sorted(near_copies.exact_links([1, 2, 3, 4], [a, c, b, d])) == [(1, 3), (2, 3)]


def test_repeated_and_null_identifiers_and_texts_without_words(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(20)) for x in "ab")
    rows = [(1, a), (5, a.upper()), (2, b), (5, b), (None, a), (7, None), (8, " \t"), (9, "short one")]
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (2, 1), (5, 1), (5, 1), (7, 7), (8, 7), (9, 9)]
    assert near_copies.near_copies(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_large_components_go_in_pairs_of_blocks(spark):
    """A chain of near copies, dealt over many blocks, is what it is in one; only pairs of blocks link its parts."""
    rng = np.random.default_rng(11)
    words = [f"w{x}" for x in rng.integers(0, 9999, 160)]
    rows = []
    for k in range(60):
        words[rng.integers(0, 160)] = f"new{k}"
        rows.append((k, " ".join(words)))
    rows += [(100 + k, " ".join(f"x{k}y{x}" for x in range(50))) for k in range(5)] + [(7, rows[30][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    whole = sorted(tuple(r) for r in near_copies.near_copies(docs).collect())
    assert whole == sorted([(k, 0) for k in range(60)] + [(7, 0)] + [(100 + k, 100 + k) for k in range(5)])
    assert sorted(tuple(r) for r in near_copies.near_copies(docs, block=700).collect()) == whole


def test_sides_are_compared_with_each_other_only():
    a = np.arange(0, 100, dtype=np.uint64)
    assert near_copies.exact_links([1, 2, 3], [a, a[:99], a[:98]], sides=[0, 0, 1]) in ([(1, 3), (2, 3)], [(2, 3), (1, 3)])
    assert near_copies.exact_links([1, 2], [a, a[:99]], sides=[3, 3]) == []


def test_fingerprints_alone_find_pairs_without_a_common_minimum(spark):
    """Pairs of similarity 0.8 of which the MinHash keys that stood before the tiles shared none: both copies stayed."""
    rows = []
    for k in (10098, 41649, 80075, 80763, 88815, 110755):
        words = [f"t{k}w{j}" for j in range(9)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:8]))]
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i - i % 2 for i, _ in rows}


def test_candidates_are_pairs_of_near_fingerprints_in_a_bucket(spark):
    """Components of candidates, in blocks of 7 nodes and in one, against all pairs of fingerprints."""
    rng, sets = np.random.default_rng(5), []
    for k in range(60):
        base = rng.integers(0, 1 << 63, 4 + 3 * k, dtype=np.uint64)
        sets += [base, np.concatenate([base[: len(base) - k % 9 // 2], rng.integers(0, 1 << 63, k % 9, dtype=np.uint64)])]
    common = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets += [np.concatenate([common, rng.integers(0, 1 << 63, 20, dtype=np.uint64)]) for _ in range(40)]
    bits = [near_copies.wide_bits(s) for s in sets]
    assert all(near_copies.majority(s) == int.from_bytes(np.packbits(b[:64], bitorder="little").tobytes(), "little") for s, b in zip(sets, bits))
    keys = [near_copies.bit_keys(b) for b in bits]
    of = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            n = min(len(keys[i]), len(keys[j]))
            near = (bits[i][:64] != bits[j][:64]).sum() <= 28 and (bits[i][64:256] != bits[j][64:256]).sum() <= 60
            if near and (keys[i][:n] == keys[j][:n]).any() and of[i] != of[j]:
                low, high = sorted((of[i], of[j]))
                of = [low if x == high else x for x in of]
    assert 40 < len(set(of)) < 110
    words = [np.packbits(b[:256], bitorder="little").view("<i8").tolist() for b in bits]
    nodes = spark.createDataFrame([(i, k.tolist(), *w) for i, (k, w) in enumerate(zip(keys, words))], "node bigint, keys array<int>, fp bigint, fp1 bigint, fp2 bigint, fp3 bigint")
    for block in (1 << 16, 7):
        found = dict(map(tuple, components(near_copies.candidate_links(nodes, block)).collect()))
        assert [found.get(i, i) for i in range(len(sets))] == of
