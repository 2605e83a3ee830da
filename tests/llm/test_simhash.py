"""SimHash fingerprints and components against plain Python."""

import random

import numpy as np
import pytest
import xxhash

from test_operators import awkward, docs, empty, frame, words  # noqa: F401


def plain_fingerprint(text):
    found = (text or "").encode().lower().split()
    k = min(3, len(found))
    grams = [b" ".join(found[i : i + k]) for i in range(len(found) - k + 1)] if k else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """(id, fp) -> least id reachable, by all pairs."""
    comp = [k for k, _ in fps]
    low = lambda a, b: b if a is None else a if b is None else min(a, b)
    while True:
        new = [comp[i] for i in range(len(fps))]
        for i, (_, a) in enumerate(fps):
            for j, (_, b) in enumerate(fps):
                if (a ^ b).bit_count() <= 2:
                    new[i] = low(new[i], comp[j])
        if new == comp:
            return comp
        comp = new


def near_copies(seed):
    rng = random.Random(seed)
    base = [words(rng, 400).split(" ") for _ in range(4)]
    rows = []
    for i in range(60):
        t = list(base[i % 4])
        for _ in range(i % 5):
            t[rng.randrange(len(t))] = "edit" + str(rng.randrange(9))
        rows.append((1000 + i, " ".join(t)))
    return rows


@pytest.mark.parametrize("crowded", ["none", "broadcast", "cut anew"])
def test_simhash_against_all_pairs(spark, crowded, monkeypatch):
    from stockmerge.llm import simhash

    if crowded != "none":
        monkeypatch.setattr(simhash, "PART", 8)
        monkeypatch.setattr(simhash, "SENT", 10**6 if crowded == "broadcast" else 0)
    rows = awkward() + near_copies(5)  # nine fingerprints share a block
    fps = [(k, plain_fingerprint(t)) for k, t in rows]
    want = sorted((k is None, k or 0, f"{f:016x}", c) for (k, f), c in zip(fps, plain_components(fps), strict=True))
    got = simhash.cluster(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in got) == want
    assert len({w[3] for w in want}) < len({w[2] for w in want}), "near fingerprints are linked"


def test_simhash_of_an_empty_table(spark, empty):  # noqa: F811
    from stockmerge.llm.simhash import cluster

    assert cluster(empty).collect() == []


def test_simhash_without_words_is_zero(spark):
    from stockmerge.llm.simhash import cluster

    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in cluster(frame(spark, [(4, None), (2, ""), (9, " \t"), (None, "")])).collect()}
    assert got == {(4, "0" * 16, 2), (2, "0" * 16, 2), (9, "0" * 16, 2), (None, "0" * 16, 2)}
    assert [(r["doc_id"], r["component_id"]) for r in cluster(frame(spark, [(None, "only one")])).collect()] == [(None, None)]


@pytest.mark.parametrize("seed", range(4))
def test_trees_find_what_all_pairs_find(seed):
    from stockmerge.llm.simhash import Trees

    rng = np.random.default_rng(seed)
    fps = rng.integers(0, 2**63, 12, dtype=np.uint64)[rng.integers(0, 12, 900)]
    for _ in range(seed):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, len(fps), dtype=np.uint64))
    fps = rng.permutation(np.unique(fps))
    shards = np.sort(rng.integers(0, 3, len(fps)))
    near = (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2) & (shards[:, None] == shards[None, :]) & ~np.eye(len(fps), dtype=bool)
    a, b = Trees(fps, shards).within(2, np.arange(len(fps)))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted(zip(*(x.tolist() for x in np.nonzero(near)), strict=True))


def test_blocks_of_a_mask_split_its_free_bits():
    from stockmerge.llm.simhash import blocks

    masks = [0]
    for _ in range(5):
        mask = masks[0]
        finer = blocks(mask)
        fixed = [b & ~mask for b in finer]
        assert mask | fixed[0] | fixed[1] | fixed[2] == (1 << 64) - 1 and sum(b.bit_count() for b in fixed) == 64 - mask.bit_count()
        masks = finer
    assert 64 - masks[0].bit_count() <= 12, "five cuts bound every shard by PART"
