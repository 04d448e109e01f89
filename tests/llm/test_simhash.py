"""The Gray-order index against brute force on random, clustered and tiny inputs."""

import numpy as np
import pytest

from causeway.llm import simhash


def brute(fp, group, bits=4):
    label = np.arange(len(fp))
    changed = True
    while changed:
        changed = False
        for i in range(len(fp)):
            near = (group == group[i]) & (np.bitwise_count(fp ^ fp[i]) <= bits)
            m = label[near].min()
            if (label[near] != m).any():
                label[near], changed = m, True
    return label


def partition(pairs, fp):
    parent = {x: x for x in fp}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in fp}


@pytest.mark.parametrize("seed", range(6))
def test_links_span_the_components_of_each_group(seed):
    rng = np.random.default_rng(seed)
    fps, groups = [], []
    for g in range(12):
        base = rng.integers(0, 2**63, dtype=np.uint64)
        n = int(rng.integers(1, 160))
        flips = int(rng.integers(1, 12))
        rows = [int(base) ^ sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, flips + 1)))) for _ in range(n)]
        rows += [int(rng.integers(0, 2**63)) for _ in range(5)]
        rows = list(dict.fromkeys(rows))
        fps += rows
        groups += [g] * len(rows)
    fp, group = np.array(fps, dtype=np.uint64), np.array(groups)
    u, v = simhash.linked(fp, group)
    assert len(u) < len(fp)
    for g in range(12):
        mine = fp[group == g]
        inside = set(mine.tolist())
        got = partition([(a, b) for a, b in zip(u.tolist(), v.tolist(), strict=True) if a in inside], mine.tolist())
        label = brute(mine, np.zeros(len(mine), dtype=int))
        expected = {}
        for x, k in zip(mine.tolist(), label.tolist(), strict=True):
            expected.setdefault(k, set()).add(x)
        found = {}
        for x, r in got.items():
            found.setdefault(r, set()).add(x)
        assert sorted(map(sorted, expected.values())) == sorted(map(sorted, found.values()))


def dense_group(rng, satellites):
    """Near copies that differ in four bits only, some with another fingerprint four more bits away; and strangers."""
    base = int(rng.integers(0, 2**62))
    cube = rng.choice(64, 4, replace=False)
    rest = np.setdiff1d(np.arange(64), cube)
    near = [base ^ sum(1 << int(cube[j]) for j in range(4) if c >> j & 1) for c in rng.permutation(16)[: rng.integers(8, 17)]]
    far = [near[i % len(near)] ^ sum(1 << int(b) for b in rng.choice(rest, 4, replace=False)) for i in range(satellites)]
    return near + far + [int(x) for x in rng.integers(0, 2**62, 10)]


def test_dense_runs_keep_all_their_links():
    for seed in range(300):
        rng = np.random.default_rng(seed)
        fp = np.unique(np.array(dense_group(rng, int(rng.integers(2, 9))), dtype=np.uint64))
        index = simhash.GrayIndex(fp, np.zeros(len(fp), dtype=int))
        assert (index.links() == brute(index.fp, np.zeros(len(fp), dtype=int))).all(), seed


def test_a_group_of_several_blocks_keeps_all_its_links():
    rng = np.random.default_rng(0)
    fp = np.unique(np.array([x for _ in range(90) for x in dense_group(rng, 24)], dtype=np.uint64))
    assert len(fp) > 6 * simhash.QUERIES
    index = simhash.GrayIndex(fp, np.zeros(len(fp), dtype=int))
    near = [np.flatnonzero(np.bitwise_count(index.fp ^ x) <= simhash.LINK_BITS) for x in index.fp]
    label, before = np.arange(len(fp)), None
    while before is None or (label != before).any():
        before = label.copy()
        for at in near:
            label[at] = label[at].min()
    assert (index.links() == label).all()


def test_gray_rank_inverts_the_gray_sequence():
    n = np.arange(4096, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_block_choices_cover_all_pairs_within_four_bits():
    rng = np.random.default_rng(5)
    for count in (100, 10**9, 10**11):
        masks = simhash.block_choices(count)
        for _ in range(300):
            d = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(not d & m for m in masks)


def test_fingerprint_of_nothing_is_zero_and_short_texts_have_one_shingle():
    import xxhash

    assert simhash.fingerprint(None) == simhash.fingerprint(" \n\t") == 0
    assert simhash.fingerprint("One  TWO\nthree") == xxhash.xxh64_intdigest(b"one two three", 42)
