"""The registered packing query against the library, and plans against best fit alone."""

import zlib

import numpy as np
import pytest

from causeway.llm import packing

SF = "/root/testdata/sf0.001"


def best_fit_decreasing(histogram, limit):
    """Piece by piece, each into the fullest open sequence that still has room."""
    room = []
    for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= n]
        if fits:
            r, i = min(fits)
            room[i] -= n
        else:
            room.append(limit - n)
    return len(room)


@pytest.mark.parametrize("seed", range(5))
def test_never_more_sequences_than_best_fit(seed):
    rng = np.random.default_rng(seed)
    n = np.minimum(4096, rng.lognormal(5.5 + seed / 3, 1.2, 700).astype(int) + 1)
    histogram = {int(k): int(c) for k, c in zip(*np.unique(n, return_counts=True), strict=True)}
    plan = packing.plan_packing(histogram)
    assert plan.sequences <= best_fit_decreasing(histogram, 4096)


def test_patterns_can_be_filled_to_the_last_token():
    edges = packing.grid_edges(4096)
    low = np.append(0, edges[:-1]) + 1
    found = packing.patterns(edges, 4096)
    assert len(set(found)) == len(found) > 100
    for shape in found:
        assert sum(low[c] for c in shape) <= 4096 <= sum(edges[c] for c in shape)


def test_fitted_patterns_are_used():
    """Where halves and thirds abound, fitted repeats place them without a free token."""
    histogram = {1500: 40, 2596: 40, 1000: 30, 1600: 30, 1496: 30, 7: 5}
    plan = packing.plan_packing(histogram)
    assert packing.fitted_patterns(histogram, 4096)
    total = sum(n * c for n, c in histogram.items())
    assert plan.sequences == -(-total // 4096)


def test_op9_is_the_library_cut_and_packed(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path())
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = packing.op9_best_fit_packing(spark, SF).collect()
    want = {}
    for d, text in docs.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want[d, piece] = (start, len(part), zlib.crc32(part.tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    filled = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 4096
    histogram = {}
    for _, n, _ in want.values():
        histogram[n] = histogram.get(n, 0) + 1
    assert len(filled) <= best_fit_decreasing(histogram, 4096)
