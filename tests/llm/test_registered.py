"""The registered queries as they are, on the smallest tables, against plain versions of their contracts."""

import hashlib
import re
import zlib

import pytest
import xxhash

from causeway.llm import registry, syncmers, token_count, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name):
    return registry.queries()[name](spark, SF).collect()


def test_op1_folds_scores_and_threshold(spark, texts):
    out = rows(spark, "op1_toxicity")
    assert {r["doc_id"] for r in out} == set(texts) and len(out) == len(texts)
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_op1_never_reads_the_held_out_fold(spark):
    """Labels of that fold turned round change no score."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    kept = [(r["doc_id"], r["toxic"]) for r in labels.collect()]
    turned = spark.createDataFrame([(d, 1 - t if zlib.crc32(str(d).encode()) % 4 == 2 else t) for d, t in kept], "doc_id long, toxic int")
    a, b = toxicity.train(docs, labels), toxicity.train(docs, turned)
    assert a.insults == b.insults and a.weights == pytest.approx(b.weights)


def simhash(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op3_fingerprints_and_components(spark, texts):
    fp = {d: simhash(t) for d, t in texts.items()}
    root = {d: d for d in fp}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(fp)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fp[a] ^ fp[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    out = rows(spark, "op3_simhash")
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in out} == {d: (f"{fp[d]:016x}", find(d)) for d in ids}


def test_op6_counts_are_the_library_s(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_count.vocabulary_path())
    for r in rows(spark, "op6_token_count"):
        text = texts[r["doc_id"]]
        n = len(t.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 512)


def brute_syncmers(text, k, s):
    """k-mers whose least s-mer, by the operator's hash of s-mers, is their first or last."""
    import numpy as np

    codes = np.array([ord(c) for c in text], dtype=np.uint64)
    h = []
    for i in range(len(text) - s + 1):
        x = int(codes[i])
        for j in range(1, s):
            x = (x * 0x100000001B3 + int(codes[i + j])) % 2**64
        h.append(int(syncmers._mix(np.array([x], dtype=np.uint64))[0]))
    return [i for i in range(len(text) - k + 1) if min(h[i : i + k - s + 1]) in (h[i], h[i + k - s])]


@pytest.mark.parametrize("k,s", [(12, 4), (5, 2), (2, 1), (9, 3)])
def test_syncmers_are_those_of_brute_force(texts, k, s):
    import numpy as np

    for t in list(texts.values())[:12]:
        t = t[:400]
        if len(t) < k:
            continue
        codes = np.frombuffer(t.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        assert syncmers._chosen(codes, k, s)[0].tolist() == brute_syncmers(t, k, s)


def test_op7_edits_follow_the_contract(spark, texts):
    out = {r["doc_id"]: r for r in rows(spark, "op7_fingerprints")}
    order = sorted(texts, reverse=True)
    assert set(out) == set(texts)
    for i, d in enumerate(order):
        t, nxt = texts[d], texts[order[(i + 1) % len(order)]]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        r = out[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == syncmers.fingerprint(syncmers.anchors(t)) and r["edited_fingerprint"] == syncmers.fingerprint(syncmers.anchors(edited))
        assert 0 <= r["near_next"] <= 1
        if len(t) >= 6:
            assert r["near_edited"] > 0
    # Two thirds of each text stay, half of the union where nothing repeats.
    near = [out[d]["near_edited"] for d in order if len(texts[d]) >= 6]
    assert sum(x > 0.35 for x in near) >= 0.95 * len(near)


def test_op7_lengths_on_either_side_of_a_scale_share_one():
    import random

    rng = random.Random(3)
    body = "".join(rng.choice("abcdefghij klm") for _ in range(400))
    for n in (3, 7, 8, 15, 23, 24, 60, 79, 80, 119, 160, 239, 240, 300):
        a = syncmers.anchors(body[:n])
        for m in (n, -(-n * 3 // 2) - 1):
            assert syncmers.likeness(a, syncmers.anchors(body[:m])) > 0.35, (n, m)
    assert syncmers.likeness(syncmers.anchors("x"), syncmers.anchors("x")) == 1 and syncmers.likeness(syncmers.anchors("x"), syncmers.anchors("y")) == 0
