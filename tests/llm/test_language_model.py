"""The backoff automaton against brute force over the same n-grams, and odd inputs."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.llm import language_model
from causeway.llm.packed import pack, pack_sorted, unpack, unpack_sorted

DOCS = "doc_id long, text string, learned boolean"
BEGIN, END = "<", ">"


def docs(spark, texts, learned):
    return spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(zip(texts, learned, strict=True))], DOCS).coalesce(1)


def grams(texts):
    c: Counter = Counter()
    for t in texts:
        w = [BEGIN, *t.split(), END]
        for k in (1, 2, 3):
            c.update(tuple(w[i : i + k]) for i in range(k == 1, len(w) - k + 1))
    c[(BEGIN,)] = len(texts)
    return c


class Brute:
    """The model by its definition: recursion over counters, shares from each chunk's own counters."""

    def __init__(self, chunks):
        texts = [t for chunk in chunks for t in chunk]
        self.c = grams(texts)
        words = {g: n for g, n in self.c.items() if len(g) == 1 and g != (BEGIN,) and n}
        self.n, self.v = sum(words.values()), len(words)
        met: Counter = Counter()
        once: Counter = Counter()
        for chunk in chunks:
            c = grams(chunk)
            for g, n in c.items():
                if len(g) > 1 and c[g[:-1]] > 1:
                    key = len(g), int(np.log2(c[g[:-1]] - 1))
                    met[key] += n
                    once[key] += n == 1
        self.shares = {}
        for k in (2, 3):
            last = 0.9
            for e in range(30):
                last = (once[k, e] + 1) / (met[k, e] + 2) if met[k, e] else last
                self.shares[k, e] = last

    def p(self, g):
        if len(g) == 1:
            return (self.c[g] + 0.1) / (self.n + 0.1 * (self.v + 1))
        context = self.c[g[:-1]]
        if not context:
            return self.p(g[1:])
        s = self.shares[len(g), int(np.log2(context))]
        return (1 - s) * self.c[g] / context + s * self.p(g[1:])

    def score(self, text):
        w = [BEGIN, *text.split(), END]
        return sum(np.log10(self.p(tuple(w[max(0, i - 2) : i + 1]))) for i in range(1, len(w)))


@pytest.mark.parametrize("chunk_tokens,lane", [(10**6, 512), (150, 5)])
def test_scores_are_those_of_brute_force(spark, monkeypatch, chunk_tokens, lane):
    monkeypatch.setattr(language_model, "LANE", lane)
    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{i}" for i in rng.zipf(1.3, 40) if i < 400) for _ in range(40)]
    texts += [texts[0], "w1 w2 never seen", "", "never", texts[3] + " w1 unheard w2 w2 w2"]
    learned = [i % 4 != 3 for i in range(len(texts))]
    chunks, size = [[]], 0
    for t, k in zip(texts, learned, strict=True):
        if size >= chunk_tokens:
            chunks.append([])
            size = 0
        size += len(t.split()) + 1
        if k:
            chunks[-1].append(t)
    brute = Brute(chunks)
    rows = language_model.scored(docs(spark, texts, learned), chunk_tokens=chunk_tokens).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = [*texts[r["doc_id"]].split(), END]
        assert r["n_tokens"] == len(words) and r["train_tokens"] == brute.n
        assert r["n_known"] == sum(brute.c[(w,)] > 0 for w in words)
        assert r["base_score"] == pytest.approx(sum(np.log10(brute.p((w,))) for w in words))
        assert r["score"] == pytest.approx(brute.score(texts[r["doc_id"]]))


def test_each_context_adds_up_to_one(spark):
    """Over all words of the training texts, the end and one unknown word."""
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{i}" for i in rng.zipf(1.5, 20) if i < 30) for _ in range(30)]
    words = sorted({w for t in texts for w in t.split()})
    contexts = ["", "w1", "w1 w1", "w2 w1", "unknown w1", "w1 unknown"]
    asked = [" ".join([c, w]).strip() for c in contexts for w in [*words, "unheard"]]
    ended = contexts
    rows = language_model.scored(docs(spark, [*texts, *asked, *ended], [True] * len(texts) + [False] * (len(asked) + len(ended)))).collect()
    score = {r["doc_id"] - len(texts): r["score"] for r in rows}
    brute = Brute([texts])
    n = len(words) + 1
    for i, c in enumerate(contexts):
        prefix = [BEGIN, *c.split()]
        before = sum(np.log10(brute.p(tuple(prefix[max(0, j - 2) : j + 1]))) for j in range(1, len(prefix)))
        end = score[len(asked) + i] - before
        total = 10**end
        for j in range(n):
            text = asked[i * n + j].split()
            after = np.log10(brute.p((*[BEGIN, *text][-2:], END)))
            total += 10 ** (score[i * n + j] - before - after)
        assert total == pytest.approx(1, abs=1e-9)


def test_odd_inputs(spark):
    long = "alpha beta gamma delta " * 8000
    texts = [None, "", " \n\t", "One line of text here\nOne line", "one line", "one line", long, "İstanbul ß 漢字 😀", "x"]
    d = spark.createDataFrame([(i if i < 8 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    d = d.withColumns({"chunk": F.lit(1), "level": F.lit(2), "words": F.lit("w"), "ids": F.lit(3), "docs": F.lit(4), "bucket": F.lit(6)})
    rows = language_model.scored(d.withColumn("learned", F.lit(True))).collect()
    n = {r["doc_id"]: r["n_tokens"] for r in rows}
    assert len(rows) == 9 and n[0] == n[1] == n[2] == 1 and n[4] == n[5] == 3 and n[6] == 32001 and n[None] == 2
    assert all(r["score"] < 0 and r["base_score"] < 0 and r["n_known"] == r["n_tokens"] for r in rows)
    untaught = language_model.scored(d.withColumn("learned", F.lit(None).cast("boolean"))).collect()
    assert len(untaught) == 9
    assert all(r["base_score"] == 0 and r["score"] == 0 and r["n_known"] == 0 and r["train_tokens"] == 0 for r in untaught)
    assert language_model.scored(d.limit(0).withColumn("learned", F.lit(True))).count() == 0


def test_chunks_of_more_words_than_a_triple_key_holds():
    """Numbers of 22 bits and more go by the pairs' numbers; both ways name the same n-grams."""
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 50, 400).astype(np.uint64)
    narrow = language_model.Chunk(rng.integers(0, 2**63, 60, dtype=np.uint64), ids, np.array([100, 0, 299, 1])[[0, 2, 3]], np.array([True, False, True]))
    wide = language_model.Chunk(np.concatenate([narrow.words, np.zeros(2**22, dtype=np.uint64)]), ids, narrow.lengths, narrow.learned)
    a, b = language_model.Grams.of(narrow), language_model.Grams.of(wide)
    assert wide.bits * 3 > 63
    assert a.triples_n.tolist() == b.triples_n.tolist() and a.split(a.triples)[0].tolist() == b.split(b.triples)[0].tolist()
    for x, y in zip(a.hashes(narrow.words, 64)[1:], b.hashes(wide.words, 64)[1:], strict=True):
        assert x.tolist() == y.tolist()


def test_packed_integers_come_back():
    rng = np.random.default_rng(1)
    for x in ([], [0], [2**64 - 1, 0, 7], rng.integers(0, 2**40, 1000)):
        x = np.array(x, dtype=np.uint64)
        assert unpack(pack(x)).tolist() == x.tolist()
        x = np.sort(x)
        base = int(x[0]) if len(x) else 0
        assert unpack_sorted(pack_sorted(x, base), base).tolist() == x.tolist()


def test_held_out_text_is_likelier_than_by_words_alone(spark):
    out = language_model.op2_language_model(spark, "/root/testdata/sf0.001").collect()
    assert len(out) == 200 and {r["held_out"] for r in out} == {True, False}
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0) for r in out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
