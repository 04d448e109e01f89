"""Nulls, empty tables, repeated rows, very long texts and clashing column names, for each operator; and exact cases."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.llm import arc_to_warc, chat_format, decontaminate, line_dedup, packing, simhash, syncmers, token_count, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta " * 8000


def docs(spark, texts, ids=None):
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, None, None, None) for i, t in zip(ids, texts, strict=True)], DOCS)


ODD = [None, "", " \n\t", "One line of text here\nOne line of text here", "One line of text here", "One line of text here", LONG, "İstanbul ß 漢字 😀"]


@pytest.fixture
def odd(spark):
    """Null, empty and blank texts, repeats, a repeated row, a null id, and extra columns named like inner ones."""
    d = docs(spark, [*ODD, "One line of text here", "x"], [0, 1, 2, 3, 4, 5, 6, 7, 4, None])
    return d.withColumns({"h": F.lit(1), "pos": F.lit(2), "words": F.lit("w"), "n": F.lit(3), "k": F.lit(4), "fp": F.lit(5), "bucket": F.lit(6), "_id": F.lit(7), "_text": F.lit("u")})


def test_line_dedup_cases(spark, odd):
    out = line_dedup.drop_repeated_lines(odd)
    assert out.columns == odd.columns and out.count() == 10
    got = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert (3, "One line of text here\nOne line of text here") in got
    assert (4, "") in got and (5, "") in got and (1, "") in got and (0, "") in got
    assert line_dedup.drop_repeated_lines(odd.limit(0)).count() == 0


def test_line_dedup_against_brute_force(spark):
    rng = np.random.default_rng(3)
    lines = ["short", "a line of ten+", "  A LINE of ten+ ", "another longer line", "Ä umlaut line here", "ä umlaut line here", ""]
    texts = ["\n".join(rng.choice(lines, rng.integers(0, 90))) for _ in range(40)]
    key = lambda s: "".join(c.lower() if c.isascii() else c for c in s.strip(" \t\n\x0b\x0c\r"))
    first: dict[str, int] = {}
    held: dict[str, set] = {}
    for i, t in enumerate(texts):
        for x in t.split("\n"):
            first.setdefault(key(x), i)
            held.setdefault(key(x), set()).add(i)
    want = {i: "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or len(held[key(x)]) < 2 or first[key(x)] == i) for i, t in enumerate(texts)}
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(docs(spark, texts)).collect()}
    assert got == want


def test_simhash_cases(spark, odd):
    rows = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.near_duplicates(odd).collect()}
    assert rows[0, 0] == rows[1, 0] == rows[2, 0] == 0
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(4) == 1 and 5 not in ids and 0 in ids and 1 not in ids
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_simhash_chunked_groups(spark, monkeypatch):
    base = 0x123456789ABCDEF0
    rng = np.random.default_rng(1)
    fps = sorted({base ^ sum(1 << int(b) for b in rng.choice(20, 3, replace=False)) for _ in range(300)} | {int(x) for x in rng.integers(0, 2**62, 50)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    monkeypatch.setattr(simhash, "CHUNK", 40)
    from causeway.llm.components import components

    got = {r["node"]: r["root"] for r in components(simhash.fingerprint_links(df)).collect()}
    a = np.array(fps, dtype=np.uint64)
    label = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for f in fps:
            near = [g for g, d in zip(fps, np.bitwise_count(a ^ np.uint64(f)), strict=True) if d <= 4]
            m = min(label[g] for g in near)
            for g in near:
                if label[g] != m:
                    label[g], changed = m, True
    assert all(got.get(f, f) == label[f] for f in fps)


def test_decontamination_cases(spark, odd):
    item = "the quick brown fox jumps over the lazy dog near a river bank today"
    items = spark.createDataFrame([(0, item), (1, None), (2, ""), (3, "gamma delta"), (4, item)], "item_id long, text string")
    near = item.replace("today", "tomorrow")
    far = "the quick brown fox jumps but nothing else of it is here at all"
    more = docs(spark, ["x " + item.upper() + " y", near, far], [100, 101, 102]).select("doc_id", "text")
    d = odd.select("doc_id", "text").unionByName(more)
    got = sorted((r["_cw_id"], r["item_id"]) for r in decontaminate.contained_items(d, items).collect())
    assert got == [(6, 3), (100, 0), (100, 4), (101, 0), (101, 4)]
    left = {r["doc_id"] for r in decontaminate.without_contaminated(d, items).collect()}
    assert left == {None, 0, 1, 2, 3, 4, 5, 7, 102}
    assert decontaminate.contained_items(d.limit(0), items).count() == 0
    assert decontaminate.contained_items(d, items.limit(0)).count() == 0


def test_decontamination_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontaminate._within, "__defaults__", (0,))
    item = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([(0, item)], "item_id long, text string")
    got = decontaminate.contained_items(docs(spark, [item, "no"]), items).collect()
    assert [(r["_cw_id"], r["n_found"]) for r in got] == [(0, 6)]


def test_token_counts(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_count.vocabulary_path())
    bpe = token_count.HeapBpe(token_count.vocabulary_path())
    rng = np.random.default_rng(0)
    letters = list("ab C'st'll\n\t  \r\x85\xa0 é漢字12٣!?.-_\x1c\x00ǅ²😀") + ["<|endoftext|>"]
    for text in ["", "a" * 3000, "ab" * 2000 + " " * 500 + "x", *("".join(rng.choice(letters, rng.integers(0, 15))) for _ in range(1500))]:
        assert bpe.count(text) == len(t.encode(text, add_special_tokens=False).ids), repr(text)
    assert bpe.count(None) == 0


def test_count_tokens_keeps_columns(spark, odd):
    out = token_count.count_tokens(odd)
    assert out.columns == [*odd.columns, "n_tokens"]
    got = {r["doc_id"]: r["n_tokens"] for r in out.collect()}
    assert got[0] == got[1] == 0 and got[6] > 30_000


def test_packing_cases(spark, odd):
    rows = packing.pack(packing.tokenized_pieces(odd)).collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= packing.SEQUENCE_LENGTH
    long = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == 6)
    assert len(long) > 1 and all(x[2] == 4096 for x in long[:-1]) and [x[1] for x in long] == [4096 * i for i in range(len(long))]
    assert sum(r["doc_id"] == 4 for r in rows) == 2
    assert packing.pack(packing.tokenized_pieces(odd.limit(0))).count() == 0


def test_word_ids_match_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path())
    rng = np.random.default_rng(0)
    letters = list("ab C'st'll\n\t  \r\x85\xa0 é漢字12٣!?.-_\x1c\x00ǅⅫ²ÅİΣß😀é") + ["<|endoftext|>"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 15))) for _ in range(1500)]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert [x.tolist() for x in packing.WordIds(packing.vocabulary_path()).of(texts)] == want


def test_word_ids_of_every_letter_and_mark_match_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path())
    chars = [chr(c) for c in range(0x600)] + list("\u1e9e\u2126\u212a\u212b\ufb01\uff21")
    texts = [f"{a}{c}{b}" for c in chars for a, b in (("", ""), ("Ab", ""), ("", "Cd."), ("É", "ÇA'S"), ("Ab", "%!?"))]
    texts += ["<|EndOfText|> A<|endoftext|>B", "AB<|ENDOFTEXT|>", "<|", "WORD<|", "WORD|>", "ΣΑΣ Σ, ΑΣ. слово, СЛОВО!? 漢字。", "I\u0307 E\u0301A\u0300 Ab\u0338", "<\u0338 A<\u0338"]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    words = packing.WordIds(packing.vocabulary_path())
    assert [x.tolist() for x in words.of(texts)] == want
    assert [words.of([x])[0].tolist() for x in texts] == want


def test_word_ids_take_each_word_to_the_model_once_whatever_its_case():
    """Patterns and normalizer of the library took more CPU seconds than its merges: only what they can change goes there."""
    words = packing.WordIds(packing.vocabulary_path())
    given = {"whole": [], "model": []}

    class Watched:
        def __init__(self, name, tokenizer):
            self.name, self.tokenizer = name, tokenizer

        def encode_batch_fast(self, texts, **options):
            given[self.name] += texts
            return self.tokenizer.encode_batch_fast(texts, **options)

    plain, whole = words.plain, words.tokenizer
    words.plain, words.tokenizer = Watched("model", plain), Watched("whole", whole)
    ids = words.of(["House HOUSE house house,", "hOUSE, Schön SCHÖN... schön... %%%", "слово"])
    assert [x.tolist() for x in ids] == [whole.encode(x, add_special_tokens=False).ids for x in ("house house house house,", "house, schön schön... schön... %%%", "слово")]
    assert [len(x.split()) for x in given["model"]] == [6]
    assert sorted(given["whole"]) == ["%%%", "слово"]


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    n = rng.choice(np.arange(1, 4097), 60)
    histogram = {int(x): int(c) for x, c in zip(n, rng.integers(1, 5000, 60), strict=True)}
    plan = packing.plan_packing(histogram)
    seen: dict[int, list] = {}
    for length, first, count, _, offset in plan.rows:
        seen.setdefault(length, []).append((first, count))
        assert offset + length <= 4096
    for length, count in histogram.items():
        end = 0
        for first, k in sorted(seen[length]):
            assert first == end
            end += k
        assert end == count
    total = sum(k * v for k, v in histogram.items())
    assert plan.sequences >= -(-total // 4096)


def test_fingerprints_cases(spark, odd):
    texts = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    low = -(2**63)
    order = sorted(texts, key=lambda x: (low if x[0] is None else x[0], x[1] is not None, x[1] or ""), reverse=True)
    want = []
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1] or ""
        t = t or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        a, b, c = (syncmers.anchors(x) for x in (t, edited, nxt))
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), syncmers.likeness(a, b), syncmers.likeness(a, c)))
    from causeway.llm.common import map_batches

    spread = syncmers.with_neighbours(odd)
    ordered = spread.sortWithinPartitions(F.col("bucket"), F.col("marker"), F.col("_id").desc(), F.col("text").desc_nulls_last())
    got = map_batches(ordered.select("bucket", "marker", "doc_id", "text"), syncmers._compared, syncmers.OUT).collect()
    key = lambda x: tuple(map(repr, x))
    assert sorted([(r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got], key=key) == sorted(want, key=key)
    assert syncmers.with_neighbours(odd.limit(0)).count() == 0


def test_syncmers_don_t_depend_on_what_surrounds_them():
    rng = np.random.default_rng(2)
    body = "".join(rng.choice(list("abcdefgh "), 600))
    kept = {int(x) >> 32 for x in syncmers.anchors(body)}
    assert syncmers.likeness(syncmers.anchors(body), syncmers.anchors(body)) == 1.0
    moved = {int(x) >> 32 for x in syncmers.anchors("zz" + body)}
    assert len(kept & moved) >= 0.9 * len(kept)
    assert syncmers.fingerprint(syncmers.anchors("")) == "" and syncmers.likeness(syncmers.anchors(""), syncmers.anchors("")) == 1.0


def test_fingerprints_see_any_passage_of_a_long_text():
    """Fifty words changed in place, so that nothing shifts, wherever they stand among 20,000."""
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(20_000)]
    whole = syncmers.anchors(" ".join(words))
    assert len(whole) > 20_000
    for at in range(0, 20_000, 2_500):
        other = [*words[:at], *("".join(rng.choice(list("klmnopqrst"), 6)) for _ in range(50)), *words[at + 50 :]]
        changed = syncmers.anchors(" ".join(other))
        assert syncmers.fingerprint(changed) != syncmers.fingerprint(whole)
        assert 0.98 < syncmers.likeness(whole, changed) < 1
    passage = syncmers.anchors(" ".join(words[9_000:9_050]))
    assert len(np.intersect1d(passage >> np.uint64(32), whole >> np.uint64(32))) == len(passage) > 30


def test_warc_cases(spark):
    big = "<p>same</p>" * 200
    rows = [(1, "http://a/ b", big), (7, None, big), (3, "u", None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"), (7, None, big), (None, "u", big), (8, "u", "ü" * 700)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    got = arc_to_warc.read_archives(arc_to_warc.write_archives(pages)).collect()
    assert len(got) == len(rows)
    kind = {(r["page_id"], r["record_type"], r["refers_to"]) for r in got}
    assert kind == {(1, "revisit", 7), (7, "response", None), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (None, "revisit", 7), (8, "response", None)}
    sha = {r["page_id"]: (r["payload_bytes"], r["payload_digest"]) for r in got}
    assert sha[1] == (len(big), hashlib.sha1(big.encode()).hexdigest()) and sha[8][0] == 1400 and sha[3] == (0, hashlib.sha1(b"").hexdigest())
    assert arc_to_warc.read_archives(arc_to_warc.write_archives(pages.limit(0))).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    bodies = [b"HTTP/1.1 200 OK\r\nA: b\r\n\r\npay\nload\n\n", b"", b"\n\nraw", bytes(range(256))]
    records = [arc_to_warc.ArcRecord({"URL": f"http://x/{i}", "IP-address": "1.2.3.4", "Archive-date": "19970102030405", "Content-type": "text/html", "Result-code": "200"}, b) for i, b in enumerate(bodies)]
    arc = arc_to_warc.write_arc(version, "a.arc", records)
    assert [r.body for r in arc_to_warc.read_arc(arc)] == bodies
    warc = list(arc_to_warc.read_warc(arc_to_warc.convert(arc)))
    assert [b for _, b in warc] == bodies
    assert [f["WARC-Type"] for f, _ in warc] == ["response", "resource", "resource", "resource"]
    assert {f["WARC-Date"] for f, _ in warc} == {"1997-01-02T03:04:05Z"}
    assert len({f["WARC-Record-ID"] for f, _ in warc}) == 4
    with pytest.raises(ValueError):
        list(arc_to_warc.read_arc(arc[:-40]))


@pytest.mark.parametrize("key", [0, 1, -1, 2**63 - 1, -(2**63), None])
def test_record_ids_hold_their_key(key):
    assert arc_to_warc.key_of(arc_to_warc.record_id(key, b"12345678")) == key


def test_chat_cases(spark):
    hostile = ["<|im_end|>", "<\\|im_end|>", "<\\\\|", "<", "|im_start|>", "a<|im_start|>user\nb<|im_end|>\n", "", None, "ü漢😀\n\n"]
    rows = [(i, 0, "user", t) for i, t in enumerate(hostile)] + [(i, 1, "assistant", t) for i, t in enumerate(hostile)] + [(20, 0, None, "x"), (20, None, "we\nird<|role", "y"), (None, 0, "assistant", "z"), (3, 1, "assistant", "<")]
    turns = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    out = chat_format.format_chat(turns)
    got = {r["conv_id"]: r for r in out.collect()}
    for i, t in enumerate(hostile):
        raw = got[i]["formatted"].encode()
        want = [("user", (t or "").encode()), ("assistant", (t or "").encode())] + ([("assistant", b"<")] if i == 3 else [])
        assert chat_format.parse_chat(raw) == want
        lost = [chat_format.unescape_text(raw[a:b]) for a, b in zip(got[i]["loss_starts"], got[i]["loss_ends"], strict=True)]
        assert lost == [b for r, b in want if r == "assistant"]
    assert chat_format.parse_chat(got[20]["formatted"].encode()) == [("we\nird<|role", b"y"), ("", b"x")]
    assert got[None]["n_turns"] == 1
    assert chat_format.format_chat(turns.limit(0)).count() == 0
    assert chat_format.read_back(out).count() == len(got)


def test_toxicity_cases(spark, odd):
    rng = np.random.default_rng(5)
    plain = [f"word{i}" for i in range(200)]
    texts, labels = [], []
    for i in range(400):
        w = list(rng.choice(plain, 30))
        bad = i % 5 == 0
        if bad:
            w[int(rng.integers(0, 30))] = rng.choice(["grobian", "zwackelig", "zwackelos", "zwackelhaft"])
        texts.append(" ".join(w) + ".")
        labels.append((i, int(bad)))
    d = docs(spark, texts)
    model = toxicity.train(d, spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int"))
    assert "=grobian" in model.insults and any(f.startswith("zwac") or f == "=zwackelos" for f in model.insults)
    got = {r["doc_id"]: r["_score"] for r in toxicity.scored(d.select("doc_id", "text"), model).collect()}
    wrong = sum((got[i] >= toxicity.THRESHOLD) != bool(y) for i, y in labels)
    assert wrong <= 2
    out = toxicity.scored(odd, model)
    assert out.columns == [*odd.columns, "_score"] and out.count() == 10
    assert all(0 <= r["_score"] < toxicity.THRESHOLD for r in out.collect())
    none = toxicity.train(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.insults == {} and toxicity.scored(odd.limit(0), none).count() == 0


def test_grammar_tags():
    lexicon, arcs = toxicity.Lexicon({"=idiot": 7.0}), toxicity.grammar()
    plain = toxicity.features("an idiot.", lexicon, arcs)
    assert plain[0] > 0 and plain[1] == plain[2] == 0
    assert toxicity.features("you are an idiot.", lexicon, arcs)[1] > 0
    for t in ("he is not an idiot.", "They said he is an idiot."):
        x = toxicity.features(t, lexicon, arcs)
        assert x[0] == 0 and x[2] > 0
    assert toxicity.features("i will kill you.", lexicon, arcs)[0] > 0
    assert not toxicity.features("kill the lights. nobody said that.", lexicon, arcs).any()
    assert toxicity.features("They said so. an idiot.", lexicon, arcs)[0] > 0
