"""Language-model scoring by a weighted backoff automaton over all n-grams of the corpus.

1. Chunks: documents are tokenized once into chunks of about CHUNK_TOKENS tokens: numbers into the chunk's own list of
   words. The table of chunks ends the lineage.
2. Counting: each chunk names its distinct words, pairs and triples by hash, with their training occurrences, to
   buckets that are ranges of the hash. A bucket adds up and answers each chunk with the totals, in the same order.
   A chunk names an n-gram once, so no n-gram and no state is hot; all are kept, however rare.
3. Automaton: the answers make a chunk's own backoff automaton, which has just the states and arcs that its texts can
   reach, with the corpus' weights. States are the pairs and words seen in training and the root; an arc consumes a
   word and leads to the longest state that it ends; a failure arc drops the first word of a state.
4. Traversal: texts are read from left to right, many at a time; each carries its state, follows failure arcs until
   an arc has the next word, and adds up log-probabilities. Long texts are cut into lanes, each of which
   begins two words early: the state depends on no more than that.

Smoothing: p(w | context) = (1 - s) n / c + s p(w | shorter context), for the context's count c and the n-gram's count n;
a context passes on the share s of its mass, which depends on its length and on the power of two below c. A share
is learned by leaving one out: of the training words whose context stands c + 1 times in their chunk, those that
stand there once. Words have additive smoothing. In each context the probabilities of all words and one unknown word
add up to 1. Which documents share a chunk follows from how the input is split, and moves the learned shares by
a trifle; counts don't depend on it.

n-grams are taken as equal if their hashes are, of 24 bits more than number the corpus' tokens twice over (64 at most).

Defined results: null text is empty and has the end token only; repeated rows are scored and counted each; a null
doc_id has the fold of the empty string; without training texts every word has probability 1 over nothing
(log 0); an empty table gives no rows; other columns are ignored. A worker holds one chunk, and a text longer than
that whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import bucket_of, map_batches, partitions_for, stored, table
from causeway.llm.packed import pack, pack_sorted, unpack, unpack_sorted

FOLDS, HELD_OUT = 10, 0
ADDED = 0.1
CHUNK_TOKENS = 2_000_000
#: Bits of a hash beyond those that number the n-grams.
SPARE_BITS = 24
#: Tokens whose n-grams one bucket adds up, about.
BUCKET_TOKENS = 2_000_000
#: Tokens that one lane of a traversal reads.
LANE = 512
#: Powers of two that a context's count may reach.
CLASSES = 48
#: A blank can't be a word: it stands for the end, two for the beginning.
END, START = b" ", b"  "


def tokens(text: str | None) -> list[bytes]:
    """bytes.lower and bytes.split know A-Z and ASCII white space only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word, 7)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _extended(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of contexts followed by a word."""
    return _mix(_mix(context + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0x9E3779B97F4A7C15) + word)


# Chunks


class Numbers(dict):
    """Word -> number, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


@dataclass
class Chunk:
    """Texts as numbers into `words` (hashes; number 0 is the end), each closed by the end."""

    words: np.ndarray
    ids: np.ndarray
    lengths: np.ndarray
    learned: np.ndarray

    @property
    def bits(self) -> int:
        return len(self.words).bit_length()

    @property
    def start(self) -> int:
        """The number of the beginning, which is no word."""
        return len(self.words)


def in_order(values: np.ndarray, width: int) -> np.ndarray:
    """The places of values of `width` bits in rising order: sorting value and place as one word is much faster than argsort."""
    room = len(values).bit_length()
    cut = np.uint64(max(0, width + room - 64))
    word = np.sort((values >> cut) << np.uint64(room) | np.arange(len(values), dtype=np.uint64))
    order = (word & ((np.uint64(1) << np.uint64(room)) - np.uint64(1))).astype(np.int64)
    if cut:
        now = values[order]
        if (now[1:] < now[:-1]).any():
            order = order[np.argsort(now, kind="stable")]
    return order


def _distinct(keys: np.ndarray, width: int, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, rising; their occurrences in learned texts; the number of each key given."""
    order = in_order(keys, width)
    ranked = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    number = np.empty(len(keys), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    distinct = ranked[new]
    return distinct, np.bincount(number[learned], minlength=len(distinct)), number


@dataclass
class Grams:
    """The distinct n-grams of a chunk with their occurrences in its learned texts.

    pairs: first word << bits | second word; triples: number of the first pair << bits | last word. Both rise.
    pair_at, triple_at: for each token the number of the pair and triple that it ends; -1 for a text's first token, which
    ends no triple.
    """

    bits: int
    words_n: np.ndarray
    pairs: np.ndarray
    pairs_n: np.ndarray
    pair_at: np.ndarray
    triples: np.ndarray
    triples_n: np.ndarray
    triple_at: np.ndarray

    @classmethod
    def of(cls, chunk: Chunk) -> Grams:
        bits = np.uint64(chunk.bits)
        first = np.cumsum(chunk.lengths) - chunk.lengths
        taught = np.repeat(chunk.learned, chunk.lengths)
        words_n = np.bincount(chunk.ids[taught].astype(np.int64), minlength=len(chunk.words))
        before = np.roll(chunk.ids, 1)
        before[first] = chunk.start
        pairs, pairs_n, pair_at = _distinct(before << bits | chunk.ids, 2 * chunk.bits, taught)
        later = np.ones(len(chunk.ids), dtype=bool)
        later[first] = False
        context = np.roll(pair_at, 1)[later].astype(np.uint64)
        triples, triples_n, number = _distinct(context << bits | chunk.ids[later], len(pairs).bit_length() + chunk.bits, taught[later])
        triple_at = np.full(len(chunk.ids), -1)
        triple_at[later] = number
        return cls(chunk.bits, words_n, pairs, pairs_n, pair_at, triples, triples_n, triple_at)

    def split(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits = np.uint64(self.bits)
        return (keys >> bits).astype(np.int64), (keys & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)

    def hashes(self, words: np.ndarray, width: int) -> list[np.ndarray]:
        """Hashes of words, pairs and triples, of `width` bits."""
        words = np.append(words, np.uint64(word_hash(START)))
        a, b = self.split(self.pairs)
        pairs = _extended(words[a], words[b])
        p, c = self.split(self.triples)
        return [h >> np.uint64(64 - width) for h in (words[:-1], pairs, _extended(pairs[p], words[c]))]

    def left_out(self, learned_texts: int) -> np.ndarray:
        """By n-gram length (2, 3) and power of two below the context's count less one: training words, and those met once."""
        out = np.zeros((2, 2, CLASSES))
        context = np.append(self.words_n, learned_texts)
        for k, (n, c) in enumerate(((self.pairs_n, context[self.split(self.pairs)[0]]), (self.triples_n, self.pairs_n[self.split(self.triples)[0]]))):
            seen = (c > 1) & (n > 0)
            at = power_of_two(c[seen] - 1)
            out[k, 0] = np.bincount(at, weights=n[seen], minlength=CLASSES)
            out[k, 1] = np.bincount(at, weights=n[seen] == 1, minlength=CLASSES)
        return out


def power_of_two(n: np.ndarray) -> np.ndarray:
    """The exponent of the power of two at or below each count of 1 or more."""
    return np.minimum(np.frexp(n.astype(float))[1] - 1, CLASSES - 1)


CHUNKS = "chunk long, tokens long, train_tokens long, train_texts long, words binary, ids binary, lengths binary, learned binary, docs array<long>"


def _chunks(most: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 32
        numbers: Numbers = Numbers({END: 0})
        ids: list[np.ndarray] = []
        docs: list[tuple[int | None, bool]] = []
        size = 0

        def out() -> pa.RecordBatch:
            x = np.concatenate(ids)
            counts = np.bincount(x, minlength=len(numbers))
            counts[0] = len(x) + 1
            order = np.argsort(-counts, kind="stable")
            place = np.empty(len(order), dtype=np.uint64)
            place[order] = np.arange(len(order), dtype=np.uint64)
            words = np.fromiter(map(word_hash, numbers), dtype=np.uint64, count=len(numbers))[order]
            lengths, learned = np.array([len(i) for i in ids]), np.array([d[1] for d in docs])
            row = [serial, len(x), int(lengths[learned].sum()), int(learned.sum()), words.tobytes(), pack(place[x]), pack(lengths), pack(learned), [d[0] for d in docs]]
            kinds = (*[pa.int64()] * 4, *[pa.binary()] * 4, pa.list_(pa.int64()))
            names = ["chunk", "tokens", "train_tokens", "train_texts", "words", "ids", "lengths", "learned", "docs"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for b in batches:
            for doc, text, learned in zip(*(b[c].to_pylist() for c in ("doc_id", "text", "learned")), strict=True):
                words = tokens(text)
                words.append(END)
                ids.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words)))
                docs.append((doc, bool(learned)))
                size += len(words)
                if size >= most:
                    yield out()
                    numbers, ids, docs, size = Numbers({END: 0}), [], [], 0
                    serial += 1
        if docs:
            yield out()

    return f


def chunk_of(words: bytes, ids: bytes, lengths: bytes, learned: bytes) -> Chunk:
    return Chunk(np.frombuffer(words, dtype=np.uint64), unpack(ids), unpack(lengths).astype(np.int64), unpack(learned).astype(bool))


# Counting


def bounds(buckets: int, width: int) -> np.ndarray:
    """The least hash of each bucket."""
    return np.array([(k << width) // buckets for k in range(buckets)], dtype=np.uint64)


REQUESTS = "bucket int, level int, chunk long, grams binary, counts binary"
#: The level of a chunk's numbers for the smoothing, which go to one bucket beside its n-grams.
LEFT_OUT = 3


def _requests(buckets: int, width: int):
    low = bounds(buckets, width)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, *body in zip(*(b[c].to_pylist() for c in ("chunk", "words", "ids", "lengths", "learned")), strict=True):
                chunk = chunk_of(*body)
                grams = Grams.of(chunk)
                columns = (("bucket", pa.int32()), ("level", pa.int32()), ("chunk", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary()))
                yield _batch([(number % buckets, LEFT_OUT, number, None, grams.left_out(int(chunk.learned.sum())).tobytes())], columns)
                for level, (h, n) in enumerate(zip(grams.hashes(chunk.words, width), (grams.words_n, grams.pairs_n, grams.triples_n), strict=True)):
                    order = in_order(h, width)
                    h, n = h[order], n[order]
                    cut = [*np.searchsorted(h, low).tolist(), len(h)]
                    full = [k for k in range(buckets) if cut[k] < cut[k + 1]]
                    parts = [(k, level, number, pack_sorted(h[cut[k] : cut[k + 1]], int(low[k])), pack(n[cut[k] : cut[k + 1]])) for k in full]
                    yield _batch(parts, columns)

    return f


def _batch(rows: list[tuple], columns: tuple) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, columns, strict=True)], [n for n, _ in columns])


ANSWERS = "chunk long, level int, bucket int, seen long, totals binary, left_out array<double>"


def _answers(buckets: int, width: int):
    """Rows come by bucket and level. `seen`: distinct n-grams of training texts, once for each bucket and level."""
    low = bounds(buckets, width)
    columns = (("chunk", pa.int64()), ("level", pa.int32()), ("bucket", pa.int32()), ("seen", pa.int64()), ("totals", pa.binary()), ("left_out", pa.list_(pa.float64())))

    def answered(key: tuple[int, int], chunks: list[int], grams: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        if key[1] == LEFT_OUT:
            return _batch([(None, LEFT_OUT, key[0], 0, None, np.sum(counts, axis=0).tolist())], columns)
        cut = np.cumsum([len(g) for g in grams])[:-1]
        h, n = np.concatenate(grams), np.concatenate(counts).astype(np.int64)
        order = in_order(h, width)
        h = h[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        sums = np.add.reduceat(n[order], first)
        n[order] = np.repeat(sums, np.diff(np.append(first, len(h))))
        seen = [int((sums > 0).sum())] + [0] * (len(chunks) - 1)
        rows = [(c, key[1], key[0], s, pack(part), None) for c, s, part in zip(chunks, seen, np.split(n, cut), strict=True)]
        return _batch(rows, columns)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[int, int] | None = None
        held: tuple[list, list, list] = [], [], []
        for b in batches:
            for bucket, level, chunk, grams, counts in zip(*(b[c].to_pylist() for c in ("bucket", "level", "chunk", "grams", "counts")), strict=True):
                if at is not None and (bucket, level) != at:
                    yield answered(at, *held)
                    held = [], [], []
                at = bucket, level
                held[0].append(chunk)
                if level == LEFT_OUT:
                    held[2][:] = [sum((np.frombuffer(counts), *held[2]))]
                else:
                    held[1].append(unpack_sorted(grams, int(low[bucket])))
                    held[2].append(unpack(counts))
        if at is not None:
            yield answered(at, *held)

    return f


# The automaton


@dataclass(frozen=True)
class Smoothing:
    """What all chunks share. passed_on[k]: shares of contexts of k + 1 words, by power of two below their counts."""

    train_tokens: int
    train_texts: int
    vocabulary: int
    passed_on: tuple[tuple[float, ...], tuple[float, ...]]

    @property
    def denominator(self) -> float:
        return self.train_tokens + ADDED * (self.vocabulary + 1)


def passed_on(left_out: np.ndarray) -> tuple[float, ...]:
    """A class without training words takes the share of the class below."""
    out, last = [], 0.9
    for words, once in left_out.T.tolist():
        last = (once + 1) / (words + 2) if words else last
        out.append(last)
    return tuple(out)


class Automaton:
    """Backoff automaton of a chunk's texts.

    States: the pairs (by number), then the words and the beginning, then the root. An arc's weight and a failure's
    are log10 probabilities. Where the arcs that a token can follow lie, by the two words before it, by one and by none,
    was found when the chunk's n-grams were numbered; which of them a traversal follows its state tells.
    """

    def __init__(self, grams: Grams, start: int, n: list[np.ndarray], s: Smoothing):
        words, pairs, triples = n
        self.n_pairs, self.root = len(pairs), len(pairs) + start + 1
        word_p = (words + ADDED) / s.denominator
        context = np.append(words, s.train_texts)
        a, b = grams.split(grams.pairs)
        share = self._share(context, s.passed_on[0])
        pair_p = (1 - share[a]) * pairs / np.maximum(context[a], 1) + share[a] * word_p[b]
        p, _ = grams.split(grams.triples)
        #: The pair that a triple ends with.
        self.triple_to = np.empty(len(triples), dtype=np.int64)
        later = grams.triple_at >= 0
        self.triple_to[grams.triple_at[later]] = grams.pair_at[later]
        pair_share = self._share(pairs, s.passed_on[1])
        triple_p = (1 - pair_share[p]) * triples / np.maximum(pairs[p], 1) + pair_share[p] * pair_p[self.triple_to]
        with np.errstate(divide="ignore"):
            self.word_weight, self.pair_weight, self.triple_weight = np.log10(word_p), np.log10(pair_p), np.log10(triple_p)
            self.failure = np.log10(np.concatenate([pair_share, share]))
        self.seen_pair, self.seen_triple = pairs > 0, triples > 0
        self.word_to = np.where(words > 0, self.n_pairs + np.arange(len(words)), self.root)
        self.shorter = self.n_pairs + b
        self.begin = self.n_pairs + start if s.train_texts else self.root

    @staticmethod
    def _share(counts: np.ndarray, shares: tuple[float, ...]) -> np.ndarray:
        return np.where(counts > 0, np.array(shares)[power_of_two(np.maximum(counts, 1))], 1.0)

    def step(self, state: np.ndarray, triple: np.ndarray, pair: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From each state along the arc of its word, over failure arcs where it has none: weights and new states."""
        weight, to = np.zeros(len(state)), np.empty(len(state), dtype=np.int64)
        # States of two words.
        two = np.flatnonzero(state < self.n_pairs)
        has = self.seen_triple[triple[two]]
        at, arc = two[has], triple[two[has]]
        weight[at], to[at] = self.triple_weight[arc], self.triple_to[arc]
        failed = two[~has]
        weight[failed] = self.failure[state[failed]]
        # States of one word.
        one = np.append(failed, np.flatnonzero((state >= self.n_pairs) & (state < self.root)))
        shorter = np.append(self.shorter[state[failed]], state[one[len(failed) :]])
        has = self.seen_pair[pair[one]]
        at, arc = one[has], pair[one[has]]
        weight[at] += self.pair_weight[arc]
        to[at] = arc
        failed = one[~has]
        weight[failed] += self.failure[shorter[~has]]
        # The root has an arc for every word.
        at = np.append(failed, np.flatnonzero(state == self.root))
        weight[at] += self.word_weight[word[at]]
        to[at] = self.word_to[word[at]]
        return weight, to

    def read(self, grams: Grams, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The log10 probability of each text, read from left to right, all lanes at once."""
        begin = np.cumsum(lengths) - lengths
        lanes = -(-lengths // LANE)
        text = np.repeat(np.arange(len(lengths)), lanes)
        cut = (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        early = np.where(cut > 0, 2, 0)
        at, steps = begin[text] + cut - early, np.minimum(lengths[text] - cut, LANE) + early
        order = np.argsort(-steps, kind="stable")
        at, steps, early, text = at[order], steps[order], early[order], text[order]
        state = np.where(early > 0, self.root, self.begin)
        total = np.zeros(len(text))
        open_lanes = np.searchsorted(-steps, -np.arange(int(steps.max(initial=0))), side="left")
        for k, m in enumerate(open_lanes.tolist()):
            here = at[:m] + k
            weight, state[:m] = self.step(state[:m], grams.triple_at[here], grams.pair_at[here], ids[here])
            total[:m] += np.where(k < early[:m], 0.0, weight)
        return np.bincount(text, weights=total, minlength=len(lengths))


SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _scores(width: int, smoothing: Smoothing):
    """Rows come by chunk: the chunk, then its answers by level and bucket, which is the order of the hashes."""

    def scored_chunk(body: list, docs: list, totals: list[list[np.ndarray]]) -> pa.RecordBatch:
        chunk = chunk_of(*body)
        grams = Grams.of(chunk)
        n = []
        for h, parts in zip(grams.hashes(chunk.words, width), totals, strict=True):
            level = np.empty(len(h), dtype=np.int64)
            level[in_order(h, width)] = np.concatenate([*parts, np.empty(0, dtype=np.uint64)]).astype(np.int64)
            n.append(level)
        automaton = Automaton(grams, chunk.start, n, smoothing)
        ids = chunk.ids.astype(np.int64)
        text = np.repeat(np.arange(len(docs)), chunk.lengths)
        base = np.bincount(text, weights=automaton.word_weight[ids], minlength=len(docs))
        known = np.bincount(text, weights=n[0][ids] > 0, minlength=len(docs)).astype(np.int64)
        cols = (pa.array(docs, pa.int64()), pa.array(chunk.lengths), pa.array(known), pa.array(base), pa.array(automaton.read(grams, ids, chunk.lengths)))
        return pa.RecordBatch.from_arrays(list(cols), ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b[c][i].as_py() for c in b.schema.names}
                if row["bucket"] < 0:
                    if held is not None:
                        yield scored_chunk(*held)
                    held = [row[c] for c in ("words", "ids", "lengths", "learned")], row["docs"], [[], [], []]
                else:
                    held[2][row["level"]].append(unpack(row["totals"]))
        if held is not None:
            yield scored_chunk(*held)

    return f


def scored(docs: DataFrame, learned: str = "learned", chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text, and whether it is learned from)."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.coalesce(learned, F.lit(False)).alias("learned"))
    chunks = stored(map_batches(rows, _chunks(chunk_tokens), CHUNKS), "chunks")
    sizes = chunks.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "train_tokens", "train_texts"))).first()
    width = min(64, max(1, 2 * sizes["tokens"]).bit_length() + SPARE_BITS)
    partitions = partitions_for(spark)
    buckets = max(partitions, -(-sizes["tokens"] // BUCKET_TOKENS))
    named = map_batches(chunks.select("chunk", "words", "ids", "lengths", "learned"), _requests(buckets, width), REQUESTS)
    dealt = named.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "level", "chunk")
    answers = stored(map_batches(dealt, _answers(buckets, width), ANSWERS), "answers")
    left_out = np.zeros(4 * CLASSES)
    for r in answers.where(F.col("level") == LEFT_OUT).select(F.posexplode("left_out").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect():
        left_out[r["at"]] = r["n"]
    vocabulary = answers.where("level = 0").agg(F.coalesce(F.sum("seen"), F.lit(0)).alias("n")).first()["n"]
    shares = left_out.reshape(2, 2, CLASSES)
    smoothing = Smoothing(int(sizes["train_tokens"]), int(sizes["train_texts"]), int(vocabulary), (passed_on(shares[0]), passed_on(shares[1])))
    bodies = chunks.select("chunk", F.lit(0).alias("level"), F.lit(-1).alias("bucket"), "words", "ids", "lengths", "learned", "docs")
    both = bodies.unionByName(answers.where(F.col("level") < LEFT_OUT).select("chunk", "level", "bucket", "totals"), allowMissingColumns=True)
    home = F.pmod((F.shiftright("chunk", 32) + F.col("chunk").bitwiseAND(2**32 - 1)), F.lit(partitions)).cast("int")
    together = both.repartitionById(partitions, home).sortWithinPartitions("chunk", "level", "bucket")
    out = map_batches(together, _scores(width, smoothing), SCORED)
    return out.select("doc_id", "n_tokens", "n_known", F.lit(smoothing.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = bucket_of("doc_id", FOLDS) == HELD_OUT
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (~held_out).alias("learned"))
    return scored(docs).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
