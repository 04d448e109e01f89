"""Toxicity by a weighted finite-state pattern grammar, scored clause by clause.

A lexical transducer turns words into classes: insult (with a weight), threat verb, intention, target, negation,
report, or other. Insults are learned: words and word beginnings that stand in many different contexts in toxic
training texts and in next to none of the others, weighted by log odds; copies of a text share
their contexts and so count once. Context transducers read the classes from left to right:

- target: a matched word within reach of a word of address weighs more;
- threat: an intention followed by a threat verb is a match of its own;
- negation and reported speech: a match in their scope is set apart, under its own evidence.

Their composition is one automaton over classes, built as the product of the tables, that runs over each clause once.
A clause's evidence is the sum of its matches' weights; the document's features are its strongest plain, targeted and
set-apart clauses and the total, and a logistic model over them gives the score.

Learning uses at most about TRAIN_ROWS labelled rows (by hash of the id), none of the held-out fold; scoring covers
every whole text. Defined results: null text is empty; a text without a match, empty ones too, gets the model's lowest
score; null labels teach nothing, of repeated labels the largest counts; with no or one-sided labels nothing is learned as an insult
and fixed weights score the threats; repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

import math

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from causeway.llm.common import bucket_of, map_batches, stored, table

#: Bound of the labelled rows that learning reads.
TRAIN_ROWS = 20_000
#: Features that may be learned; the strongest stay.
MAX_INSULTS = 20_000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: Lengths of word beginnings; a beginning is always shorter than its word.
PREFIXES = range(4, 10)
#: Share of a beginning's contexts that one word may have; above it the word itself is the feature.
ONE_WORD = 0.6
EDGE = ".,;:!?\"'()[]{}«»“”‘’¡¿*_-#$%&@+~^|<>/="
CLAUSE_END = frozenset(".;:!?")

OTHER, INSULT, THREAT, INTENT, TARGET, NEGATION, REPORT = "other", "insult", "threat", "intent", "target", "negation", "report"
#: Closed-class words of the grammar.
CLASSES = {
    TARGET: "you your yours u he she they them their his her people du dich dein deine ihr euch sie tu te toi ton vous votre ils usted ustedes tú ti ellos",
    NEGATION: "not no never nobody nothing neither isn't aren't wasn't don't doesn't didn't nicht kein keine nie niemals pas jamais aucun nunca jamás ni",
    REPORT: "said says say saying told called calls quoted quote claimed wrote writes according sagte sagt schrieb behauptet dit écrit déclaré dijo dice escribió llamó",
    INTENT: "will gonna going i'll we'll shall want werde wollen vais veux voy quiero",
    THREAT: "kill hurt destroy beat shoot stab strangle murder hang burn töten schlagen tuer frapper matar golpear",
}
THREAT_WEIGHT = 4.0
FEATURES = 5


@dataclass(frozen=True)
class Transducer:
    """A deterministic table over classes: (state, class) -> (state, tag). Missing entries go to `rest`."""

    states: int
    arcs: dict[tuple[int, str], tuple[int, str]] = field(default_factory=dict)
    rest: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, label: str) -> tuple[int, str]:
        return self.arcs.get((state, label)) or (self.rest.get(state, 0), "")


def scope(opening: str, tag: str, length: int | None) -> Transducer:
    """Tags matches up to `length` words after an opening word, or to the clause's end."""
    last = length or 1
    arcs: dict[tuple[int, str], tuple[int, str]] = {}
    for s in range(last + 1):
        arcs[s, opening] = (last, "")
        for match in (INSULT, THREAT):
            if s:
                arcs[s, match] = (s if length is None else s - 1, tag)
    rest = {s: s if length is None else s - 1 for s in range(1, last + 1)}
    return Transducer(last + 1, arcs, rest)


def threat(length: int = 4) -> Transducer:
    t = scope(INTENT, "threatened", length)
    return Transducer(t.states, {k: v for k, v in t.arcs.items() if k[1] != INSULT}, t.rest)


def compose(machines: list[Transducer]) -> dict[tuple[int, str], tuple[int, frozenset[str]]]:
    """The product automaton: its state is the tuple of states, its tags the union."""
    numbers: dict[tuple[int, ...], int] = {}
    table_: dict[tuple[int, str], tuple[int, frozenset[str]]] = {}
    for states in product(*(range(m.states) for m in machines)):
        numbers.setdefault(states, len(numbers))
    for states, n in numbers.items():
        for label in (OTHER, INSULT, *CLASSES):
            steps = [m.step(s, label) for m, s in zip(machines, states, strict=True)]
            table_[n, label] = numbers[tuple(s for s, _ in steps)], frozenset(t for _, t in steps if t)
    return table_


def grammar() -> dict[tuple[int, str], tuple[int, frozenset[str]]]:
    return compose([scope(TARGET, "targeted", 4), threat(), scope(NEGATION, "negated", 3), scope(REPORT, "reported", None)])


class Lexicon(dict):
    """Word as it stands in a text -> (class, weight, ends a clause); OTHER words map to None."""

    #: Bytes of words remembered; a word takes some 120 besides its letters.
    REMEMBERED = 16 << 20

    def __init__(self, insults: dict[str, float]):
        self.insults = insults
        self.closed = {w: c for c, words in CLASSES.items() for w in words.split()}
        self.room = self.REMEMBERED

    def __missing__(self, word: str):
        bare = word.strip(EDGE)
        found = None
        weight = max((self.insults.get("=" + bare, 0.0), *(self.insults.get(bare[:n], 0.0) for n in PREFIXES if len(bare) > n)))
        if weight:
            found = INSULT, weight
        elif bare in self.closed:
            found = self.closed[bare], THREAT_WEIGHT if self.closed[bare] == THREAT else 0.0
        if len(word) < 64 and self.room > 0:
            self[word] = found
            self.room -= len(word) + 120
        return found


def features(text: str | None, lexicon: Lexicon, arcs) -> np.ndarray:
    """Strongest plain, targeted and set-apart clause, total evidence, and matched clauses."""
    out = np.zeros(FEATURES)
    if not text:
        return out
    words = text.lower().split()
    classes = list(map(lexicon.__getitem__, words))
    if not any(c is not None and c[0] in (INSULT, THREAT) for c in classes):
        return out
    state, plain, targeted, apart, clauses, total = 0, 0.0, 0.0, 0.0, 0, 0.0
    best = [0.0, 0.0, 0.0]
    for word, c in zip(words, classes, strict=True):
        label, weight = c or (OTHER, 0.0)
        state, tags = arcs[state, label]
        if label == INSULT or label == THREAT and "threatened" in tags:
            if "negated" in tags or "reported" in tags:
                apart += weight
            else:
                plain += weight
                if "targeted" in tags:
                    targeted += weight
        if word[-1] in CLAUSE_END:
            best = [max(best[0], plain), max(best[1], targeted), max(best[2], apart)]
            total += plain + apart
            clauses += plain + apart > 0
            state, plain, targeted, apart = 0, 0.0, 0.0, 0.0
    best = [max(best[0], plain), max(best[1], targeted), max(best[2], apart)]
    total += plain + apart
    clauses += plain + apart > 0
    out[:] = *(math.log1p(x) for x in best), math.log1p(total), math.log1p(clauses)
    return out


# Learning


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, context) of toxic texts: words and word beginnings with a hash of the words around."""
    for b in batches:
        rows = set()
        for text in b["text"].to_pylist():
            words = [w.strip(EDGE) for w in (text or "").lower().split()]
            for before, w, after in zip(["", *words[:-1]], words, [*words[1:], ""], strict=True):
                if w:
                    around = hash_of(before + " " + after)
                    rows.update((f, around) for f in word_features(w))
        cols = list(zip(*rows, strict=True)) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64())], ["feature", "context"])


def hash_of(s: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) - 2**63


def word_features(w: str) -> list[str]:
    return ["=" + w, *(w[:n] for n in PREFIXES if len(w) > n)]


def _occurrences(wanted: frozenset[str]):
    """(feature, n) in other texts, of the wanted features only."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[str, ...]] = {}
        room = Lexicon.REMEMBERED
        for b in batches:
            counts: dict[str, int] = defaultdict(int)
            for text in b["text"].to_pylist():
                for word in (text or "").lower().split():
                    found = seen.get(word)
                    if found is None:
                        found = tuple(x for x in word_features(word.strip(EDGE)) if x in wanted)
                        if room > 0:
                            seen[word] = found
                            room -= len(word) + 160
                    for x in found:
                        counts[x] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["feature", "n"])

    return f


def _likelihood_ratio(n: float, c: float, base: float) -> float:
    p = n / (n + c)
    return n * math.log(p / base) + (c * math.log((1 - p) / (1 - base)) if c else 0.0)


def learned_insults(train: DataFrame) -> dict[str, float]:
    """Features of toxic texts that chance doesn't explain, with their log odds. `train`: text, toxic."""
    sizes = {r["toxic"]: r["size"] for r in train.groupBy("toxic").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("size")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return {}
    toxic = map_batches(train.where("toxic = 1").select("text"), _contexts, "feature string, context long")
    counted = stored(toxic.groupBy("feature").agg(F.count_distinct("context").alias("n")).where("n >= 4"), "features")
    contexts = {r["feature"]: r["n"] for r in counted.toLocalIterator()}
    clean = map_batches(train.where("toxic = 0").select("text"), _occurrences(frozenset(contexts)), "feature string, n long")
    others = {r["feature"]: r["n"] for r in clean.groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    base = sizes[1] / (sizes[0] + sizes[1])
    needed = math.log(max(2, len(contexts))) + 2
    odds: dict[str, float] = {}
    for f, n in contexts.items():
        c = others.get(f, 0)
        if n >= 19 * c and _likelihood_ratio(n, c, base) >= needed:
            odds[f] = min(8.0, math.log((n + 0.5) / (c + 0.5)) - math.log(base / (1 - base)))
    # A beginning that is mostly one word is left to the word; any other stands for all longer features under it.
    most: dict[str, int] = defaultdict(int)
    for f, n in contexts.items():
        if f.startswith("="):
            for k in PREFIXES:
                if len(f) - 1 > k:
                    most[f[1 : k + 1]] = max(most[f[1 : k + 1]], n)
    short = {f for f in odds if not f.startswith("=") and most[f] <= ONE_WORD * contexts[f]}
    bare = lambda f: f.removeprefix("=")
    kept = {f: w for f, w in odds.items() if (f in short or f.startswith("=")) and not any(bare(f)[:k] in short for k in PREFIXES if len(bare(f)) > k)}
    return dict(sorted(kept.items(), key=lambda x: (-x[1], x[0]))[:MAX_INSULTS])


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the ridge keeps unseen evidence at its prior weight."""
    prior = np.array([-3.0, 1.0, 0.2, 0.5, 0.5, 0.2])
    x = np.column_stack([np.ones(len(x)), x])
    w = prior.copy()
    if not len(y) or y.min() == y.max():
        return w
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * (w - prior)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Model:
    insults: dict[str, float]
    weights: list[float]


def _featured(insults: dict[str, float]):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, arcs = Lexicon(insults), grammar()
        for b in batches:
            x = [features(t, lexicon, arcs).tolist() for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b["toxic"]], ["x", "toxic"])

    return f


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. The held-out fold is left out, whatever labels hold."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (bucket_of("doc_id", FOLDS) != HELD_OUT)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * rows / n))
    sample = stored(docs.select("doc_id", "text").join(F.broadcast(stored(known, "labels")), "doc_id").select("text", "toxic"), "labelled")
    insults = learned_insults(sample)
    got = map_batches(sample, _featured(insults), "x array<double>, toxic int").toPandas()
    x = np.array(got["x"].tolist(), dtype=float).reshape(-1, FEATURES)
    return Model(insults, _fit(x, got["toxic"].to_numpy(dtype=float)).tolist())


def _scored(model: Model):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, arcs = Lexicon(model.insults), grammar()
        w = np.array(model.weights)
        for b in batches:
            x = np.array([features(t, lexicon, arcs) for t in b["text"].to_pylist()]).reshape(-1, FEATURES)
            score = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
            rest = [b[c] for c in b.schema.names]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(score)], [*b.schema.names, "_score"])

    return f


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs (with a column text) and `_score`."""
    schema = StructType([*docs.schema.fields, StructField("_score", DoubleType())])
    return map_batches(docs, _scored(model), schema)


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    return scored(docs, model).where(F.col("_score") < threshold).drop("_score")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))

    def outcome(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _scored(model)(batches):
            yield b.select(["doc_id", "_score"])

    out = map_batches(docs, outcome, "doc_id long, _score double")
    return out.select("doc_id", (bucket_of("doc_id", FOLDS) == HELD_OUT).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
