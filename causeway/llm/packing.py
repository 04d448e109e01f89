"""Best-fit packing by patterns fitted with non-negative least squares.

1. Tokenize; cut only documents over the sequence length; one row per piece.
2. Histogram of piece lengths: at most SEQUENCE_LENGTH bins, whatever the corpus.
3. Enumerate patterns of one to three lengths that can fill a sequence (as cells of a grid of lengths), fit
   repeat counts to the histogram by NNLS, round down, and
   realise each repeat by lengths of the pattern's grid cells, longest first, that leave no token free. Repeats
   without such lengths go to the residual; of the others all or a share are kept, as the residual packs best.
4. Residual pieces are packed best-fit decreasing, also on the histogram. Should all pieces packed that way need
   fewer sequences than any fit with its residual, that plan is taken.
5. The plan is a table of ranges "the r-th to s-th piece of length L go to sequences from q, at offset o".
   Its size depends on the number of different lengths only, so it is small enough to ship to every task.
6. Pieces of a length are numbered in two levels (length, then a hash bucket of the id), so that one very
   common length is dealt to many tasks; the number is looked up in the plan.

Defined results: null text is empty and becomes the lone end id; repeated rows are packed each for itself;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import codecs
import os
import re
import string
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from causeway.llm.common import map_batches, partitions_for, stored, table

SEQUENCE_LENGTH = 4096
END_ID = 1
#: Cells of the length grid that patterns are made of; NNLS solves for patterns over these.
GRID = 40
#: Bytes of stretches whose ids a worker remembers; others are tokenized for each slice that has them. A stretch takes
#: some STRETCH_BYTES besides its letters.
REMEMBERED = 32 << 20
STRETCH_BYTES = 160
LONGEST_REMEMBERED = 64
#: Characters of texts that are looked up together.
SLICE_CHARS = 1 << 20
#: Marks that are a pretoken of their own after letters, however many they are.
MARKS = string.punctuation
#: Lines of letters of Latin-1, which no normalization but that of case changes, and marks; other lines give empty groups.
PLAIN = re.compile(r"^([A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]++)([!-/:-@\[-`{-~]*+)$|^.+$", re.MULTILINE)
#: The vocabulary's characters for bytes, and a blank for the blank between pretokens.
SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTES = "".join(chr(b if b in SHOWN or b == 0x20 else 0x100 + b - bisect_left(SHOWN, b)) for b in range(0x100))
#: Characters whose lower case may depend on others or on how they are composed.
FOREIGN = re.compile("[^\0-\xff]")
#: Shares of the fitted repeats that are tried, the last being best fit decreasing alone.
KEPT_SHARES = (1.0, 0.75, 0.5, 0.25, 0.0)
#: Pieces of one length are numbered in at least this many groups.
NUMBERING_BUCKETS = 64
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Stretches(dict):
    """Stretch between white space -> number, in order of appearance; those without one yet are listed in `new`."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, stretch: str) -> int:
        n = self[stretch] = len(self)
        self.new.append(stretch)
        return n


class WordIds:
    """Ids of texts, as little-endian 32-bit bytes, by look-up of the stretches between white space.

    The vocabulary drops white space before merging, so the ids of a text are those of its stretches in order.
    Letters and the marks after them are pretokens of their own; new ones are given to the tokenizer many at once, and
    the ids that end a word tell them apart again. Those of Latin-1 are cut and put in lower case here, and go to the
    library's model without its normalizer and patterns, which take more time than the merges. Texts are taken in
    slices; what a worker remembers between slices is bounded by REMEMBERED bytes.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        #: The same model, for pretokens that are normalized, written in its characters for bytes and stand between blanks.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = WhitespaceSplit()
        ids = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(ids.values()) + 1, dtype=bool)
        self.closes[[i for token, i in ids.items() if token.endswith("</w>")]] = True
        #: str.split() also cuts at these, the vocabulary doesn't.
        self.odd = re.compile("[\x1c-\x1f]")
        self.numbers = Stretches()
        self.held = 0
        #: The ids of all remembered stretches in one array, and how many each has.
        self.pool, self.sizes = np.empty(0, dtype="<u4"), np.empty(0, dtype=np.int64)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def encode_each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def joined(self, tokenizer, text: str, pretokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pretokens, one after another, and how many each has; by one call on their text, which has blanks between."""
        if not pretokens:
            return np.empty(0, dtype="<u4"), np.empty(0, dtype=np.int64)
        ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(pretokens):
            each = self.encode_each(pretokens)
            return np.concatenate(each), np.array([len(x) for x in each])
        return ids, np.diff(ends, prepend=0)

    def learned(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches, one after another, and how many each has."""
        cut = PLAIN.findall("\n".join(stretches))
        pretokens = [p for pair in cut for p in pair if p]
        ids, sizes = self.joined(self.plain, codecs.charmap_decode(" ".join(pretokens).lower().encode(), "strict", BYTES)[0], pretokens)
        total = _sums(sizes, np.array([(letters != "") + (marks != "") for letters, marks in cut], dtype=np.int64))
        rest = [i for i, (letters, _) in enumerate(cut) if not letters]
        if not rest:
            return ids, total
        foreign: list[int] = []
        others: list[int] = []
        pretokens, parts = [], []
        for i in rest:
            letters = stretches[i].rstrip(MARKS)
            # A capital dotted I becomes two characters in lower case, of which the second joins what follows.
            if letters.isalpha() and "\u0130" not in letters:
                foreign.append(i)
                pair = [p for p in (letters, stretches[i][len(letters) :]) if p]
                pretokens += pair
                parts.append(len(pair))
            else:
                others.append(i)
        by_letters, sizes = self.joined(self.tokenizer, " ".join(pretokens), pretokens)
        whole = self.encode_each([stretches[i] for i in others])
        plain = total.copy()
        total[foreign] = _sums(sizes, np.array(parts, dtype=np.int64))
        total[others] = [len(x) for x in whole]
        begin = np.cumsum(total) - total
        out = np.empty(int(total.sum()), dtype="<u4")
        out[_spread(begin, plain)] = ids
        for at, found in ((foreign, by_letters), (others, np.concatenate([np.empty(0, dtype="<u4"), *whole]))):
            out[_spread(begin[at], total[at])] = found
        return out, total

    def slice_of(self, split: list[list[str]]) -> list[np.ndarray]:
        """Ids of texts given as their stretches."""
        numbers = self.numbers
        counts = np.array([len(w) for w in split], dtype=np.int64)
        at = np.fromiter(map(numbers.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(counts.sum()))
        new, numbers.new = numbers.new, []
        pool, sizes = self.pool, self.sizes
        if new:
            ids, n = self.learned(new)
            pool, sizes = np.concatenate([pool, ids]), np.concatenate([sizes, n])
        begin = np.cumsum(sizes) - sizes
        ids = pool[_spread(begin[at], sizes[at])]
        ends = np.append(0, np.cumsum(sizes[at]))[np.append(0, np.cumsum(counts))]
        out = [ids[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        keep = 0
        for s in new:
            size = len(s) + STRETCH_BYTES
            if len(s) > LONGEST_REMEMBERED or self.held + size > REMEMBERED:
                break
            self.held += size
            keep += 1
        for s in new[keep:]:
            del numbers[s]
        if keep:
            self.sizes = sizes[: len(numbers)].copy()
            self.pool = pool[: int(self.sizes.sum())].copy()
        return out

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        split: list[list[str]] = []
        chars = 0
        foreign = FOREIGN.search
        for t in texts:
            if t and self.odd.search(t):
                out += self.slice_of(split)
                out.append(self.encode(t))
                split, chars = [], 0
                continue
            # The vocabulary drops case, and in lower case fewer stretches differ; special tokens are found as written only.
            split.append((t if "<|" in t or not t.isascii() and foreign(t) else t.lower()).split() if t else [])
            chars += len(t or "")
            if chars >= SLICE_CHARS:
                out += self.slice_of(split)
                split, chars = [], 0
        return out + self.slice_of(split)


def _spread(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... of each i in turn, sizes[i] of them."""
    return np.arange(int(sizes.sum())) + np.repeat(begin - np.cumsum(sizes) + sizes, sizes)


def _sums(sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of the first counts[0] sizes, the next counts[1], ..."""
    upto = np.append(0, np.cumsum(sizes))
    ends = np.cumsum(counts)
    return upto[ends] - upto[ends - counts]


@lru_cache(maxsize=4)
def words_of_vocabulary(path: str) -> WordIds:
    return WordIds(path)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pieces(path: str, limit: int):
    end = np.array([END_ID], dtype="<u4")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of_vocabulary(path)
        for b in batches:
            rows: list[tuple] = []
            for doc, ids in zip(b["doc_id"].to_pylist(), words.of(b["text"].to_pylist()), strict=True):
                ids = np.append(ids, end)
                for piece, start in enumerate(range(0, len(ids), limit)):
                    part = ids[start : start + limit]
                    rows.append((doc, piece, start, len(part), zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return f


def tokenized_pieces(docs: DataFrame, path: str | None = None, limit: int = SEQUENCE_LENGTH) -> DataFrame:
    """One row per piece of at most `limit` ids."""
    return map_batches(docs.select("doc_id", "text"), _pieces(path or vocabulary_path(), limit), PIECES)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """argmin |ax - b|, x >= 0, by the active-set method of Lawson and Hanson."""
    ata, atb = a.T @ a, a.T @ b
    x = np.zeros(a.shape[1])
    active = np.zeros(a.shape[1], dtype=bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(atb).max(initial=0)))
    for _ in range(rounds):
        gradient = atb - ata @ x
        gradient[active] = -np.inf
        best = int(np.argmax(gradient))
        if gradient[best] <= tolerance:
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            s = np.linalg.lstsq(ata[np.ix_(at, at)], atb[at], rcond=None)[0]
            if s.min(initial=1) > 0:
                x[:] = 0
                x[at] = s
                break
            falling = s <= 0
            steps = x[at][falling] / np.maximum(x[at][falling] - s[falling], 1e-300)
            x[at] += steps.min(initial=1.0) * (s - x[at])
            active[at[x[at] <= 1e-12]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def grid_edges(limit: int, cells: int = GRID) -> np.ndarray:
    """Upper ends of the cells: even steps over the range where several pieces share a sequence."""
    return np.unique(np.concatenate([[limit // 256, limit // 128, limit // 64], np.linspace(limit / cells, limit, cells).astype(int)]).clip(1))


def patterns(edges: np.ndarray, limit: int, depth: int = 3) -> list[tuple[int, ...]]:
    """Multisets of up to `depth` cells that hold lengths which fill a sequence to the last token."""
    low = np.append(0, edges[:-1]) + 1
    found: list[tuple[int, ...]] = []

    def extend(prefix: tuple[int, ...], least: int, most: int, top: int) -> None:
        if prefix and least <= limit <= most:
            found.append(prefix)
        if len(prefix) < depth:
            for c in range(top, -1, -1):
                if least + low[c] <= limit:
                    extend((*prefix, c), least + int(low[c]), most + int(edges[c]), c)

    extend((), 0, 0, len(edges) - 1)
    return found


class Plan:
    """Ranges (length, first number, count, first sequence, offset); sequences of a range are consecutive."""

    def __init__(self, limit: int):
        self.limit = limit
        self.sequences = 0
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.used: dict[int, int] = defaultdict(int)

    def put(self, lengths: list[int], repeats: int) -> None:
        """`repeats` sequences, each of these lengths in this order."""
        offset = 0
        same: dict[int, int] = defaultdict(int)
        for n in lengths:
            self.rows.append((n, self.used[n] + same[n] * repeats, repeats, self.sequences, offset))
            same[n] += 1
            offset += n
        for n, k in same.items():
            self.used[n] += k * repeats
        self.sequences += repeats


def plan_packing(histogram: dict[int, int], limit: int = SEQUENCE_LENGTH) -> Plan:
    """Where the pieces of each length go. Reads and returns a number of rows that `limit` alone bounds.

    The fitted repeats are kept whole or in part, whichever share needs the fewest sequences with its residual; should
    best fit decreasing alone need fewer than all of them, its plan is taken.
    """
    counts = {n: c for n, c in histogram.items() if c > 0}
    full = counts.pop(limit, 0)
    shapes = fitted_patterns(counts, limit)
    best: Plan | None = None
    fewest = full + -(-sum(n * c for n, c in counts.items()) // limit)
    for share in KEPT_SHARES:
        plan, left = Plan(limit), Left(counts)
        if full:
            plan.put([limit], full)
        for shape, repeats in shapes:
            _realise(plan, left, shape, int(repeats * share), limit)
        _best_fit(plan, left, limit)
        if best is None or plan.sequences < best.sequences:
            best = plan
        if best.sequences == fewest:  # the total length needs as many
            break
    return best


class Left:
    """Pieces still to place, by length."""

    def __init__(self, counts: dict[int, int]):
        self.count = dict(counts)
        self.lengths = sorted(counts)

    def longest(self, room: int, need: dict[int, int]) -> int | None:
        """The longest piece within the room that `need` hasn't taken."""
        at = bisect_right(self.lengths, room) - 1
        while at >= 0 and self.count[self.lengths[at]] <= need.get(self.lengths[at], 0):
            at -= 1
        return self.lengths[at] if at >= 0 else None

    def close(self, picked: list[int], need: dict[int, int], room: int) -> int:
        """Fills the room with the longest pieces that still fit; what stays free."""
        while room > 0 and (n := self.longest(room, need)) is not None:
            times = min(room // n, self.count[n] - need.get(n, 0))
            picked += [n] * times
            need[n] += times
            room -= n * times
        return room

    def use(self, plan: Plan, picked: list[int], need: dict[int, int], times: int) -> None:
        plan.put(picked, times)
        for n, k in need.items():
            self.count[n] -= k * times
            if not self.count[n]:
                del self.lengths[bisect_left(self.lengths, n)]


def fitted_patterns(counts: dict[int, int], limit: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns as ranges of lengths (over one, up to the other) and their fitted repeats, those of the longest pieces first."""
    if not counts:
        return []
    edges = grid_edges(limit)
    lengths = np.array(sorted(counts))
    cell = np.searchsorted(edges, lengths)
    size = np.zeros(len(edges))
    np.add.at(size, cell, [counts[int(n)] for n in lengths])
    shapes = patterns(edges, limit)
    a = np.zeros((len(edges), len(shapes)))
    for j, shape in enumerate(shapes):
        for c in shape:
            a[c, j] += 1
    # Long pieces have the fewest partners: an error there leaves the most room unused.
    weight = 0.1 + edges / limit
    repeats = np.floor(nnls(a * weight[:, None], size * weight) + 1e-9).astype(np.int64)
    order = sorted(np.flatnonzero(repeats), key=lambda j: (-max(shapes[j]), -len(shapes[j]), j))
    low = np.append(0, edges)
    return [([(int(low[c]), int(edges[c])) for c in shapes[j]], int(repeats[j])) for j in order]


def _exact(left: Left, shape: list[tuple[int, int]], room: int, need: dict[int, int]) -> list[int] | None:
    """Pieces of the shape's ranges, longest first, that fill the room to the last token."""
    low, high = shape[0]
    if len(shape) == 1:
        return [room] if low < room <= high and left.count.get(room, 0) > need.get(room, 0) else None
    at = bisect_right(left.lengths, min(room, high)) - 1
    while at >= 0 and (n := left.lengths[at]) > low:
        if left.count[n] > need.get(n, 0):
            need[n] += 1
            if (rest := _exact(left, shape[1:], room - n, need)) is not None:
                return [n, *rest]
            need[n] -= 1
        at -= 1
    return None


def _realise(plan: Plan, left: Left, shape: list[tuple[int, int]], repeats: int, limit: int) -> None:
    """Repeats of the shape by exact lengths that fill their sequences; what doesn't is left to the residual packer."""
    while repeats > 0 and (picked := _exact(left, shape, limit, defaultdict(int))) is not None:
        need = dict(Counter(picked))
        times = min(repeats, *(left.count[n] // k for n, k in need.items()))
        left.use(plan, picked, need, times)
        repeats -= times


def _best_fit(plan: Plan, left: Left, limit: int) -> None:
    """Longest first; each sequence is closed with the longest pieces that still fit, in runs of equal shape."""
    while left.lengths:
        picked: list[int] = []
        need: dict[int, int] = defaultdict(int)
        left.close(picked, need, limit)
        left.use(plan, picked, need, min(left.count[n] // k for n, k in need.items()))


def _numbered(pieces: DataFrame, buckets: int) -> DataFrame:
    """Adds `number`, 0.. within each length: a window per (length, bucket), plus the bucket's start."""
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("place", F.row_number().over(within) - 1)
    return ranked.join(starts, ["length", "bucket"]).withColumn("number", F.col("base") + F.col("place")).drop("bucket", "place", "base")


def _placed(plan: Plan):
    rows = np.array(sorted(plan.rows), dtype=np.int64).reshape(-1, 5)
    keys = rows[:, 0] << 44 | rows[:, 1]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = (b[c].to_numpy(zero_copy_only=False) for c in ("length", "number"))
            at = rows[np.searchsorted(keys, length << 44 | number, side="right") - 1]
            yield pa.RecordBatch.from_arrays(
                [*(b[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(at[:, 3] + number - at[:, 1]), pa.array(at[:, 4])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return f


def pack(pieces: DataFrame, limit: int = SEQUENCE_LENGTH) -> DataFrame:
    """`pieces` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    spark = pieces.sparkSession
    pieces = stored(pieces, "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_packing(histogram, limit)
    numbered = _numbered(pieces, max(NUMBERING_BUCKETS, partitions_for(spark)))
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(_placed(plan), PIECES + ", sequence_id long, offset long")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(tokenized_pieces(table(spark, sf_dir, "documents")))
