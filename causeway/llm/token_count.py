"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut into pretokens; a pretoken's bytes form a doubly linked list of symbols, its adjacent pairs a
heap by merge rank. The pair of lowest rank (leftmost of equals) is popped and merged until none has a rank.
The count is symbols minus merges: no identifier is built.

Repeated pretokens cost one look-up: a worker remembers the counts of the first REMEMBERED pretokens and
stretches between spaces that it meets, and merges any other anew; that bounds its memory and changes no result.

Defined results: null is empty text and has no tokens; special strings inside texts count as the tokenizer's
own default has them; ties, repeated rows and texts of any length need no special case; other columns are
ignored by `op6_token_count` and kept by `count_tokens`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import bounded_batches, map_batches, table

REMEMBERED = 400_000
LONGEST_REMEMBERED = 64
TOKEN_LIMIT = 512
#: White space as the tokenizer's regular expressions have it (Unicode White_Space).
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Fixed value: the pretoken pattern of byte-level vocabularies, with that class for \s.
PRETOKENS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the rest from U+0100 in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class HeapBpe:
    """Counts tokens of one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec["pre_tokenizer"]
        if kind["type"] != "ByteLevel" or not kind.get("use_regex", True) or spec["model"]["type"] != "BPE":
            raise ValueError(f"{path}: a byte-level BPE file is needed")
        numbers: dict[str, int] = {}
        number = lambda symbol: numbers.setdefault(symbol, len(numbers))
        self.first = [number(letter) for letter in byte_letters()]
        # left << 32 | right -> rank; rank -> the symbol it makes
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[number(a) << 32 | number(b)] = rank
            self.made.append(number(a + b))
        # The rank of each pair of bytes, -1 for none.
        self.byte_pairs = [self.ranks.get(a << 32 | b, -1) for a in self.first for b in self.first]
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern = regex.compile(PRETOKENS)
        self.odd_space = regex.compile(f" (?=[{SPACES}])")
        self.of_pretoken: dict[str, int] = {}
        self.of_stretch = _Stretches(self)

    def merge_count(self, pretoken: str) -> int:
        """Initial symbols minus merges."""
        raw = pretoken.encode("utf-8", "surrogatepass")
        n = len(raw)
        if n < 2:
            return n
        pairs = self.byte_pairs
        # now[i]: the rank of the pair that begins at i, -1 for none. A heap entry is rank << 32 | i.
        now = [pairs[a << 8 | b] for a, b in zip(raw, raw[1:], strict=False)]
        heap = [rank << 32 | i for i, rank in enumerate(now) if rank >= 0]
        if not heap:
            return n
        heapify(heap)
        now.append(-1)
        first, rank_of, made = self.first, self.ranks.get, self.made
        symbols = [first[b] for b in raw]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = 0
        while heap:
            entry = heappop(heap)
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            if now[i] != rank:  # stale: one side has gone into another merge
                continue
            merged = symbols[i] = made[rank]
            j = after[i]
            k = after[i] = after[j]
            merges += 1
            now[i] = now[j] = -1
            if k < n:
                before[k] = i
                if (rank := rank_of(merged << 32 | symbols[k], -1)) >= 0:
                    now[i] = rank
                    heappush(heap, rank << 32 | i)
            if (h := before[i]) >= 0:
                now[h] = rank = rank_of(symbols[h] << 32 | merged, -1)
                if rank >= 0:
                    heappush(heap, rank << 32 | h)
        return n - merges

    def count_pretoken(self, pretoken: str) -> int:
        known = self.of_pretoken
        n = known.get(pretoken)
        if n is None:
            n = self.merge_count(pretoken)
            if len(pretoken) <= LONGEST_REMEMBERED and len(known) < REMEMBERED:
                known[pretoken] = n
        return n

    def count_stretch(self, stretch: str) -> int:
        return sum(map(self.count_pretoken, self.pattern.findall(stretch)))

    def count_plain(self, text: str) -> int:
        """A space before a visible character always begins a pretoken, so stretches between such spaces are independent."""
        if not text:
            return 0
        if self.odd_space.search(text) or text[-1] == " ":
            parts = regex.split(f" (?=[^{SPACES}])", text)
        else:
            parts = text.split(" ")
        total = self.count_stretch(parts[0])
        return total + sum(map(self.of_stretch.__getitem__, parts[1:]))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self.count_plain(text)
        total = at = 0
        for m in self.special.finditer(text):
            total += self.count_plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self.count_plain(text[at:])


class _Stretches(dict):
    """Counts by what follows a space."""

    def __init__(self, bpe: HeapBpe):
        self.bpe = bpe

    def __missing__(self, part: str) -> int:
        n = self.bpe.count_stretch(" " + part)
        if len(part) <= LONGEST_REMEMBERED and len(self) < REMEMBERED:
            self[part] = n
        return n


@lru_cache(maxsize=4)
def bpe_of(path: str) -> HeapBpe:
    return HeapBpe(path)


def count_tokens(df: DataFrame, text: str = "text", out: str = "n_tokens", path: str | None = None) -> DataFrame:
    """df with the column `out`: tokens of the column `text`. The vocabulary's path must exist on the workers."""
    where = path or vocabulary_path()

    def tokens(texts):
        bpe = bpe_of(where)
        return pd.Series([bpe.count(x) for x in texts], dtype="int64")

    tokens.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    bounded_batches(df.sparkSession)
    return df.withColumn(out, F.pandas_udf(tokens, "long")(F.col(text)))


def _counts(path: str):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(path)
        for b in batches:
            texts = b["text"].to_pylist()
            n = [bpe.count(t) for t in texts]
            size = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > TOKEN_LIMIT for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return f


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return map_batches(docs, _counts(vocabulary_path()), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
