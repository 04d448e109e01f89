"""SimHash near-dedup with a Gray-order hierarchical index.

1. Fingerprints: each bit is the majority of the shingle hashes' bits. Equal fingerprints become one row.
2. Blocks: the 64 bits are cut into `blocks` blocks. Fingerprints within LINK_BITS bits agree on all but LINK_BITS
   blocks, so grouping by each choice of `blocks - LINK_BITS` blocks brings every linked pair together in some group.
   The number of blocks follows the number of fingerprints, so that a chance group stays small.
3. Index: a group is sorted by Gray rank, in which neighbours differ in few bits. Runs of FANOUT rows factor the bits
   they share into a node (mask and pattern), runs of nodes into upper nodes. A search adds up the differences from a
   node's masked pattern and drops the whole run beyond LINK_BITS; it takes the whole run without looking at its
   members if even all its free bits can't exceed LINK_BITS; and it skips runs already connected to the query.
4. Links: a group returns one link per row at most, to the first row that it is connected with, never all pairs.
5. Components by star contraction over the link table.

A group over CHUNK rows is dealt into chunks by a hash, one task for each pair of chunks: exact for any size, with two
chunks in memory. Defined results: null text has no words; documents without words have fingerprint zero, linked
like any other; a null doc_id is no candidate for the smallest id of a component; repeated rows stay; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import identified, map_batches, stored, table
from causeway.llm.components import components

SHINGLE_WORDS = 4
LINK_BITS = 4
#: Rows of a group that one task indexes at most, twice over.
CHUNK = 4096
FANOUT = 8
#: Rows searched at a time; with CHUNK it bounds the memory of a search.
QUERIES = 512
#: Rows indexed together, many small groups or one large one.
GATHER = 32_768


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of the text's shingles. bytes.lower and bytes.split know A-Z and ASCII white space only."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= width:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1) - 1
    starts = np.append(0, ends[:-1] + 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[i:j], 42) for i, j in zip(starts, ends[width - 1 :].tolist(), strict=False)], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def signed(x: int) -> int:
    return x - 2**64 if x >> 63 else x


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = [signed(fingerprint(t)) for t in b["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["_cw_row"], pa.array(fp, pa.int64())], ["doc_id", "_cw_row", "fp"])


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, _cw_row, fp) of every row; _cw_row is the hash of the text that `identified` gives."""
    rows = identified(docs).select("doc_id", "_cw_row", F.col("_cw_text").alias("text"))
    return map_batches(rows, _fingerprints, "doc_id long, _cw_row long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of a word in the reflected Gray sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


class GrayIndex:
    """Rows sorted by group and Gray rank, under levels of nodes that hold what their rows share."""

    def __init__(self, fp: np.ndarray, group: np.ndarray):
        order = np.lexsort((gray_rank(fp), group))
        self.order, self.fp, self.group = order, fp[order], group[order]
        n = len(fp)
        first, last, ones, zeros, own = np.arange(n), np.arange(n), self.fp, ~self.fp, self.group
        #: Each level: first and last row, mask of shared bits, their values, and where the children begin and end.
        self.levels: list[tuple] = []
        while True:
            begins = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            if self.levels and len(begins) == len(own):
                break
            size = np.diff(np.append(begins, len(own)))
            place = np.arange(len(own)) - np.repeat(begins, size)
            head = np.flatnonzero(place % FANOUT == 0)
            tail = np.append(head[1:], len(own))
            ones, zeros = np.bitwise_and.reduceat(ones, head), np.bitwise_and.reduceat(zeros, head)
            first, last, own = first[head], last[tail - 1], own[head]
            self.levels.append((first, last, ones | zeros, ones, head, tail))
            if len(np.unique(own)) == len(own):
                break

    def links(self, bits: int = LINK_BITS) -> np.ndarray:
        """For each row (in sorted order) the first row it is connected with in its group."""
        n = len(self.fp)
        label = np.arange(n)
        full = np.uint64(2**64 - 1)
        root = self.levels[-1]
        root_of = np.searchsorted(root[0], np.arange(n), side="right") - 1
        # Runs whose free bits are few are connected within themselves.
        for first, last, mask, *_ in self.levels:
            for f, t in zip(*(x[np.bitwise_count(mask ^ full) <= bits] for x in (first, last)), strict=True):
                np.minimum(label[f : t + 1], label[f], out=label[f : t + 1])
        for start in range(0, n, QUERIES):
            q = np.arange(start, min(n, start + QUERIES))
            node = root_of[q]
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for depth in range(len(self.levels) - 1, -1, -1):
                first, last, mask, ones, head, tail = self.levels[depth]
                apart = np.bitwise_count((self.fp[q] ^ ones[node]) & mask[node])
                keep = (apart <= bits) & (first[node] < q)
                low, high = np.minimum.reduceat(label, first), np.maximum.reduceat(label, first)
                keep &= ~((low[node] == high[node]) & (low[node] == label[q]))
                q, node, apart = q[keep], node[keep], apart[keep]
                whole = apart + np.bitwise_count(mask[node] ^ full) <= bits
                if whole.any():
                    found.append((q[whole], first[node[whole]]))
                    q, node = q[~whole], node[~whole]
                count = tail[node] - head[node]
                q = np.repeat(q, count)
                node = np.repeat(head[node], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            near = (node < q) & (np.bitwise_count(self.fp[q] ^ self.fp[node]) <= bits)
            found.append((q[near], node[near]))
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            while len(a):
                x, y = label[a], label[b]
                if (x == y).all():
                    break
                # Only labels' own labels move, never a row's by itself: all rows that carry one follow.
                m = np.minimum(x, y)
                np.minimum.at(label, x, m)
                np.minimum.at(label, y, m)
                label = _settled(label)
        return label


def _settled(label: np.ndarray) -> np.ndarray:
    while True:
        deeper = label[label]
        if (deeper == label).all():
            return label
        label = deeper


def linked(fp: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (row's fingerprint, that of the first row it is connected with) that span each group's components."""
    counts = np.unique(group, return_inverse=True, return_counts=True)
    many = counts[2][counts[1]] > 1
    if not many.any():
        return fp[:0], fp[:0]
    index = GrayIndex(fp[many], group[many])
    label = index.links()
    own = np.flatnonzero(label != np.arange(len(label)))
    return index.fp[own], index.fp[label[own]]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by task; whole tasks are gathered until there are enough rows to index together."""

    def done(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        group, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
        u, v = linked(fp.view(np.uint64), group)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    parts: list[tuple[np.ndarray, np.ndarray]] = []
    rows = serial = 0
    end: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = [b[c].to_numpy(zero_copy_only=False) for c in ("choice", "bits", "low", "high")]
        fp = b["fp"].to_numpy(zero_copy_only=False)
        new = np.zeros(len(fp), dtype=bool)
        new[0] = end is None or tuple(k[0] for k in keys) != end
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        group = serial + np.cumsum(new)
        serial, end = int(group[-1]), tuple(k[-1] for k in keys)
        starts = np.flatnonzero(new)
        if rows >= GATHER and len(starts):
            cut = int(starts[0])
            parts.append((group[:cut], fp[:cut]))
            yield done(parts)
            parts, rows = [], 0
            group, fp = group[cut:], fp[cut:]
            if len(fp) >= GATHER and len(starts) > 1:
                cut = int(starts[-1]) - int(starts[0])
                yield done([(group[:cut], fp[:cut])])
                group, fp = group[cut:], fp[cut:]
        parts.append((group, fp))
        rows += len(fp)
    if parts:
        yield done(parts)


def block_choices(count: int) -> list[int]:
    """Masks whose bits any two linked fingerprints agree on for at least one mask; chance groups stay below some hundreds."""
    blocks = LINK_BITS + 2
    while count / 2 ** (64 * (blocks - LINK_BITS) / blocks) > 256 and blocks < 12:
        blocks += 1
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return [sum(c) for c in combinations(parts, blocks - LINK_BITS)]


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Links (u, v) that span the components of distinct fingerprints `fp`."""
    spark = fps.sparkSession
    masks = [signed(m) for m in block_choices(fps.count())]
    choice = F.explode(F.array(*(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)))).alias("at")
    keyed = fps.select("fp", choice).select("at.choice", "at.bits", "fp")
    sizes = keyed.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n"))
    large = stored(sizes.where(F.col("n") > CHUNK).select("choice", F.bitwise_not("bits").alias("match"), F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "large-groups")
    if large.count():
        keyed = keyed.withColumn("match", F.bitwise_not("bits")).join(large, ["choice", "match"], "left").drop("match")
    else:
        keyed = keyed.withColumn("chunks", F.lit(None).cast("int"))
    chunks = F.coalesce("chunks", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), chunks - 1), lambda j: F.struct(F.least(own, j).alias("low"), F.greatest(own, j).alias("high")))
    tasks = keyed.select("choice", "bits", "fp", F.explode(pairs).alias("pair")).select("choice", "bits", "pair.low", "pair.high", "fp")
    dealt = tasks.repartition("choice", "bits", "low", "high").sortWithinPartitions("choice", "bits", "low", "high")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    return dealt.mapInArrow(_search, "u long, v long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, _cw_row, fp, component_id) of every row."""
    rows = stored(document_fingerprints(docs), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(fingerprint_links(distinct.select("fp")))
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    # Joined on complements, so that a hub of either kind can be split between tasks.
    named = placed.withColumn("k", F.bitwise_not("root")).join(least.select(F.bitwise_not("root").alias("k"), "component_id"), "k")
    named = named.select(F.bitwise_not("fp").alias("k"), "component_id")
    return rows.withColumn("k", F.bitwise_not("fp")).join(named, "k").select("doc_id", "_cw_row", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs, of each component the row of smallest id only; of rows that share that id, one with the smallest text hash."""
    found = near_duplicates(docs)
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component_id").agg(F.min("_cw_row").alias("_cw_row"))
    rows = identified(docs)
    keep = keep.select(F.coalesce("component_id", F.lit(-(2**63))).alias("_cw_id"), "_cw_row")
    kept = rows.join(keep.hint("shuffle_hash"), ["_cw_id", "_cw_row"], "left_semi")
    return kept.dropDuplicates(["_cw_id", "_cw_row"]).select(*docs.columns)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
