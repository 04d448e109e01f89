"""Document fingerprints from closed syncmers.

A k-mer of code points is chosen if the smallest hash among its s-mers lies at its first or last place. Whether one
is chosen depends on its own characters only, so an edit leaves all anchors outside its reach as they were, and
equal passages carry equal anchors wherever they stand.

Short texts have few k-mers, so k and s go by the text's length (SCALES). The ranges of length overlap by more than a factor
of two: of two texts of which one is at most half as long again as the other, both have anchors of a common scale. A
text has some two chosen k-mers for each nine characters of its scale 12, more at the smaller ones.

A fingerprint is all chosen k-mers, each with its first position, in hexadecimal by hash: 8 digits of hash, of which the
last two bits tell the scale, 8 of position. Its length follows the text's. The likeness of two is the share of anchors in
their union, on their common scales, that both have and that lie in the same order in both (positional matching by
the longest increasing run of positions).

Defined results: null is empty text, whose fingerprint is empty and like another empty one (1) only; a text without
a chosen k-mer has one anchor, its whole content; texts without a common scale are not alike (0) unless they are equal;
repeated rows are documents each; a null doc_id comes after all others; rows of equal doc_id go by text, largest first,
null after all, and are compared in one task; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import NO_ID, map_batches, partitions_for, table

#: (k, s, least and below which number of code points): the scales' numbers are their places here.
SCALES = ((12, 4, 80, 2**62), (5, 2, 8, 240), (2, 1, 2, 24))
WHOLE = len(SCALES)
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _chosen(codes: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and 64-bit hashes of the closed syncmers."""
    n = len(codes)
    h = codes[: n - s + 1].copy()
    for j in range(1, s):
        h *= np.uint64(0x100000001B3)
        h += codes[j : n - s + 1 + j]
    h = _mix(h)
    m = n - k + 1
    least, held = h, 1  # the least of `held` s-mers from each place on, doubled while that many fit
    while 2 * held <= k - s + 1:
        least = np.minimum(least[:-held], least[held:])
        held *= 2
    lowest = np.minimum(least[:m], least[k - s + 1 - held :][:m])
    at = np.flatnonzero((h[:m] == lowest) | (h[k - s :] == lowest))
    third = np.uint64(0x9E3779B97F4A7C15)
    key = h[at]
    for step in (*range(s, k - s, s), k - s):
        key = _mix(key * third + h[at + step])
    return at, key


def anchors(text: str) -> np.ndarray:
    """Chosen k-mers as hash << 32 | position, one for each hash, in order of hash."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    found = []
    for scale, (k, s, least, below) in enumerate(SCALES):
        if k <= len(codes) and least <= len(codes) < below:
            at, key = _chosen(codes, k, s)
            key = (key >> np.uint64(32)) & ~np.uint64(3) | np.uint64(scale)
            found.append(key << np.uint64(32) | at.astype(np.uint64))
    if not sum(map(len, found)):
        whole = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=4).digest()
        return np.array([(int.from_bytes(whole, "big") & ~3 | WHOLE) << 32], dtype=np.uint64)
    return _distinct(np.concatenate(found))


def _distinct(both: np.ndarray) -> np.ndarray:
    """Sorted; of equal hashes the first position."""
    both = np.sort(both)
    key = both >> np.uint64(32)
    return both[np.append(True, key[1:] != key[:-1])]


def fingerprint(found: np.ndarray) -> str:
    return found.astype(">u8").tobytes().hex()


def _in_order(places: np.ndarray) -> int:
    """Length of the longest increasing run."""
    if len(places) < 2 or (places[1:] > places[:-1]).all():
        return len(places)
    tails: list[int] = []
    for x in places.tolist():
        i = bisect_left(tails, x)
        tails[i : i + 1] = [x]
    return len(tails)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if len(a) == len(b) and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    matched = union = 0
    low = np.uint64(0xFFFFFFFF)
    scale_a, scale_b = ((x >> np.uint64(32)) & np.uint64(3) for x in (a, b))
    for scale in range(len(SCALES)):
        x, y = a[scale_a == scale], b[scale_b == scale]
        if not len(x) or not len(y):
            continue
        hx, hy = x >> np.uint64(32), y >> np.uint64(32)
        at = np.minimum(np.searchsorted(hy, hx), len(hy) - 1)
        both = hy[at] == hx
        line = (y[at[both]] & low)[np.argsort(x[both] & low, kind="stable")]
        matched += _in_order(line)
        union += len(hx) + len(hy) - int(both.sum())
    return matched / union if union else 0.0


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (bucket, marker, id descending): each is compared with the next one of its bucket."""
    bucket, waiting = None, None
    for b in batches:
        rows = []
        for where, marker, doc, text in zip(*(b[c].to_pylist() for c in ("bucket", "marker", "doc_id", "text")), strict=True):
            if where != bucket:
                bucket, waiting = where, None
            elif marker and waiting is None:
                continue
            text = text or ""
            own = anchors(text)
            if waiting is not None:
                before, its, its_anchors = waiting
                cut = len(its) // 3
                edited = its[: len(its) - cut] + text[:cut]
                new = anchors(edited)
                rows.append((before, len(its), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(its_anchors), fingerprint(new), likeness(its_anchors, new), likeness(its_anchors, own)))
            waiting = None if marker else (doc, text, own)
        cols = list(zip(*rows, strict=True)) or [[]] * 7
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def with_neighbours(docs: DataFrame) -> DataFrame:
    """(bucket, marker, doc_id, text): ranges of ids, each with the document that follows it as a marker row.

    The driver gets the cut points and each range's largest id: a number of values that the number of partitions
    bounds. Texts are shuffled once.
    """
    spark = docs.sparkSession
    n = 2 * partitions_for(spark)
    rows = docs.select("doc_id", "text", F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("_id"))
    cuts = sorted({int(x) for x in rows.stat.approxQuantile("_id", [i / n for i in range(1, n)], 0.25 / n)}) if rows.head(1) else []
    edges = np.array(cuts, dtype=np.int64)
    own = map_batches(rows.select("_id"), _bucketed(edges), "bucket int, top long")
    largest = {r["bucket"]: r["top"] for r in own.groupBy("bucket").agg(F.max("top").alias("top")).collect()}
    order = sorted(largest)
    # The largest row of a range follows the smallest of the range above; that of the last range follows the smallest of all.
    goes = {largest[b]: order[(i + 1) % len(order)] for i, b in enumerate(order)}
    spread = map_batches(rows.select("doc_id", "text"), _placed(edges, goes), "bucket int, marker boolean, _id long, doc_id long, text string")
    return spread.repartitionById(max(1, len(cuts) + 1), "bucket")


def _bucketed(edges: np.ndarray):
    """The largest id of each range in each batch."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b["_id"].to_numpy(zero_copy_only=False)
            bucket = np.searchsorted(edges, ids)
            top = np.full(len(edges) + 1, NO_ID)
            np.maximum.at(top, bucket, ids)
            held = np.unique(bucket)
            yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(top[held])], ["bucket", "top"])

    return f


def _placed(edges: np.ndarray, goes: dict[int, int]):
    """Rows with the range of their id; those with a range's largest id once more, as markers of the range above."""
    tops = np.array(sorted(goes), dtype=np.int64)
    to = np.array([goes[k] for k in sorted(goes)], dtype=np.int32)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "marker", "_id", "doc_id", "text"]
        for b in batches:
            if not b.num_rows:
                continue
            ids = pc.fill_null(b["doc_id"], NO_ID).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(edges, ids).astype(np.int32)), pa.array(np.zeros(len(ids), dtype=bool)), pa.array(ids), b["doc_id"], b["text"]], names)
            at = np.minimum(np.searchsorted(tops, ids), len(tops) - 1)
            hit = np.flatnonzero(tops[at] == ids)
            if len(hit):
                rows = b.take(pa.array(hit))
                yield pa.RecordBatch.from_arrays([pa.array(to[at[hit]]), pa.array(np.ones(len(hit), dtype=bool)), pa.array(ids[hit]), rows["doc_id"], rows["text"]], names)

    return f


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = with_neighbours(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ordered = spread.sortWithinPartitions(F.col("bucket"), F.col("marker"), F.col("_id").desc(), F.col("text").desc_nulls_last())
    return map_batches(ordered.select("bucket", "marker", "doc_id", "text"), _compared, OUT)
