"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Items are short, documents long, so a sketch of the document says little about an item. The sketch is the item's:
its k smallest shingle hashes (a bottom-k MinHash). An item of n shingles that a document contains to a share of t or
more misses at most (1 - t) * n of them, so one of its (1 - t) * n + 1 smallest is in the document. Items
are partitioned by size, to powers of two, and a partition's largest size `top` sets its k = (1 - t) * top + 1: recall is 1 in
every partition, with sketches of one hash up to size 4, 2 up to 8, 4 up to 16, 7 up to 32, 13 up to 64 and so on.

1. Candidates: shingle hashes of each document meet the sketches. Only hits leave the scan.
2. Verification: for documents with a candidate the shared shingles of each candidate pair are counted.

Sketches and item shingles are broadcast only after a count shows them within BROADCAST_ROWS, and joined by a shuffle
otherwise; so are the candidates' ids. DataFrame functions only.

Defined results: words are runs outside [\\x20\\x09-\\x0D], A-Z in lower case; a shingle is five words; an item of
fewer words is one shingle of that many, an item of none is never found; null text is empty; equal items are each
found; rows of equal doc_id and text are reported once; a text is cut into words and shingles whole, in the task that holds its row; null ids stay null; other columns are ignored.
Shingles are taken as equal if their 64-bit hashes are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import NO_ID, identified, stored, table
from causeway.llm.line_dedup import LOWER, UPPER, lower_ascii

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), "[ \\t\\n\\x0B\\f\\r]+", -1), lambda w: w != "")


def shingle_hashes(words_column: str, n: int) -> Column:
    """Hashes of all runs of n words, repeats included; none where there are fewer words."""
    at = ", ".join(f"{words_column}[i + {j}]" for j in range(n))
    return F.expr(f"case when size({words_column}) >= {n} then transform(sequence(0, size({words_column}) - {n}), i -> xxhash64({n}, {at})) else array() end")


def item_shingles(items: DataFrame, item_id: str = "item_id", text: str = "text", threshold: float = CONTAINMENT) -> DataFrame:
    """(item_id, n, width, h, sketched): distinct shingles, their words, and whether the item's sketch has them."""
    w = items.select(F.col(item_id).alias("item_id"), F.monotonically_increasing_id().alias("item"), words(F.coalesce(F.col(text), F.lit(""))).alias("w")).where(F.size("w") > 0)
    width = F.least(F.size("w"), F.lit(SHINGLE_WORDS)).alias("width")
    hashes = F.array_sort(F.array_distinct(F.coalesce(*(F.when(F.least(F.size("w"), F.lit(SHINGLE_WORDS)) == n, shingle_hashes("w", n)) for n in range(1, SHINGLE_WORDS + 1)))))
    h = w.select("item_id", "item", width, hashes.alias("hs")).withColumn("n", F.size("hs"))
    top = F.pow(F.lit(2.0), F.ceil(F.log2("n")))
    k = (F.floor((1 - threshold) * top + 1e-9) + 1).cast("int")
    return h.select("item_id", "item", "n", "width", F.posexplode("hs").alias("place", "h")).withColumn("sketched", F.col("place") < k.cast("int"))


def _within(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def document_shingles(docs: DataFrame, widths: list[int]) -> DataFrame:
    """(_cw_id, _cw_row, h): hashes of the documents' shingles of these widths, each once."""
    w = docs.select("_cw_id", "_cw_row", words(F.col("_cw_text")).alias("w"))
    parts = [shingle_hashes("w", n) for n in widths]
    return w.select("_cw_id", "_cw_row", F.explode(parts[0] if len(parts) == 1 else F.concat(*parts)).alias("h"))


def contained_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = CONTAINMENT) -> DataFrame:
    """(_cw_id, _cw_row, item_id, n_shingles, n_found) of every document and item it contains to the threshold or more."""
    rows = identified(docs.select(doc_id, text), doc_id, text)
    shingles = stored(item_shingles(items, threshold=threshold), "items")
    widths = sorted(r["width"] for r in shingles.select("width").distinct().collect()) or [SHINGLE_WORDS]
    sketches = _within(shingles.where("sketched").select("h", "item", "item_id", "n"))
    hits = document_shingles(rows, widths).join(sketches, "h").select("_cw_id", "_cw_row", "item", "item_id", "n").distinct()
    candidates = stored(hits, "candidates")
    documents = _within(candidates.select("_cw_id", "_cw_row").distinct())
    again = rows.join(documents, ["_cw_id", "_cw_row"], "left_semi")
    found = document_shingles(again, widths).join(_within(shingles.select("h", "item")), "h").distinct()
    counted = found.groupBy("_cw_id", "_cw_row", "item").agg(F.count(F.lit(1)).alias("n_found"))
    verified = counted.join(candidates, ["_cw_id", "_cw_row", "item"])
    enough = F.col("n_found") >= F.ceil(threshold * F.col("n") - 1e-9)
    return verified.where(enough).select("_cw_id", "_cw_row", "item_id", F.col("n").cast("long").alias("n_shingles"), "n_found")


def without_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that contain an item."""
    hit = stored(contained_items(docs, items, doc_id, text).select("_cw_id", "_cw_row").distinct(), "contaminated")
    return identified(docs, doc_id, text).join(_within(hit), ["_cw_id", "_cw_row"], "left_anti").select(*docs.columns)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of document and item; documents that aren't listed contain none."""
    found = contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.when(F.col("_cw_id") != NO_ID, F.col("_cw_id")).alias("doc_id"), "item_id", "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment"))


SQL_OP5 = f"""
with t as (select 'd' as kind, doc_id as id, text from documents union all select 'i', item_id, text from benchmark),
w as (select kind, id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') as w from t),
i as (select id, w, least(len(w), {SHINGLE_WORDS}) as width from w where kind = 'i' and len(w) > 0),
s as (select distinct id as item_id, width, array_to_string(w[p : p + width - 1], ' ') as s
      from (select id, w, width, unnest(range(1, len(w) - width + 2)) as p from i)),
n as (select item_id, count(*) as n_shingles from s group by item_id),
g as (select distinct width from s),
x as (select distinct id as doc_id, width, array_to_string(w[p : p + width - 1], ' ') as s
      from (select id, w, width, unnest(range(1, len(w) - width + 2)) as p from w, g where kind = 'd' and len(w) >= width)),
c as (select doc_id, item_id, count(*) as n_found from x join s using (width, s) group by doc_id, item_id)
select doc_id, item_id, n_shingles, n_found, n_found / n_shingles as containment from c join n using (item_id)
where n_found >= ceil({CONTAINMENT} * n_shingles - 1e-9)
"""
