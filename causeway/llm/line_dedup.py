"""Line dedup: range-partitioned line hashes, secondary sort, streamed first occurrences, keep bitmaps.

1. Every line of at least MIN_CHARS code points becomes (128-bit hash of its key, document, position); the text
   itself isn't shuffled here. The narrow table is written to the shared folder, so the text is parsed once.
2. Keys with at least half a partition's share of all lines are at most twice as many as partitions (HOT_KEYS at
   least). Their first document comes from a map-side pre-aggregated minimum, is broadcast, and their lines never
   meet in a task, so no range below holds more than its share and that of one cold key.
3. The other keys are range-partitioned by hash with documents and positions in order inside a key; a running
   first value streams along and marks every line of a later document.
4. Marks become one compressed keep bitmap per document: 64-bit words whose ones are lines that stay; a word
   that would be all ones is left out, so a document that keeps all its lines has no bitmap.
5. `apply_bitmaps` joins them to the texts.

DataFrame functions only. Defined results: null text is one empty line; a null doc_id is one id below all others;
rows of one doc_id are one document, each row keeping its own bitmap; a text's lines are split whole in the task that holds its row; an empty table gives no rows; other columns
pass through `drop_repeated_lines` untouched. Two keys are taken as equal if 128 bits of XXH64 agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from causeway.llm.common import identified, partitions_for, stored, table

MIN_CHARS = 10
HOT_KEYS = 1000
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    """A-Z to lower case; lower() does just that where all is ASCII, and faster."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(STRIPPED)))


def line_occurrences(docs: DataFrame) -> DataFrame:
    """(h1, h2, _cw_id, _cw_row, pos) of every line that may be dropped."""
    lines = docs.select("_cw_id", "_cw_row", F.posexplode(F.split("_cw_text", "\n", -1)).alias("pos", "line"))
    keyed = lines.select("_cw_id", "_cw_row", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= MIN_CHARS)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), F.col("key")).alias("h2"), "_cw_id", "_cw_row", "pos")


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """(_cw_id, _cw_row, _cw_words): keep bitmaps without their full words; rows that keep all lines have none."""
    spark = docs.sparkSession
    hot_keys = max(HOT_KEYS, 2 * partitions_for(spark))
    seen = stored(line_occurrences(docs), "lines")
    total = seen.count()
    by_key = seen.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("_cw_id").alias("first_id"))
    # n * hot_keys >= total holds for at most hot_keys keys.
    hot = stored(by_key.where((F.col("n") * hot_keys >= total) & (F.col("n") > 1)).select("h1", "h2", "first_id"), "hot-lines")
    hot = F.broadcast(hot)
    of_hot = seen.join(hot, ["h1", "h2"]).where("_cw_id > first_id").select("_cw_id", "_cw_row", "pos")
    cold = seen.join(hot, ["h1", "h2"], "left_anti").repartitionByRange(partitions_for(spark), "h1", "h2")
    in_order = W.partitionBy("h1", "h2").orderBy("_cw_id", "pos").rowsBetween(W.unboundedPreceding, 0)
    of_cold = cold.withColumn("first_id", F.first("_cw_id").over(in_order)).where("_cw_id > first_id").select("_cw_id", "_cw_row", "pos")
    word = F.expr("pos div 64").cast("int").alias("word")
    bits = F.bitwise_not(F.expr("bit_or(shiftleft(1L, pos % 64))")).alias("bits")
    words = of_hot.unionByName(of_cold).groupBy("_cw_id", "_cw_row", word).agg(bits)
    return words.groupBy("_cw_id", "_cw_row").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("_cw_words"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with `_cw_lines`, `_cw_dropped` (counts) and `_cw_kept` (the text that stays)."""
    joined = docs.join(bitmaps.hint("shuffle_hash"), ["_cw_id", "_cw_row"], "left")
    gone = F.expr("flatten(transform(_cw_words, w -> transform(filter(sequence(0, 63), b -> (shiftrightunsigned(w.bits, b) & 1L) = 0L), b -> w.word * 64 + b)))")
    lines = F.split("_cw_text", "\n", -1)
    out = joined.withColumn("_cw_all", lines).withColumn("_cw_gone", gone)
    kept = F.expr("array_join(transform(array_except(sequence(0, size(_cw_all) - 1), _cw_gone), i -> _cw_all[i]), '\n')")
    return out.select(
        *(c for c in docs.columns),
        F.size("_cw_all").cast("long").alias("_cw_lines"),
        F.when(F.col("_cw_words").isNull(), F.lit(0)).otherwise(F.size("_cw_gone")).cast("long").alias("_cw_dropped"),
        F.when(F.col("_cw_words").isNull(), F.col("_cw_text")).otherwise(kept).alias("_cw_kept"),
    )


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    rows = identified(docs, doc_id, text)
    return apply_bitmaps(rows, keep_bitmaps(rows))


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, each text without the lines that an earlier document holds."""
    return deduplicated(docs, doc_id, text).withColumn(text, F.col("_cw_kept")).select(*docs.columns)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = deduplicated(docs)
    return out.select("doc_id", F.col("_cw_lines").alias("n_lines"), F.col("_cw_dropped").alias("n_dropped"), F.sha2(F.col("_cw_kept"), 256).alias("kept_sha256"))


SQL_OP4 = f"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos from d),
k as (select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') as key from l),
f as (select key, min(doc_id) as first_id from k where length(key) >= {MIN_CHARS} group by key having min(doc_id) < max(doc_id)),
m as (select k.doc_id, pos, line, coalesce(k.doc_id > f.first_id, false) as gone from k left join f on k.key = f.key and length(k.key) >= {MIN_CHARS})
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by doc_id
"""
