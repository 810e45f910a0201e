"""Benchmark decontamination in DataFrame functions alone.

The windows of the benchmark (``n`` consecutive words of an item; all words of a shorter one) are the broadcast side of a hash join.
Each document is cut into words once, its windows are hashed word by word inside one generated stage, and what meets a
benchmark window's hash is compared with its words. A document also sends one row of its own, so that clean documents are in the
result without a second pass. Only hits and these rows are shuffled, never texts.

A benchmark of more than ``BROADCAST_WINDOWS`` windows isn't broadcast: documents' windows are shuffled as two 64-bit hashes each,
which stand for the words then; adaptive execution splits hot windows.

Defined results: a null text has no words and hits nothing; an item without words has no window; items are told apart by
item_id (a null one is an item named by the empty text), so that rows of one item_id are one item; each row of documents is a
document, whether rows or ids repeat or are null. Texts of any length are read whole. Empty tables give empty results, or
clean documents. Further columns are not read, and are kept under their names by the functions that return documents.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.storage import drop, materialize, numbered

WINDOW = 10
BROADCAST_WINDOWS = 500_000
#: A word of a text whose A-Z are lower-cased, and of one as it is.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


KEY = ["doc_id", "digest", "part"]


def words(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase), F.lit(WORD), F.lit(0))


def digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """(window, k, item): the windows of every item as arrays of ``k`` words, each once."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = items.withColumn("k", F.least(F.size("words"), F.lit(n)))
    each = items.select("item", "k", "words", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("k") + 1)).alias("at"))
    return each.select(F.slice("words", F.col("at"), F.col("k")).alias("window"), "k", "item").distinct()


def numbered_windows(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables of the different windows (gram, window, k, h, h2) and of their items (gram, item)."""
    windows = materialize(windows, "windows")
    both = [F.xxhash64("window").alias("h"), F.xxhash64(F.lit(1), "window").alias("h2")]
    grams = materialize(windows.select("window", "k").distinct().select(F.monotonically_increasing_id().alias("gram"), "window", "k", *both), "grams")
    pairs = materialize(windows.join(grams.select("gram", "window"), "window").select("gram", "item"), "pairs")
    drop(windows)
    return grams, pairs


def _few(df: DataFrame, limit: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= limit else df


def document_hits(docs: DataFrame, grams: DataFrame, limit: int = BROADCAST_WINDOWS) -> DataFrame:
    """Documents with n_words, hit (places of words inside any window) and grams (the windows that occur).

    There is a row for each different text of a doc_id in a partition of ``docs``, with its number of copies there.
    """
    sizes = [r["k"] for r in grams.select("k").distinct().orderBy("k").collect()]  # at most as many as a window has words
    cut = docs.select("doc_id", digest(F.col("text")).alias("digest"), F.spark_partition_id().alias("part"), words(F.col("text")).alias("words"))
    # a place for each word, and one behind the last for the document itself
    each = cut.select(*KEY, "words", F.size("words").alias("n"), F.posexplode(F.array_append("words", F.lit(""))).alias("at", "word__")).drop("word__")
    each = each.withColumn("k", F.lit(sizes[0] if sizes else 1)) if len(sizes) < 2 else each.withColumn("k", F.explode(F.when(F.col("at") == F.col("n"), F.array(F.lit(1))).otherwise(F.array(*map(F.lit, sizes)))))
    own = F.col("at") == F.col("n")
    each = each.where(own | (F.col("at") + F.col("k") <= F.col("n")))
    seen = F.slice("words", F.col("at") + 1, F.col("k"))
    if grams.count() <= limit:
        probe = each.withColumn("h__", F.xxhash64(seen))
        met = (F.col("h__") == F.col("h")) & ~own & (F.col("window") == seen)
        found = probe.join(F.broadcast(grams.select("gram", "h", "window")), met, "left")
    else:
        # documents' own rows take part under a hash of their own, so that no partition gets them all
        probe = each.select(*KEY, "n", "at", "k", F.when(own, F.xxhash64(*KEY)).otherwise(F.xxhash64(seen)).alias("h__"), F.when(own, None).otherwise(F.xxhash64(F.lit(1), seen)).alias("h2__"))
        found = probe.join(grams.select("gram", "h", "h2"), (F.col("h__") == F.col("h")) & F.coalesce(F.col("h2__") == F.col("h2"), F.lit(False)), "left")
    found = found.where(own | F.col("gram").isNotNull()).select(*KEY, F.when(own, F.col("n")).alias("n"), F.when(~own, F.struct("at", "k")).alias("span"), "gram")
    got = found.groupBy(*KEY).agg(F.count("n").alias("copies"), F.max("n").alias("n_words"), F.collect_set("span").alias("spans"), F.collect_set("gram").alias("grams"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["k"] - 1))))
    return got.select(*KEY, "copies", "n_words", covered.alias("hit"), "grams")


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, limit: int = BROADCAST_WINDOWS) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, items (the sorted names of items with occurring windows)."""
    grams, pairs = numbered_windows(benchmark_windows(benchmark, n))
    hits = document_hits(docs, grams, limit)
    each = hits.select(*KEY, "copies", "n_words", F.size("hit").alias("n_hit"), F.explode_outer("grams").alias("gram")).join(_few(pairs, limit), "gram", "left")
    got = each.groupBy(*KEY).agg(*[F.first(c).alias(c) for c in ("copies", "n_words", "n_hit")], F.sort_array(F.collect_set("item")).alias("items"))
    rows = got.select("doc_id", "n_words", "n_hit", "items", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy__"))
    return rows.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), "items")


def _with_hits(docs: DataFrame, benchmark: DataFrame, n: int, limit: int) -> tuple[DataFrame, str]:
    """``docs`` with columns named by their place, joined with hit (null for clean ones), and the text's name."""
    grams, _ = numbered_windows(benchmark_windows(benchmark, n))
    hits = document_hits(docs, grams, limit).where(F.size("hit") > 0).groupBy("doc_id", "digest").agg(F.first("hit").alias("hit"))
    plain, (i, t) = numbered(docs)[0], (str(docs.columns.index(c)) for c in ("doc_id", "text"))
    return plain.join(hits, F.col(i).eqNullSafe(F.col("doc_id")) & (digest(F.col(t)) == F.col("digest")), "left"), t


def without_documents(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, limit: int = BROADCAST_WINDOWS) -> DataFrame:
    """``docs`` less the documents that hold a window of the benchmark."""
    rows, _ = _with_hits(docs, benchmark, n, limit)
    return rows.where("hit is null").select(*map(str, range(len(docs.columns)))).toDF(*docs.columns)


def without_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, limit: int = BROADCAST_WINDOWS) -> DataFrame:
    """``docs`` with each hit word taken out of its text, together with what stands between it and the next word."""
    rows, t = _with_hits(docs, benchmark, n, limit)
    pieces = F.regexp_extract_all(F.col(t), F.lit(f"{ANY_CASE}+{BETWEEN}*"), F.lit(0))
    rows = rows.withColumn("pieces", F.when(F.col("hit").isNotNull(), pieces))
    left = F.array_except(F.sequence(F.lit(0), F.size("pieces") - 1), F.col("hit"))
    kept = F.concat(F.regexp_extract(F.col(t), f"^{BETWEEN}*", 0), F.array_join(F.transform(left, lambda at: F.element_at("pieces", at + 1)), ""))
    names = [str(i) for i in range(len(docs.columns))]
    return rows.select(*[F.when(F.col("pieces").isNull(), F.col(t)).otherwise(kept).alias(t) if c == t else F.col(c) for c in names]).toDF(*docs.columns)


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside windows of the benchmark, and the items that these windows are of."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    names = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), names.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontamination_sql(n: int = WINDOW) -> str:
    """The same in SQL: all windows of all documents joined with the benchmark's."""
    cut = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""with d as (select doc_id, row_number() over () as r, {cut} as w from documents), b as (select coalesce(item_id::varchar, '') as item, {cut} as w from benchmark),
places as (select item, w, least(len(w), {n}) as k, unnest(range(1, greatest(len(w) - {n - 1}, 1) + 1)) as i from b where len(w) > 0),
wins as (select distinct item, k, array_to_string(w[i:i + k - 1], ' ') as win from places), sizes as (select distinct k from wins), known as (select distinct k, win from wins),
seen as (select r, k, i, array_to_string(w[i:i + k - 1], ' ') as win from (select r, w, k, unnest(range(1, len(w) - k + 2)) as i from d, sizes where len(w) >= k)),
hits as (select r, k, i, win from seen join known using (k, win)),
covered as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + k)) as p from hits) group by r),
found as (select r, list_sort(list(distinct item)) as items from hits join wins using (k, win) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(len(items), 0)::bigint as n_items, sha256(coalesce(array_to_string(items, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
  from d left join covered using (r) left join found using (r)"""
