"""Mixing sources to target weights by hierarchical budgeting.

A tree of groups (here domain, language, source) has a weight for every node. The token budget flows from the root to the
leaves in proportion to the weights. A child whose documents, times ``max_epochs``, hold fewer tokens than its share takes
all that it has, and its shortage goes to its siblings in proportion to their weights; only what a whole family cannot
take is a shortage of the family, and so goes to the family's own siblings. Shares are whole tokens (rounded down).

Each leaf reads its documents in an order drawn anew in each epoch from md5(seed, epoch, doc_id): full epochs first, then
the prefix of the last one whose documents begin before the leaf's budget is used up. So a leaf's tokens reach its budget
and exceed it by less than one document.

Scale: the tree is made from sums per leaf, so it has a row per leaf. The order is cut into 256 buckets by the first two
hex digits of the draw; running sums are taken over bucket sums, and only the bucket in which a leaf's budget ends is
ordered by rows. A leaf with a third of all documents is thus spread over 256 keys, and no join has the leaf as its key.

Defined results: null group values are groups of their own (named by ``NONE``); a null or blank text counts no tokens and
is taken where its position is within the prefix; rows without doc_id draw on their text's digest; repeated rows are one row
with a number while the mix chooses, and count each; equal draws are ordered by a hash of the row; an empty table or a budget
of zero gives no rows; other columns stay as they are, whatever their names; a text of any length is counted whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillflow.llm.storage import materialize

NONE = "(none)"
SEED = 17
MAX_EPOCHS = 2
BUDGET_SHARE = (3, 5)
#: Weights of the tree's nodes by level; a node that isn't named weighs 1.
DOMAIN_WEIGHTS = {"web": 4, "books": 3, "code": 2, "forum": 1}
LANG_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 2}
SOURCE_WEIGHTS = {"src0": 1, "src1": 3, "src2": 2}
DOMAINS = ["web", "books", "code", "forum"]


def n_words(text: Column) -> Column:
    """Words of a text: maximal runs of characters other than blanks, counted without making an array of them."""
    one_each = F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]*[^ \t\n\x0B\f\r]+", "x")
    return F.length(F.translate(one_each, " \t\n\x0b\f\r", "")).cast("long")


def weight_of(column: Column, weights: dict[str, int]) -> Column:
    """The weight that a dict of a fixed few names gives each value."""
    return reduce(lambda rest, kv: F.when(column == kv[0], kv[1]).otherwise(rest), weights.items(), F.lit(1)).cast("long")


def draw(seed: int, epoch: Column, name: Column) -> Column:
    """The key that orders a document within an epoch."""
    return F.md5(F.concat(F.lit(f"{seed}-"), epoch.cast("string"), F.lit("-"), name))


def _name(doc_id: Column, text: Column) -> Column:
    """What a document draws on: its doc_id, else its text."""
    return F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Sequence[dict[str, int]], share: tuple[int, int], max_epochs: int) -> DataFrame:
    """(levels, budget) of each leaf of (levels, tokens), by filling the levels from the top.

    Among siblings in order of capacity per weight, a child is full if its capacity is at most its share of what the
    lesser ones left; the first that isn't fixes the rate for all that follow. That is one window over each family and
    level; the whole budget is ``share`` of all tokens.
    """
    above = None
    for i, level in enumerate(levels):
        here, up = list(levels[: i + 1]), list(levels[:i])
        nodes = leaves.groupBy(*here).agg(F.sum("tokens").alias("tokens")).withColumn("c", F.col("tokens") * max_epochs).withColumn("w", weight_of(F.col(level), weights[i]))
        family = W.partitionBy(*up) if up else W.partitionBy(F.lit(0))
        if above is None:
            nodes = nodes.withColumn("t", F.sum("tokens").over(family)).withColumn("b", F.expr(f"least(t * {share[0]} div {share[1]}, t * {max_epochs})"))
        else:
            nodes = nodes.join(above, up)
        order = family.orderBy(F.col("c") / F.col("w"), level)
        nodes = nodes.withColumn("rest", F.col("b") - F.coalesce(F.sum("c").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        nodes = nodes.withColumn("ws", F.sum("w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
        nodes = nodes.withColumn("open", F.when(F.col("c") * F.col("ws") > F.col("rest") * F.col("w"), F.struct("ws", "rest")))
        nodes = nodes.withColumn("rate", F.max("open").over(family))
        above = nodes.select(*here, F.expr("if(open is null, c, rate.rest * w div rate.ws)").alias("b"))
    return above.withColumnRenamed("b", "budget")


def mix(keyed: DataFrame, levels: Sequence[str], weights: Sequence[dict[str, int]], share: tuple[int, int] = BUDGET_SHARE, seed: int = SEED, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The chosen rows of ``keyed`` (doc_id, name, row, levels, n, times) with epoch, budget and taken, how many of the ``times`` equal rows an epoch takes."""
    keyed = materialize(keyed.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(NONE)) for c in levels}), "mixing-keys")
    leaves = materialize(keyed.groupBy(*levels).agg(F.sum(F.col("n") * F.col("times")).alias("tokens")), "mixing-leaves")
    tree = budgets(leaves, levels, weights, share, max_epochs).where("budget > 0")
    rows = keyed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1)))).withColumn("draw", draw(seed, F.col("epoch"), F.col("name")))
    rows = rows.withColumns({"bucket": F.substring("draw", 1, 2), "all_n": F.col("n") * F.col("times")})
    keys = [*levels, "epoch", "bucket"]
    so_far = F.sum("bucket_n").over(W.partitionBy(*levels).orderBy("epoch", "bucket").rowsBetween(W.unboundedPreceding, -1))
    starts = rows.groupBy(*keys).agg(F.sum("all_n").alias("bucket_n")).join(tree, list(levels)).withColumn("start", F.coalesce(so_far, F.lit(0)))
    got = rows.join(materialize(starts.where("start < budget"), "mixing-starts"), keys)
    order = W.partitionBy(*keys).orderBy("draw", "row").rowsBetween(W.unboundedPreceding, -1)
    cut = got.where("start + bucket_n >= budget").withColumn("start", F.col("start") + F.coalesce(F.sum("all_n").over(order), F.lit(0)))
    # of equal rows those are taken that begin before the budget is used up
    within = F.expr("if(n = 0, times, least(times, (budget - start + n - 1) div n))")
    columns = ["doc_id", "name", "row", *levels, "epoch", "n", "budget"]
    whole = got.where("start + bucket_n < budget").select(*columns, F.col("times").alias("taken"))
    return whole.unionByName(cut.where("start < budget").select(*columns, within.alias("taken")))


#: Copies of a row that one array stands for.
COPIES = 10_000


def _repeated(rows: DataFrame, times: str) -> DataFrame:
    """Each row as often as ``times`` says."""
    parts = rows.withColumn("part__", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({times} - 1) div {COPIES}"))))
    return parts.withColumn("copy__", F.explode(F.sequence(F.lit(1).cast("long"), F.expr(f"least({COPIES}, {times} - part__ * {COPIES})")))).drop("part__", "copy__", times)


def _domain(source: Column) -> Column:
    """Sources are dealt to the domains by the number that ends their name; those without one belong to the first."""
    number = F.coalesce(F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("long"), F.lit(0))
    return F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), (number % len(DOMAINS) + 1).cast("int"))


def _row_hash(docs: DataFrame) -> Column:
    """A hash of the whole row: with doc_id it names a text and all that goes with it."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def _picks(docs: DataFrame) -> DataFrame:
    name = _name(F.col("doc_id"), F.col("text")).alias("name")
    narrow = docs.select("doc_id", name, _row_hash(docs).alias("row"), _domain(F.col("source")).alias("domain"), "lang", "source", n_words(F.col("text")).alias("n"))
    narrow = narrow.groupBy(*narrow.columns).agg(F.count("*").alias("times"))
    return mix(narrow, ["domain", "lang", "source"], [DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS])


def chosen(docs: DataFrame) -> DataFrame:
    """The production mix of documents: (doc_id, row, domain, lang, source, epoch, n, budget), a row for each time that one is taken."""
    return _repeated(_picks(docs).drop("name"), "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the production mix takes, once for each epoch that takes them.

    Equal rows are one row here, taken as often as all of them together. They are combined before the shuffle, which the join
    then shares: texts move once.
    """
    picks = _picks(docs).groupBy("name", "row").agg(F.sum("taken").alias("times"))
    whole = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("whole")
    name = _name(F.col("doc_id"), F.col("text")).alias("name")
    rows = docs.select(name, _row_hash(docs).alias("row"), whole).groupBy("name", "row").agg(F.first("whole").alias("whole"))
    taken = _repeated(rows.join(picks, ["name", "row"]).select("whole", "times"), "times")
    return taken.select(*[F.col(f"whole.`{c}`") for c in docs.columns])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return chosen(docs).select("doc_id", "domain", "lang", "source", F.col("epoch").cast("long").alias("epoch"), F.col("n").alias("n_tokens"), F.col("budget").alias("leaf_budget"))


def _case(column: str, weights: dict[str, int]) -> str:
    return f"(case {column} " + " ".join(f"when '{k}' then {v}" for k, v in weights.items()) + " else 1 end)::bigint"


def _level(i: int, levels: list[str], weights: dict[str, int], above: str) -> str:
    here, up = ", ".join(levels[: i + 1]), ", ".join(levels[:i]) or "1"
    budget = f"least(sum(tokens) over () * {BUDGET_SHARE[0]} // {BUDGET_SHARE[1]}, sum(tokens) over () * {MAX_EPOCHS})" if not i else "b"
    joined = "" if not i else f" join {above} using ({', '.join(levels[:i])})"
    return f"""
n{i} as (select {here}, sum(n) as tokens, sum(n) * {MAX_EPOCHS} as c, {_case(levels[i], weights)} as w from docs group by {here}),
p{i} as (select *, {budget} as given from n{i}{joined}),
q{i} as (select *, given - coalesce(sum(c) over (partition by {up} order by c::double / w::double, {levels[i]} rows between unbounded preceding and 1 preceding), 0) as rest,
  sum(w) over (partition by {up} order by c::double / w::double, {levels[i]} rows between current row and unbounded following) as ws from p{i}),
r{i} as (select *, max(case when c * ws > rest * w then ws end) over (partition by {up}) as rate_ws,
  max_by(rest, ws) filter (where c * ws > rest * w) over (partition by {up}) as rate_rest from q{i}),
b{i} as (select {here}, (case when c * ws > rest * w then rate_rest * w // rate_ws else c end)::bigint as b from r{i})"""


def mixing_sql() -> str:
    levels, weights = ["domain", "lang", "source"], [DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS]
    tree = ",".join(_level(i, levels, weights[i], f"b{i - 1}") for i in range(3))
    names = "[" + ", ".join(f"'{d}'" for d in DOMAINS) + "]"
    return f"""
with docs as (select doc_id, coalesce(doc_id::varchar, md5(coalesce(text, ''))) as name, coalesce(lang, '{NONE}') as lang, coalesce(source, '{NONE}') as source,
  {names}[(coalesce(try_cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) as bigint), 0) % {len(DOMAINS)} + 1)::int] as domain,
  len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+'))::bigint as n from documents),{tree},
reads as (select docs.*, e.epoch, md5('{SEED}-' || e.epoch || '-' || name) as draw from docs, (select unnest(range(0, {MAX_EPOCHS})) as epoch) e),
ordered as (select *, coalesce(sum(n) over (partition by domain, lang, source order by epoch, draw rows between unbounded preceding and 1 preceding), 0) as start from reads)
select doc_id, domain, lang, source, epoch::bigint as epoch, n as n_tokens, b as leaf_budget from ordered join b2 using (domain, lang, source) where b > 0 and start < b
"""
