"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations alone.

The corpus is a tree: domain, language, source. A budget of tokens comes in at the root and goes
down by weight. A child cannot take more than its subtree holds (its tokens times the allowed
epochs); what it leaves is shared among its siblings by weight, until they are full as well, and
only then reaches the siblings of their parent: a node is never given more than its subtree holds,
so a shortage is settled at the lowest level that can settle it. Water-filling of one family is a
window over its members by fullness (capacity / weight): a member is full exactly when its own
level lies below the level of what is left for it and the members after it.

A leaf's share is spent in seeded epochs: whole passes first, then the longest prefix, in the order
of a seeded hash of (epoch, doc_id), whose tokens fit. Prefix sums run over hash blocks, whose sums
are formed before any shuffle; only the one block in which a leaf's prefix ends is sorted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable

LEVELS = ("domain", "lang", "source")
# Parameters: target weights as whole numbers; 1 where a name is not listed.
WEIGHTS = {"domain": {"domain0": 40, "domain1": 30, "domain2": 20, "domain3": 10}, "lang": {"en": 50, "de": 20, "fr": 20, "es": 10}, "source": {}}
#: Share of all tokens that the mix has, and how often a document may be in it.
SHARE, EPOCHS, SEED = 0.8, 2, 17
#: Rows of a leaf in one hash block, about (a power of 16 divides the leaf).
BLOCK_ROWS = 4096
#: Leaves up to which their table is broadcast; beyond it, they join by a salted key.
LEAVES = 50_000
SALTS = 64


def domain_of(source: Column) -> Column:
    """The domain of a source where the caller names no other rule: by the number at the end of its name."""
    number = F.regexp_extract(source, r"(\d{1,9})$", 1)
    return F.when(F.coalesce(number, F.lit("")) == "", F.lit("unknown")).otherwise(F.concat(F.lit("domain"), (number.cast("long") % 4).cast("string")))


def token_count(text: Column) -> Column:
    """Runs of bytes outside ASCII white space, at least 1, so that every document has a price."""
    return F.greatest(F.lit(1).cast("long"), F.regexp_count(text, F.lit(r"[^ \t\n\r\x0B\f]+")).cast("long"))


Domain = Callable[[Column], Column]


def leaf_columns(docs: DataFrame, domain: Domain = domain_of) -> DataFrame:
    """doc_id with the levels of the tree and the tokens; null names are 'unknown', null texts empty."""
    source = F.coalesce(F.col("source"), F.lit("unknown"))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        domain(F.col("source")).alias("domain"),
        F.coalesce(F.col("lang"), F.lit("unknown")).alias("lang"),
        source.alias("source"),
        token_count(F.coalesce(F.col("text"), F.lit(""))).alias("tokens"),
    )


def key_of(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def weight_of(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1)
    for name, weight in sorted(weights.get(level, {}).items()):
        out = F.when(F.col(level) == name, F.lit(weight)).otherwise(out)
    return out.cast("long")


def family_shares(nodes: DataFrame, parents: list[str], level: str, weights: dict[str, dict[str, int]]) -> DataFrame:
    """nodes (parents, level, cap, given to the parent as ``budget``) with ``share``, each node's part of it."""
    nodes = nodes.withColumn("weight", weight_of(level, weights)).withColumn("fullness", F.col("cap") / F.col("weight"))
    family = W.partitionBy(*(parents or [F.lit(0)]))
    order = family.orderBy("fullness", level)
    nodes = nodes.withColumn("cap_before", F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("cap"))
    nodes = nodes.withColumn("weight_on", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    nodes = nodes.withColumn("full", F.col("cap") * F.col("weight_on") <= F.col("weight") * (F.col("budget") - F.col("cap_before")))
    nodes = nodes.withColumn("cap_full", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(family)).withColumn("weight_open", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(family))
    share = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * (F.col("budget") - F.col("cap_full")) / F.col("weight_open"))
    return nodes.select(*parents, level, "cap", share.alias("share"))


def leaf_budgets(slim: DataFrame, weights: dict[str, dict[str, int]], share: float, epochs: int) -> DataFrame:
    """(levels, rows, tokens, quota) of every leaf."""
    leaves = slim.groupBy(*LEVELS).agg(F.count("*").alias("rows"), F.sum("tokens").alias("tokens"))
    leaves = leaves.withColumn("cap", F.col("tokens") * epochs)
    nodes = leaves.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    total = F.sum("tokens").over(W.partitionBy(F.lit(0)))  # of the tree's few domains
    nodes = nodes.withColumn("budget", F.least(total * F.lit(share), (total * epochs).cast("double")))
    domains = family_shares(nodes, [], "domain", weights)
    nodes = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(domains.select("domain", F.col("share").alias("budget")), "domain")
    langs = family_shares(nodes, ["domain"], "lang", weights)
    nodes = leaves.join(langs.select("domain", "lang", F.col("share").alias("budget")), ["domain", "lang"])
    sources = family_shares(nodes.select(*LEVELS, "cap", "budget"), ["domain", "lang"], "source", weights)
    return leaves.join(sources.select(*LEVELS, F.floor("share").cast("long").alias("quota")), list(LEVELS)).drop("cap")


def with_leaves(rows: DataFrame, leaves: DataFrame, n_leaves: int) -> DataFrame:
    """rows with their leaf's columns: a broadcast of a counted table, or a join whose hot leaves are salted."""
    if n_leaves <= LEAVES:
        return rows.join(F.broadcast(leaves), list(LEVELS))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    salted = leaves.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", salt).join(salted, [*LEVELS, "salt"]).drop("salt")


def plan(slim: DataFrame, weights: dict[str, dict[str, int]] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> tuple[DataFrame, int]:
    """(levels, whole, cut): whole passes of each leaf, and the last key of the pass after them; how many leaves.

    slim: doc_id, levels, tokens."""
    quota = F.col("quota")
    leaves = durable(
        leaf_budgets(slim, weights, share, epochs)
        .withColumn("whole", F.least(F.lit(epochs).cast("long"), F.floor(quota / F.col("tokens")).cast("long")))
        .withColumn("rest", F.when(F.col("whole") < epochs, quota - F.col("whole") * F.col("tokens")).otherwise(F.lit(0).cast("long")))
        .withColumn("digits", F.greatest(F.lit(0), F.ceil(F.log(F.greatest(F.col("rows") / BLOCK_ROWS, F.lit(1.0))) / F.log(F.lit(16.0)))).cast("int"))
        .select(*LEVELS, "whole", "rest", "digits")
    )
    n = leaves.count()
    keyed = with_leaves(slim, leaves, n).filter("rest > 0").withColumn("key", key_of(seed, F.col("whole"), F.col("doc_id")))
    keyed = keyed.withColumn("block", F.expr("substring(key, 1, digits)"))
    sums = keyed.groupBy(*LEVELS, "block").agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"))
    upto = W.partitionBy(*LEVELS).orderBy("block").rowsBetween(W.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("tokens").over(upto))
    ends = sums.filter("upto > rest and upto - tokens <= rest").select(*LEVELS, F.col("block").alias("last"), (F.col("upto") - F.col("tokens")).alias("before"))
    ends = durable(ends)
    inside = with_leaves(keyed, ends, n).filter("block = last")
    upto = W.partitionBy(*LEVELS).orderBy("key").rangeBetween(W.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.col("before") + F.sum("tokens").over(upto)).filter("upto <= rest")
    keys = inside.groupBy(*LEVELS).agg(F.max("key").alias("key"))
    cuts = ends.join(keys, list(LEVELS), "left").select(*LEVELS, F.coalesce("key", "last").alias("cut"))
    return durable(leaves.join(cuts, list(LEVELS), "left").select(*LEVELS, "whole", F.coalesce("cut", F.lit("")).alias("cut"))), n


def select(rows: DataFrame, cuts: DataFrame, n_leaves: int, seed: int = SEED) -> DataFrame:
    """rows (doc_id, levels, more), once for each epoch that has them, with ``epoch``."""
    rows = with_leaves(rows, cuts, n_leaves)
    times = F.col("whole") + (key_of(seed, F.col("whole"), F.col("doc_id")) <= F.col("cut")).cast("long")
    rows = rows.withColumn("times", times).filter("times > 0").drop("whole", "cut")
    return rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("times").cast("int") - 1))).drop("times")


def mix(docs: DataFrame, weights: dict[str, dict[str, int]] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED, domain: Domain = domain_of) -> DataFrame:
    """(doc_id, domain, lang, source, tokens, epoch) of every document and epoch in the mix.

    An empty table gives an empty mix. Rows of the same leaf and doc_id are in or out together. Null
    langs and sources are the name 'unknown'; a null text costs one token. Extra columns are ignored, texts of any
    length counted whole. domain: a source's domain, as an expression."""
    slim = durable(leaf_columns(docs, domain))
    cuts, n = plan(slim, weights, share, epochs, seed)
    return select(slim, cuts, n, seed)


def mixed_documents(docs: DataFrame, weights: dict[str, dict[str, int]] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED, domain: Domain = domain_of) -> DataFrame:
    """The documents themselves, with all their columns, once for each epoch that has them; odd rows as in ``mix``."""
    columns = docs.columns
    slim = durable(leaf_columns(docs, domain))
    cuts, n = plan(slim, weights, share, epochs, seed)
    whole = docs.select(F.struct(*columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), domain(F.col("source")).alias("domain"), F.coalesce(F.col("lang"), F.lit("unknown")).alias("lang"), F.coalesce(F.col("source"), F.lit("unknown")).alias("source"))
    return select(whole, cuts, n, seed).select("row.*")


def oracle(weights: dict[str, dict[str, int]] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> str:
    """The same mix in DuckDB, with plain prefix sums."""

    def weight(level: str) -> str:
        cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.get(level, {}).items())
        return f"(CASE {level} {cases} ELSE 1 END)" if cases else "1"

    def family(name: str, nodes: str, parents: list[str], level: str) -> str:
        part = f"PARTITION BY {', '.join(parents)}" if parents else ""
        keep = ", ".join([*parents, level])
        return f"""{name}_a AS (SELECT {keep}, cap, budget, {weight(level)} AS weight FROM ({nodes})),
{name}_b AS (SELECT *, sum(cap) OVER ({part} ORDER BY cap / weight, {level} ROWS UNBOUNDED PRECEDING) - cap AS cap_before,
  sum(weight) OVER ({part} ORDER BY cap / weight, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_on FROM {name}_a),
{name}_c AS (SELECT *, cap * weight_on <= weight * (budget - cap_before) AS is_full FROM {name}_b),
{name}_d AS (SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({part}) AS cap_full, sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({part}) AS weight_open FROM {name}_c),
{name} AS (SELECT {keep}, CASE WHEN is_full THEN cap::DOUBLE ELSE weight * (budget - cap_full) / weight_open END AS share FROM {name}_d)"""

    return f"""
WITH slim AS (SELECT doc_id, CASE WHEN regexp_extract(coalesce(source, ''), '(\\d{{1,9}})$', 1) = '' THEN 'unknown' ELSE 'domain' || (regexp_extract(source, '(\\d{{1,9}})$', 1)::BIGINT % 4) END AS domain,
  coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\x0B\\f]+')))::BIGINT AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, sum(tokens)::BIGINT * {epochs} AS cap FROM slim GROUP BY ALL),
given AS (SELECT least(sum(tokens)::BIGINT * {share}::DOUBLE, (sum(tokens)::BIGINT * {epochs})::DOUBLE) AS budget FROM leaves),
{family("f1", "SELECT domain, sum(cap)::BIGINT AS cap, any_value(budget) AS budget FROM leaves, given GROUP BY domain", [], "domain")},
{family("f2", "SELECT domain, lang, sum(cap)::BIGINT AS cap, any_value(share) AS budget FROM leaves JOIN f1 USING (domain) GROUP BY domain, lang", ["domain"], "lang")},
{family("f3", "SELECT domain, lang, source, cap, share AS budget FROM leaves JOIN f2 USING (domain, lang)", ["domain", "lang"], "source")},
quotas AS (SELECT domain, lang, source, tokens, floor(share)::BIGINT AS quota FROM leaves JOIN f3 USING (domain, lang, source)),
passes AS (SELECT *, least({epochs}, floor(quota / tokens)::BIGINT) AS whole FROM quotas),
keyed AS (SELECT s.*, whole, CASE WHEN whole < {epochs} THEN quota - whole * p.tokens ELSE 0 END AS rest, md5('{seed}|' || whole || '|' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM slim s JOIN passes p USING (domain, lang, source)),
placed AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE UNBOUNDED PRECEDING) AS upto FROM keyed),
timed AS (SELECT *, whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS times FROM placed)
SELECT doc_id, domain, lang, source, tokens, unnest(range(times))::INTEGER AS epoch FROM timed"""
