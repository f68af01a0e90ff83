"""Problem 7: mixing sources to target shares of the total size.

Efraimidis-Spirakis sampling: a document's key is an exponential draw divided by its quality
weight, so ascending keys are a weighted random order without replacement.  Per source the
token budget is spent on complete epochs first -- every document once an epoch, at most
max_repeats -- and the rest on the documents with the smallest keys, by prefix sums.

Budgets are filled like vessels: a source that can't give its share, because it is empty or
its cap is reached, gives all it has, and the others take what is missing in proportion to
their shares until the total is met or all are at their caps.  Each source then ends less
than a document below its budget.

A source may hold any part of the corpus, so its documents are never sorted in one task:
keys are cut into KEY_BUCKETS monotone buckets, bucket sums are accumulated (at most
KEY_BUCKETS rows a source), and only the one bucket in which a budget ends is sorted.  Texts
are read once; what follows reads a written table of ids, sizes and keys.

Sources are compared in canonical spelling.  Documents with null or empty text have no
size and aren't used, nor are rows without a doc_id; of rows that share one the least counts;
sources without a target get share 0; targets without documents and targets that caps make
unreachable are reported with the share they got.  Draws depend on doc_id and seed only, so
a run can be repeated.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.store import written
from .vocabulary import VOCABULARY, encoding, shipped

KEY_BUCKETS = 4096
#: Weights whose key distributions are averaged to lay out the buckets; no weight between them puts more than a
#: few times its even part of a source into one bucket.
LAYOUT = (1.0, 0.5, 0.2, 0.1)
_WORDS = re.compile(r"[\u3040-\u9fff\uac00-\ud7af]|[^\s\u3040-\u9fff\uac00-\ud7af]+")


def canonical_source(source: Column) -> Column:
    """Spelling of a source without case, padding and other separators; null stays null."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(source)), r"[\s\-]+", "_"), F.lit(""))


def quality_weight(text: str) -> float:
    """Weight in [0.1, 1]: the share of distinct words, which repetitive texts lack, damped for very short texts; a character of a script without blanks is a word."""
    words = text.lower().split() if text.isascii() else _WORDS.findall(text.lower())
    return max(0.1, len(set(words)) / len(words) * min(1.0, len(words) / 20)) if words else 0.1


def sizes(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """(tokens, weight) of a text: its number of tokens in a public vocabulary and its quality weight; nulls for null."""
    name = shipped(SparkSession.active(), vocabulary)

    @F.pandas_udf("tokens bigint, weight double")
    def count(texts):
        import pandas as pd

        encode = encoding(name).encode_ordinary
        tokens = pd.Series([None if t is None else len(encode(t)) for t in texts], dtype="Int64")
        return pd.DataFrame({"tokens": tokens, "weight": [None if t is None else quality_weight(t) for t in texts]})

    return count(text)


def _sized(documents: DataFrame, seed: int, vocabulary: str) -> DataFrame:
    """(doc_id, source, tokens, key, bucket) of the documents that can be used."""
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))
    read = documents.where("text is not null and text <> '' and doc_id is not null").select("doc_id", canonical_source(F.col("source")).alias("source"), sizes(F.col("text"), vocabulary).alias("s"))
    one = read.where("s.tokens > 0").groupBy("doc_id").agg(F.min(F.struct("source", "s.tokens", "s.weight")).alias("r"))
    out = one.select("doc_id", "r.source", "r.tokens", (-F.log(uniform) / F.col("r.weight")).alias("key"))
    place = 1 - sum(F.exp(-F.col("key") * w) for w in LAYOUT) / len(LAYOUT)
    return out.withColumn("bucket", F.least(F.floor(place * KEY_BUCKETS), F.lit(KEY_BUCKETS - 1)).cast("int"))


def _budgets(joined: DataFrame, total: Column) -> DataFrame:
    """The sources with the tokens each may give; one row a source, so the windows are small.

    In the order of what a unit of share can give, a source is at its cap if the level of those that are left is above it.
    """
    cap = (F.col("available") * F.col("max_repeats")).cast("double")
    share = F.col("target_share")
    every, order = Window.partitionBy(F.lit(1)), Window.partitionBy(F.lit(1)).orderBy("reach", "source")
    t = joined.withColumn("total", total).withColumn("cap", F.when(share > 0, cap).otherwise(0.0)).withColumn("reach", F.when(share > 0, F.col("cap") / share).otherwise(0.0))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("target_share").over(order.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("level", F.when(left > 0, (F.col("total") - before) / left))
    t = t.withColumn("full", (share <= 0) | (F.col("reach") <= F.col("level")))
    common = F.max(F.when(~F.col("full"), F.struct(-F.col("reach"), F.col("level")))).over(every)["level"]
    return t.withColumn("budget", F.floor(F.when(F.col("full"), F.col("cap")).otherwise(share * common)).cast("bigint")).drop("cap", "reach", "level", "full", "total")


def _plan(sized: DataFrame, targets: DataFrame, total_tokens: int | None) -> tuple[DataFrame, DataFrame]:
    """Per source its budget, epochs and remainder; and per (source, bucket) its tokens and the tokens before it."""
    sums = sized.groupBy("source", "bucket").agg(F.sum("tokens").alias("bucket_tokens"), F.count(F.lit(1)).alias("bucket_docs"))
    goal = targets.select(canonical_source(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    own = sums.groupBy("source").agg(F.sum("bucket_tokens").alias("available"), F.sum("bucket_docs").alias("documents"))
    joined = own.join(goal, own.source.eqNullSafe(goal.source), "full_outer").select(
        F.coalesce(own.source, goal.source).alias("source"), F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("documents", F.lit(0)).alias("documents"),
        F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"),
    )
    all_of_them = F.sum(F.when(F.col("target_share") > 0, F.col("available")).otherwise(0)).over(Window.partitionBy(F.lit(1)))
    plan = _budgets(joined, F.lit(total_tokens).cast("bigint") if total_tokens is not None else all_of_them)
    plan = plan.withColumn("epochs", F.when(F.col("available") > 0, F.least(F.floor(F.col("budget") / F.col("available")), F.col("max_repeats"))).otherwise(0).cast("int"))
    plan = plan.withColumn("remainder", F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.col("available")).otherwise(0).cast("bigint"))
    before = F.sum("bucket_tokens").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    return plan, sums.withColumn("before", F.coalesce(before, F.lit(0)))


def _mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None, seed: int, vocabulary: str) -> tuple[DataFrame, DataFrame]:
    """The plan by source and the documents of the mixture."""
    sized = written(_sized(documents, seed, vocabulary))
    plan, buckets = _plan(sized, targets, total_tokens)
    spent = buckets.join(plan.select("source", "epochs", "remainder"), "source")
    state = F.when(F.col("before") + F.col("bucket_tokens") <= F.col("remainder"), "in").when(F.col("before") < F.col("remainder"), "edge").otherwise("out")
    spent = spent.select("source", "bucket", "epochs", "remainder", "before", state.alias("state")).where("epochs > 0 or state <> 'out'")
    placed = sized.join(spent, ["source", "bucket"])
    # the running sum is only asked for in the buckets at an edge
    running = F.sum("tokens").over(Window.partitionBy("source", "bucket").orderBy("key", "doc_id"))
    edge = placed.where("state = 'edge'").withColumn("extra", (F.col("before") + running <= F.col("remainder")).cast("int"))
    rest = placed.where("state <> 'edge'").withColumn("extra", (F.col("state") == "in").cast("int"))
    out = edge.unionByName(rest).select("doc_id", "source", "tokens", (F.col("epochs") + F.col("extra")).alias("repeats"))
    return plan, out.where("repeats > 0")


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens, repeats) of the documents of the mixture; total_tokens defaults to all tokens of sources with a target."""
    return _mixture(documents, targets, total_tokens, seed, vocabulary)[1]


def shares(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per source target and actual share of the mixture, tokens available and used, and the highest number of uses."""
    plan, chosen = _mixture(documents, targets, total_tokens, seed, vocabulary)
    used = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("used"), F.max("repeats").alias("most_uses"))
    out = plan.join(used, "source", "left").select(
        "source", "target_share", "max_repeats", "documents", "available", "budget", F.coalesce("used", F.lit(0)).alias("used"), F.coalesce("most_uses", F.lit(0)).alias("most_uses")
    )
    return out.withColumn("actual_share", F.round(F.col("used") / F.sum("used").over(Window.partitionBy(F.lit(1))), 6))
