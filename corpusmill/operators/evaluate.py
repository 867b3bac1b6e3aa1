"""Evaluation: ground-truth sampling, questions, relevance judgments with a cache, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

# Phrases of which three or more mark a chunk as navigation.
BOILERPLATE = ["welcome back", "in this video", "let's go ahead", "see you in the next", "don't forget to subscribe", "click the link", "table of contents"]
SAMPLE, PER_COURSE, SEED = 250, 3, 42


def eligible(content: Column) -> Column:
    """50 words or more, 15 different ones, and not mostly navigation."""
    words, low = X.white_tokens(content), F.lower(content)
    nav = sum((F.contains(low, F.lit(p)).cast("int") for p in BOILERPLATE), F.lit(0))
    return (F.size(words) >= 50) & (F.size(F.array_distinct(words)) >= 15) & (nav < 3)


def sample(chunks: DataFrame, size: int = SAMPLE, per_course: int = PER_COURSE, seed: int = SEED) -> DataFrame:
    """(source, content, ...) to at most `size` chunks: per_course of each course with two eligible ones or more, in a hash's
    order, courses with more chunks first.

    Hot courses are bounded before any course is gathered: per partition only the first few of each leave.
    """
    rows = chunks.withColumn("course", X.course_dir(F.col("source")))
    sizes = rows.groupBy("course").agg(F.count("*").alias("_chunks"), F.count_if(eligible(F.col("content"))).alias("_eligible")).filter("_eligible >= 2")
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), "source", "content"))
    picked = rows.filter(eligible(F.col("content"))).withColumn("_h", order)
    picked = picked.withColumn("_n", F.row_number().over(W.partitionBy("course").orderBy("_h", "source", "content"))).filter(F.col("_n") <= per_course)
    out = picked.join(sizes, "course").orderBy(F.col("_chunks").desc(), "course", "_n").limit(size)
    return out.withColumn("domain", X.domain(F.col("course"))).drop("_chunks", "_eligible", "_h", "_n")


def question(answer: Column) -> Column:
    """A model's answer as a question: null for SKIP, without quotes around it, with a question mark."""
    t = X.stripped(answer)
    q = X.stripped(F.regexp_replace(F.regexp_replace(t, '^"+|"+$', ""), "^'+|'+$", ""))
    return F.when(~t.startswith("SKIP"), F.when(q.endswith("?"), q).otherwise(F.concat(q, F.lit("?"))))


def ground_truth(sampled: DataFrame, ask) -> DataFrame:
    """Sampled chunks with the question that `ask`, a column function over content, finds; SKIPs go."""
    return sampled.withColumn("query", question(ask(F.col("content")))).filter(F.col("query").isNotNull())


def cache_key(query: Column, content: Column) -> Column:
    return F.substring(F.sha2(F.concat(query, F.lit("|||"), content), 256), 1, 16)


def verdict(answer: Column) -> Column:
    """struct(relevant, reasoning) of a judge's answer: JSON, else JSON inside it, else its words; null if none says."""
    t = X.stripped(answer)
    read = lambda c: F.from_json(c, "relevant boolean, reasoning string")
    inner = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    good = lambda v: F.when(v["relevant"].isNotNull() & v["reasoning"].isNotNull(), v)
    low = F.lower(t)
    says = lambda *parts: F.contains(low, F.lit(parts[0])) | F.contains(low, F.lit(parts[1]))
    words = F.when(says("not relevant", '"relevant": false'), F.struct(F.lit(False).alias("relevant"), t.alias("reasoning"))).when(says("relevant", '"relevant": true'), F.struct(F.lit(True).alias("relevant"), t.alias("reasoning")))
    return F.coalesce(good(read(t)), good(read(inner)), words)


def judge(pairs: DataFrame, cache: DataFrame, ask, model: str = "injected") -> tuple[DataFrame, DataFrame]:
    """(query, content, ...) with relevant and reasoning, and the cache (key, relevant, reasoning, model) with what was asked.

    Each different pair is asked once, by `ask(query, content)`, a column function; cached ones are not.
    """
    rows = pairs.withColumn("key", cache_key(F.col("query"), F.col("content")))
    missing = rows.select("key", "query", "content").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    asked = missing.withColumn("v", verdict(ask(F.col("query"), F.col("content"))))
    asked = asked.filter(F.col("v").isNotNull()).select("key", "v.relevant", "v.reasoning", F.lit(model).alias("model"))  # unreadable answers stay unjudged
    known = cache.unionByName(asked)
    return rows.join(known.select("key", "relevant", "reasoning"), "key", "left"), known


def summary(aggregate: DataFrame) -> DataFrame:
    """(line): the report of `metrics.eval_aggregate`, the whole first and then by domain."""
    names = {"num_queries": "Queries", "mrr": "MRR", "ndcg_5": "NDCG@5", "ndcg_10": "NDCG@10", "recall_5": "Recall@5", "precision_5": "Precision@5", "hit_rate_5": "Hit Rate@5", "hit_rate_10": "Hit Rate@10", "map": "MAP"}
    shown = [F.concat(F.lit(f"{n}="), F.format_string("%d" if m == "num_queries" else "%.4f", F.col(m))) for m, n in names.items()]
    return aggregate.orderBy(F.col("domain").asc_nulls_first()).select(F.concat_ws("  ", F.coalesce("domain", F.lit("all")), *shown).alias("line"))
