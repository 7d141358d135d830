"""Contexts and answers: near-repeats out, a token budget, evidence, grounded generation."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.config import CONFIG, NO_CONTEXT
from tessera.functions.text import approx_tokens, safe_text, text_overlap


def without_near_repeats(df: DataFrame, most: float = 0.8) -> DataFrame:
    """Of each query's chunks those that overlap none kept before by more than `most`; in the order of score.

    df: q, id, text, score, .. The fold runs in the JVM over the chunks of one query, a retrieval's bounded result.
    """
    row = F.struct((-F.col("score")).alias("s"), F.col("id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    per = df.groupBy("q").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    empty = F.slice(F.col("rows"), 1, 0)
    kept = F.aggregate("rows", empty, lambda acc, x: F.when(F.exists(acc, lambda y: text_overlap(x["text"], y["text"]) > most), acc).otherwise(F.concat(acc, F.array(x))))
    ids = per.select("q", F.explode(F.transform(kept, lambda x: x["id"])).alias("id"))
    return df.join(ids, ["q", "id"], "left_semi")


def concept_block(concepts: DataFrame) -> DataFrame:
    """(q, block, labels): the heading of concepts that goes before the chunks. concepts: q, label, summary, rank."""
    c = concepts.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "label", "summary"))).alias("c"))
    lines = F.transform("c", lambda x: F.concat(F.lit("• "), safe_text(x["label"]), F.lit(": "), safe_text(x["summary"])))
    return c.select("q", F.array_join(F.concat(F.array(F.lit("=== Relevant Concepts ==="), F.lit("")), lines, F.array(F.lit(""))), "\n").alias("block"), F.transform("c", lambda x: x["label"]).alias("labels"))


def budgeted(df: DataFrame, budget: int = CONFIG.max_context_tokens) -> DataFrame:
    """Chunks of each query as long as their entries fit the budget; the first that doesn't ends it. df: q, id, source, text, score[, spent]."""
    entry = F.concat(F.lit("----\nSource: "), F.coalesce("source", F.lit("null")), F.lit("\n\n"), safe_text(F.col("text")), F.lit("\n\n----"))
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    spent = F.col("spent") if "spent" in df.columns else F.lit(0)
    out = df.withColumn("entry", entry).withColumn("used", F.sum(approx_tokens(F.col("entry"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.where(F.col("used") <= budget - spent).withColumn("place", F.row_number().over(w))


def contexts(chunks: DataFrame, concepts: DataFrame | None = None, budget: int = CONFIG.max_context_tokens) -> DataFrame:
    """(q, context, chunk_ids, labels, sources) of each query. chunks: q, id, source, text, score; concepts: q, label, summary, rank."""
    df = without_near_repeats(chunks)
    if concepts is not None:
        block = concept_block(concepts)
        df = df.join(block.select("q", approx_tokens(F.col("block")).alias("spent")), "q", "left").fillna(0, ["spent"])
    fit = budgeted(df, budget)
    per = fit.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("place", "entry", "id", "source"))).alias("c"))
    every = chunks.select("q").distinct().join(per, "q", "left")
    if concepts is not None:
        every = every.join(block, "q", "full")
    else:
        every = every.withColumns({"block": F.lit(None).cast("string"), "labels": F.array().cast("array<string>")})
    c = F.coalesce(F.col("c"), F.slice("c", 1, 0))
    sections = F.concat(F.when(F.coalesce("block", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array("block")), F.coalesce(F.transform(c, lambda x: x["entry"]), F.array().cast("array<string>")))
    kind = chunks.schema["id"].dataType.simpleString()
    return every.select(
        "q",
        F.array_join(sections, "\n").alias("context"),
        F.coalesce(F.transform(c, lambda x: x["id"]), F.array().cast(f"array<{kind}>")).alias("chunk_ids"),
        F.coalesce("labels", F.array().cast("array<string>")).alias("labels"),
        F.coalesce(F.array_distinct(F.transform(c, lambda x: x["source"])), F.array().cast("array<string>")).alias("sources"),
    )


def evidence(df: DataFrame, n: int = CONFIG.max_evidence) -> DataFrame:
    """The best rows of each query, whether or not they fit the context. df: q, id, score, .."""
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def answers(ctx: DataFrame, questions: DataFrame, provider: Callable[[str | None, str | None], str]) -> DataFrame:
    """(q, answer, sources): grounded answers; an empty context, a failure and an empty answer have a fixed sentence."""

    @F.pandas_udf(T.StringType())
    def run(question: pd.Series, context: pd.Series) -> pd.Series:
        def one(a: str | None, b: str | None) -> str:
            if not b:
                return NO_CONTEXT
            try:
                return provider(a, b) or NO_CONTEXT
            except Exception:
                return NO_CONTEXT

        return pd.Series([one(a, b) for a, b in zip(question, context, strict=True)])

    return questions.select("q", "question").join(ctx, "q", "left").select("q", run("question", "context").alias("answer"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))
