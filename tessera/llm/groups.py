"""Problem 3: consolidating pairwise matches into groups.

Pairs and sets become edges between numbered vertices, and union-find in bounded
partitions, with hierarchical merging of spanning forests, finds the components
(see `tessera.operators.components`).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.components import EDGES_PER_TASK, components
from tessera.operators.skew import hot_keys, lookup
from tessera.plans.durable import durable
from tessera.sources.tables import table


def normal_id(c: F.Column) -> F.Column:
    """An id without case and without spaces and tabs at its ends; null where nothing is left."""
    return F.nullif(F.lower(F.trim(c, F.lit(" \t"))), F.lit(""))


def _refuse(_: str) -> None:
    raise ValueError


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_members(texts):  # noqa: ANN001, ANN201
    """The strings of a valid JSON array; null where the text is none."""

    def one(text: str | None) -> list[str] | None:
        try:
            got = json.loads(text, parse_constant=_refuse) if text else None
        except (ValueError, RecursionError):
            return None
        return list(dict.fromkeys(x for x in got if isinstance(x, str))) if isinstance(got, list) else None

    return texts.map(one)


def group_ids(ids: DataFrame, pairs: DataFrame, sets: DataFrame | None = None, bound: int = EDGES_PER_TASK) -> DataFrame:
    """(id, group_id) of every id in a group of two or more; group_id is the least id of the group.

    ids: column `id`. pairs: columns `a`, `b`. sets: column `members`, an array
    whose members are all linked. Ids are compared by `normal_id`; two spellings
    of one id in `ids` are one vertex and both come out with its group. Ends that
    `ids` lacks, nulls and blanks link nothing. Other columns are ignored.
    """
    spark = ids.sparkSession
    known = ids.select("id").where("id is not null").distinct().select("id", normal_id(F.col("id")).alias("norm")).where("norm is not null")
    vertex = durable(known.groupBy("norm").agg(F.min("id").alias("least"), F.count("*").alias("spellings")).withColumn("code", F.monotonically_increasing_id()))
    code = vertex.select("norm", "code")
    ends = pairs.select(normal_id(F.col("a")).alias("a"), normal_id(F.col("b")).alias("b")).where("a <> b")
    # the number of hot keys is bounded (see hot_keys), so their codes may be broadcast
    half = lookup(ends, "a", code.select(F.col("norm").alias("k"), F.col("code").alias("u")), "k", hot_keys(ends, "a"))
    edges = lookup(half.drop("a"), "b", code.select(F.col("norm").alias("k"), F.col("code").alias("v")), "k", hot_keys(ends, "b")).select("u", "v")
    if sets is not None:
        # a set is a vertex of its own, with a negative number, joined to its members: a star, never all pairs
        member = sets.select("members", (-1 - F.monotonically_increasing_id()).alias("u")).select("u", F.explode("members").alias("m"))
        member = member.select("u", normal_id(F.col("m")).alias("m")).where("m is not null")
        edges = edges.unionByName(lookup(member, "m", code.select(F.col("norm").alias("k"), F.col("code").alias("v")), "k", hot_keys(member, "m")).select("u", "v"))
    # the numbers of sets must not change between the levels, and the edges are read more than once
    label = components(durable(edges), bound)
    all_codes = vertex.join(label.select(F.col("id").alias("code"), "root"), "code", "left").select("norm", "least", "spellings", F.coalesce("root", "code").alias("root"))
    named = durable(all_codes)
    groups = named.groupBy("root").agg(F.min("least").alias("group_id"), F.sum("spellings").alias("n")).where("n > 1").select(F.col("root").alias("k"), "group_id")
    out = lookup(named, "root", groups, "k").select("norm", "spellings", "least", "group_id")
    if not out.where("spellings > 1").limit(1).count():
        return out.select(F.col("least").alias("id"), "group_id")
    return known.join(out.select("norm", "group_id"), "norm").select("id", "group_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, group_id) of every chunk linked to another by connections or concepts."""
    pairs = table(spark, sf_dir, "connections", "source_chunk", "target_chunk", "weight").where("weight >= 0.6 and not isnan(weight)")
    sets = table(spark, sf_dir, "concepts", "member_chunks").where("member_chunks is not null").select(json_members("member_chunks").alias("members")).where("members is not null")
    ids = table(spark, sf_dir, "chunks", "chunk_id").withColumnRenamed("chunk_id", "id")
    return group_ids(ids, pairs.select(F.col("source_chunk").alias("a"), F.col("target_chunk").alias("b")), sets).withColumnRenamed("id", "chunk_id")
