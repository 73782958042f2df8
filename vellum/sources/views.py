"""The tables as the operators see them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

import vellum


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    vellum.ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, idx, src, mt): each user turn with the assistant turn that follows it at once."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lead("role").over(order).alias("next_role"), F.lead("text").over(order).alias("mt"))
    return turns.where("role = 'user' and next_role = 'assistant'").select("conv_id", F.col("turn").alias("idx"), F.coalesce("text", F.lit("")).alias("src"), F.coalesce("mt", F.lit("")).alias("mt"))


SQL_PAIRS = """(
  select conv_id, turn as idx, coalesce(text, '') as src, coalesce(mt, '') as mt from (
    select conv_id, turn, role, text, lead(role) over (partition by conv_id order by turn) as next_role, lead(text) over (partition by conv_id order by turn) as mt
    from conversations) where role = 'user' and next_role = 'assistant')"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, block_idx, text): the lines of every document, from 0."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("block_idx", "text"))


SQL_BLOCKS = "(select doc_id, generate_subscripts(l, 1) - 1 as block_idx, unnest(l) as text from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents))"


#: Glossary terms are all benchmark words of this length or more.
TERM_LENGTH = 5


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(en, vi, ordinal, locked): a glossary out of benchmark words, frequent ones first; vi is the word reversed."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("en"))
    n = words.where(F.length("en") >= TERM_LENGTH).groupBy("en").count()
    # numbers within words of one count that begin alike, after those of the groups before: only the groups are put in one order
    n = n.withColumn("start", F.left("en", F.lit(2)))
    groups = n.groupBy("count", "start").agg(F.count("*").alias("size"))
    groups = groups.withColumn("before", F.sum("size").over(Window.orderBy(F.desc("count"), "start")) - F.col("size"))
    place = F.row_number().over(Window.partitionBy("count", "start").orderBy("en"))
    n = n.withColumn("place", place).join(groups, ["count", "start"])
    rank = (F.col("before") + F.col("place")).cast("long")
    return n.select("en", F.reverse("en").alias("vi"), rank.alias("ordinal"), (rank % 10 == 0).alias("locked"))


SQL_TERMS = f"""(
  select en, reverse(en) as vi, row_number() over (order by n desc, en) as ordinal, row_number() over (order by n desc, en) % 10 = 0 as locked
  from (select en, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as en from benchmark) where length(en) >= {TERM_LENGTH} group by 1))"""
