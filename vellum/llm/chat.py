"""Cumulative-snapshot collapse of logged conversations, then rendering.

Each turn gets a hash of its place, role and text; the hash of a prefix is their
running exclusive-or, kept twice with different seeds, so 128 bits.  A conversation
whose whole hash is that of a shorter part of another is a snapshot of it and goes;
of equal conversations the one with the least id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _turns(conversations: DataFrame) -> DataFrame:
    """Turns in order: place from 1, role and text without nulls; rows without conv_id are left out."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("place", F.row_number().over(order))


def prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, h1, h2, next): the hash of each conversation's first ``place`` turns; next is null for the last."""
    each = _turns(conversations).select("conv_id", "place", F.xxhash64("place", "role", "text").alias("a"), F.xxhash64(F.lit(17), "text", "place", "role").alias("b"))
    running = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    hashed = each.select("conv_id", "place", F.bit_xor("a").over(running).alias("h1"), F.bit_xor("b").over(running).alias("h2"))
    return hashed.withColumn("next", F.lead("place").over(Window.partitionBy("conv_id").orderBy("place")))


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that are no snapshot of another."""
    hashed = prefixes(conversations)
    whole = hashed.where("next is null").groupBy(F.col("place").alias("n_turns"), "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    proper = hashed.where("next is not null").select(F.col("place").alias("n_turns"), "h1", "h2").distinct()
    return whole.join(proper, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns", "n_copies")


def rendered(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, text): each maximal conversation as one training text.

    Turns are ordered by turn, role and text; repeated turns stay.  A null role is
    rendered as ``unknown``, a null text as empty.  Empty input gives an empty result.
    """
    kept = maximal(conversations)
    turns = _turns(conversations).select("conv_id", "place", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>\n")).alias("said"))
    texts = turns.join(kept.select("conv_id"), "conv_id", "left_semi").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "said"))).alias("all"))
    return kept.join(texts, "conv_id").select("conv_id", "n_turns", "n_copies", F.array_join(F.col("all.said"), "").alias("text"))


#: The same result in SQL; prefixes are compared as text there.
ORACLE_SQL = """
with t as (
  select conv_id, row_number() over (partition by conv_id order by turn, role, text) as place,
         coalesce(role, 'unknown') as role, coalesce(text, '') as text
  from conversations where conv_id is not null
), s as (select conv_id, place, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) as said from t),
p as (
  select conv_id, place, string_agg(said, '' order by place) over (partition by conv_id order by place) as so_far,
         lead(place) over (partition by conv_id order by place) as nxt
  from s
), whole as (
  select place as n_turns, so_far, min(conv_id) as conv_id, count(*) as n_copies from p where nxt is null group by 1, 2
)
select conv_id, n_turns, n_copies, so_far as text from whole w
where not exists (select 1 from p where nxt is not null and p.place = w.n_turns and p.so_far = w.so_far)
"""
