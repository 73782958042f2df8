"""Places where a caller plugs in: document codecs, critics, judges and scheduling strategies."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T


@dataclass(frozen=True)
class Codec:
    """How the rows of one format are read and written: columns for source and translation, and what may be applied."""

    source: Callable[[], Column]
    translation: Callable[[], Column]
    accepts: Callable[[Column], Column] = lambda mt: T.strip(mt) != ""

    def pairs(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({"src": self.source(), "mt": self.translation()})

    def apply(self, rows: DataFrame, fixes: DataFrame, key: list[str]) -> DataFrame:
        """``rows`` whose translation is replaced by an accepted ``fix``."""
        j = self.pairs(rows).join(fixes.select(*key, "fix"), key, "left")
        return j.withColumn("mt", F.when(F.col("fix").isNotNull() & self.accepts(F.col("fix")), F.col("fix")).otherwise(F.col("mt"))).drop("fix")


CODECS = {
    "pdf": Codec(lambda: F.coalesce("text", F.lit("")), lambda: F.coalesce("translated_text", F.lit("")), lambda mt: (T.strip(mt) != "") & T.has_vietnamese(mt)),
    "docx": Codec(lambda: F.regexp_replace(F.coalesce("text", F.lit("")), "</?[biu]>", ""), lambda: F.regexp_replace(F.coalesce("translated_text", F.lit("")), "</?[biu]>", "")),
    "latex": Codec(lambda: F.coalesce("source", F.lit("")), lambda: F.coalesce("translated_text", F.lit(""))),
}

#: Each strategy is the order in which free accounts are taken.
STRATEGIES: dict[str, Callable[[], list[Column]]] = {
    "adaptive": lambda: [F.col("score").desc(), F.col("user_id").asc()],
    "lru": lambda: [F.col("last_used").asc_nulls_first(), F.col("user_id").asc()],
    "cooldown_aware": lambda: [F.col("last_cooldown").asc_nulls_first(), F.col("user_id").asc()],
    "round_robin": lambda: [F.col("user_id").asc()],
}


def pick(accounts: DataFrame, strategy: str, turn: int = 0) -> DataFrame:
    """The account a strategy takes next; round robin takes the place ``turn`` modulo the number of accounts."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {', '.join(STRATEGIES)}")
    ordered = accounts.orderBy(*STRATEGIES[strategy]())
    return ordered.offset(turn % max(1, accounts.count())).limit(1) if strategy == "round_robin" else ordered.limit(1)


#: A judge turns pairs into a column of scores from 0 to 100; models are the caller's.
JUDGES: dict[str, Callable[[Column, Column], Column]] = {
    "off": lambda src, mt: F.lit(None).cast("double"),
    "length": lambda src, mt: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(F.length(mt) / F.greatest(F.length(src), F.lit(1)) - 1) * 0.5)) * 100,
}


def rounds(rows: DataFrame, translate: Callable[[DataFrame, int], DataFrame], score: Callable[[DataFrame], DataFrame], gate: float = 60, most: int = 3) -> DataFrame:
    """Up to ``most`` attempts for rows (id, src): the first best (text, score) of each, and how many it took.

    ``translate(rows, attempt)`` adds mt, ``score(rows)`` adds score; a row that passes the gate isn't tried again.
    """
    pending, done = rows, None
    for attempt in range(1, most + 1):
        tried = score(translate(pending, attempt)).select("id", "src", "mt", "score", F.lit(attempt).alias("attempt"))
        done = tried if done is None else done.unionByName(tried)
        pending = tried.where(F.col("score") < gate).select("id", "src")
    best = F.max_by(F.struct("mt", "score"), F.struct("score", -F.col("attempt")))
    g = done.groupBy("id").agg(best.alias("b"), F.max("attempt").alias("attempts"))
    return g.select("id", "b.mt", "b.score", "attempts", (F.col("b.score") >= gate).alias("passed"))
