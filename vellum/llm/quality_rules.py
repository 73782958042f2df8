"""Quality rules kept as a ledger of failure bits.

``ledger`` reads every text once and stores, for each document, the measurements
and one bit for every rule that it fails.  A policy is a versioned set of rules:
applying one, or asking what each of its rules removes alone, is bit arithmetic on
the ledger and never reads a text again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.words import iter_slices, mix

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower"]
SYMBOLS = b"#*$%&|<>"

#: A rule is true where a document fails it; the place in the list is its bit, so rules are only ever added.
RULES: dict[str, Column | str] = {
    "too_few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 20 * n_words",
    "short_words": "10 * word_chars < 20 * n_words",
    "long_words": "word_chars > 25 * n_words",
    "repeated_lines": "100 * n_dup_lines > 40 * n_lines",
    "shouting": "100 * n_upper > 60 * (n_upper + n_lower) and n_upper > 50",
}
BASE = ("too_few_words", "repeated_windows")
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "short_words", "long_words", "repeated_lines", "shouting"),
}


def _class_table() -> np.ndarray:
    t = np.zeros(256, np.uint8)
    t[list(SYMBOLS)] = 1
    t[65:91] = 2
    t[97:123] = 3
    t[128:192] = 4  # later bytes of a code point
    return t


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """Measurements of each text; a null text counts as empty, and all its counts are 0."""
    out = {k: np.zeros(len(column), np.int64) for k in MEASURES}
    kinds = _class_table()
    row = 0
    for w in iter_slices(column, lower=False):
        n, at = w.n_docs, w.offsets
        rows = slice(row, row + n)
        in_word = np.zeros(len(w.data) + 1, np.int8)
        in_word[w.starts] += 1
        in_word[w.ends] -= 1
        in_word = np.cumsum(in_word[:-1], dtype=np.int8).astype(bool)
        kind = kinds[w.data]
        byte_at = w.byte_offsets
        out["n_words"][rows] = np.diff(at)
        out["word_chars"][rows] = _sums(in_word & (kind != 4), byte_at)
        for name, k in (("n_symbols", 1), ("n_upper", 2), ("n_lower", 3)):
            out[name][rows] = _sums(kind == k, byte_at)
        out["n_repeat_words"][rows] = _repeated(w)
        raw = w.data.tobytes()
        for i in range(n):
            lines = [x for x in raw[byte_at[i] : byte_at[i + 1]].split(b"\n") if x.split(None, 1)]
            out["n_lines"][row + i] = len(lines)
            out["n_dup_lines"][row + i] = len(lines) - len(set(lines))
        row += n
    return out


def _repeated(w) -> np.ndarray:
    """Words in a three-word window that the same text has twice or more."""
    h, at = w.hashes, w.offsets
    if len(h) < 3:
        return np.zeros(w.n_docs, np.int64)
    doc = w.doc_of_word()
    first = np.flatnonzero(doc[2:] == doc[:-2])
    k = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
    window = mix(h[first] * k[0] + mix(h[first + 1] + k[1]) * k[2] + mix(h[first + 2] * k[3] + doc[first].astype(np.uint64)))
    order = np.argsort(window)
    ranked = window[order]
    twin = np.zeros(len(ranked), bool)
    twin[1:] = ranked[1:] == ranked[:-1]
    twin[:-1] |= twin[1:]
    hit = first[order[twin]]
    covered = np.zeros(len(h), bool)
    for step in range(3):
        covered[hit + step] = True
    return _sums(covered, at)


def ledger(docs: DataFrame, rules: dict[str, Column | str] = RULES) -> DataFrame:
    """(doc_id, measurements, fail_bits long) for every row, repeated rows included.

    Bit k of fail_bits is set if the k-th rule fails.  Null and blank texts have 0
    words and so fail too_few_words; they fail no rule that compares with n_words = 0.
    """
    schema = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[m]) for m in MEASURES)], ["doc_id", *MEASURES])

    measured = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(rules.values()):
        fails = F.expr(rule) if isinstance(rule, str) else rule
        bits = bits.bitwiseOR(F.when(fails, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.withColumn("fail_bits", bits)


def mask(policy: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in POLICIES[policy])


def failed(policy: str) -> Column:
    """True where a ledger row fails a rule of the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) != 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """What each rule of a policy does: rows failing it, rows failing it alone, rows kept without it.

    One aggregate over the ledger; an empty ledger gives zeros.
    """
    names, whole = list(RULES), mask(policy)
    bits = F.col("fail_bits").bitwiseAND(F.lit(whole).cast("long"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    each = []
    for r in POLICIES[policy]:
        b = F.lit(1 << names.index(r)).cast("long")
        rest = F.lit(whole & ~(1 << names.index(r))).cast("long")
        each.append(F.struct(F.lit(r).alias("rule"), F.coalesce(count(bits.bitwiseAND(b) != 0), F.lit(0)).alias("failed"), F.coalesce(count(bits == b), F.lit(0)).alias("failed_alone"), F.coalesce(count(bits.bitwiseAND(rest) == 0), F.lit(0)).alias("kept_without")))
    return rows.agg(F.array(*each).alias("each")).select(F.inline("each"))


def verdicts(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with base_failed and kept; kept is false wherever base_failed is true."""
    return ledger(docs).withColumn("base_failed", failed("base")).withColumn("kept", ~failed("base") & ~failed(policy))


def keep_good(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """``docs`` without the rows that the policy rejects, columns unchanged.

    The ledger is joined back by doc_id.  Rows with a null doc_id are kept only if
    none of them fails; rows that share a doc_id are judged together and go if one
    of them fails.
    """
    out = verdicts(docs, policy).where(~F.col("kept")).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(out, docs["doc_id"].cast("long").eqNullSafe(out["__id"]), "left_anti").select(docs.columns)
