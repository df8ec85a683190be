"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one bit per
failed rule. Policies are versioned masks over those bits, so judging by another version, or
without one rule, reads the ledger and no text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

SYMBOLS = "#*$%&|<>"
MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  # SQL condition over the measurements, in integers

    def bit(self) -> int:
        return 1 << [r.name for r in RULES].index(self.name)


# The position of a rule is its bit: append only.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "n_lines >= 3 AND 100 * n_dup_lines > 40 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
)
# A policy is a version and the rules it applies; a version never changes once it is used.
POLICIES = {
    1: ("few_words", "repeated_words"),
    2: ("few_words", "repeated_words", "symbols", "duplicate_lines", "short_words", "long_words"),
}
CURRENT = 2


def mask(version: int) -> int:
    return sum(r.bit() for r in RULES if r.name in POLICIES[version])


def _repeated(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice."""
    n = len(words)
    if n < 4:
        return 0
    numbers: dict[bytes, int] = {}
    at = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=n)
    # Windows are numbered exactly: first the pairs of words, then pair and third word.
    pairs = np.unique(at[:-1] * len(numbers) + at[1:], return_inverse=True)[1].reshape(-1)
    windows = np.unique(pairs[:-1] * len(numbers) + at[2:], return_inverse=True, return_counts=True)
    twice = np.flatnonzero(windows[2][windows[1].reshape(-1)] > 1)
    inside = np.zeros(n + 1, dtype=bool)
    for shift in range(3):
        inside[twice + shift] = True
    return int(inside.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The measurements of one text, null as empty: see ``MEASURES``."""
    if not text:
        return (0, 0, 0, 0, 0, 0)
    words = text.encode("utf-8").split()
    joined = b"".join(words).decode("utf-8")
    lines = [line for line in text.split("\n") if line.encode("utf-8").strip()]
    return (
        len(words),
        len(joined),
        sum(map(joined.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        _repeated(words),
    )


def ledger(docs: DataFrame, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (default: all) with the measurements and ``failed`` (one bit per failed rule).

    Null and empty text measure 0 and fail ``few_words``. Rows are judged one by one: repeated ids,
    nulls in other columns and an empty table need no care. Columns named like a measurement are replaced.
    """
    made = [m.split()[0] for m in MEASURES.split(", ")] + ["failed"]
    carried = common.without(docs.select(*(columns or docs.columns)), made).columns

    def make(texts: list[str | None]) -> list[pa.Array]:
        found = np.array([measure(t) for t in texts], dtype=np.int64).reshape(-1, len(made) - 1)
        return [pa.array(found[:, i]) for i in range(len(made) - 1)]

    measured = common.map_texts(docs, text, carried, make, MEASURES)
    failed = F.lit(0).cast("long")
    for rule in RULES:
        failed = failed.bitwiseOR(F.when(F.expr(rule.fails), F.lit(rule.bit())).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failed", failed)


def passes(version: int = CURRENT, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(mask(version)).cast("long")) == 0


def ablations(book: DataFrame, version: int = CURRENT) -> DataFrame:
    """Per rule of a policy: ``rule, failing, alone`` (failing it and no other), ``kept_without``, ``kept``, ``documents``.

    The ledger collapses to one row per combination of bits before anything is compared.
    """
    bits = book.groupBy("failed").agg(F.count(F.lit(1)).alias("_n"))
    applied = [(r.name, r.bit()) for r in RULES if r.name in POLICIES[version]]
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in applied]))
    own = F.col("failed").bitwiseAND(F.lit(mask(version)).cast("long"))
    spread = bits.select("_n", own.alias("_own"), rules.alias("_r"))

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("_n")).otherwise(F.lit(0)))

    hit = F.col("_own").bitwiseAND(F.col("_r.bit")) != 0
    return spread.groupBy(F.col("_r.rule").alias("rule")).agg(
        total(hit).alias("failing"),
        total(F.col("_own") == F.col("_r.bit")).alias("alone"),
        total((F.col("_own") == 0) | (F.col("_own") == F.col("_r.bit"))).alias("kept_without"),
        total(F.col("_own") == 0).alias("kept"),
        F.sum("_n").alias("documents"),
    )


def keep_good(docs: DataFrame, version: int = CURRENT, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with its columns."""
    judged = ledger(docs.withColumn("_row", F.struct("*")), text, columns=["_row"])
    return judged.filter(passes(version)).select("_row.*")
