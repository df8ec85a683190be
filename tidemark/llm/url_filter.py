"""URL filter: logistic regression on hashed character n-grams of host and path, under a list of rules.

The model is fitted on the driver from a small labelled URL table, at most ``MOST_LABELLED`` rows
(by hash of the url). Urls are scored batch by batch with one vectorised pass over their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Longest first where several fit: (rule, verdict); the text before the first / is the host.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
GRAMS = (3, 4, 5)
DIMENSIONS = 1 << 15
MOST_LABELLED = 20_000
_PRIME = np.uint64(1099511628211)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    return F.translate(_parts(url, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return _parts(url, 2)


def _parts(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?:(?!://).)*://([^/?#]*)([^?#]*)", group), F.lit(""))


def rule_of(host_: Column, path_: Column, rules=RULES) -> Column:
    """The longest rule whose host is ``host_`` or a parent domain and whose path begins ``path_``; else null."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host_ == name) | host_.endswith("." + name)) & path_.startswith("/" + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(url number, feature number) of every hashed n-gram; host and path have n-grams of their own."""
    rows, features = [], []
    for salt, texts in enumerate((hosts, paths)):
        data = [f"^{t}$".encode("utf-8") for t in texts]
        lengths = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
        flat = np.frombuffer(b"".join(data), dtype=np.uint8).astype(np.uint64)
        owner = np.repeat(np.arange(len(data)), lengths)
        for n in GRAMS:
            if len(flat) < n:
                continue
            h = np.full(len(flat) - n + 1, 14695981039346656037 + 31 * salt + n, dtype=np.uint64)
            for k in range(n):
                h = (h ^ flat[k : len(flat) - n + 1 + k]) * _PRIME
            h = (h ^ (h >> np.uint64(29))) * _MIX
            whole = owner[: len(h)] == owner[n - 1 :]
            rows.append(owner[: len(h)][whole])
            features.append((h >> np.uint64(49)).astype(np.int64)[whole])
    if not rows:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(rows), np.concatenate(features)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """Probability that a url is to be blocked."""
        rows, features = _features(hosts, paths)
        size = np.maximum(np.bincount(rows, minlength=len(hosts)), 1)
        z = np.bincount(rows, weights=self.weights[features], minlength=len(hosts)) / np.sqrt(size) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(hosts: list[str], paths: list[str], bad: list[int], rounds: int = 400, rate: float = 0.5, decay: float = 1e-4) -> Model:
    """Regularised logistic regression by full-batch gradient steps with per-weight step sizes; no rows: all 0.5."""
    if not bad:
        return Model(np.zeros(DIMENSIONS), 0.0)
    y = np.asarray(bad, dtype=np.float64)
    rows, features = _features(hosts, paths)
    scale = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=len(y)), 1))
    weights, seen, bias = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-8), 0.0
    for _ in range(rounds):
        z = np.bincount(rows, weights=weights[features], minlength=len(y)) * scale + bias
        error = 1 / (1 + np.exp(-z)) - y
        step = np.bincount(features, weights=(error * scale)[rows], minlength=DIMENSIONS) / len(y) + decay * weights
        seen += step * step
        weights -= rate * step / np.sqrt(seen)
        bias -= rate * error.mean()
    return Model(weights, float(bias))


def fit_labelled(labelled: DataFrame) -> Model:
    """Fit on a labelled table (``url``, ``bad`` 0/1); of more than ``MOST_LABELLED`` rows the first by hash."""
    named = labelled.filter("url IS NOT NULL AND bad IS NOT NULL").select(host(F.col("url")).alias("h"), path(F.col("url")).alias("p"), "bad", "url")
    rows = named.orderBy(F.xxhash64("url"), "url", "bad").limit(MOST_LABELLED).collect()
    return fit([r["h"] for r in rows], [r["p"] for r in rows], [r["bad"] for r in rows])


def judge(pages: DataFrame, model: Model, url: str = "url", threshold: float = 0.5, rules=RULES) -> DataFrame:
    """``pages`` with ``host, path, rule, score, verdict`` (allow or block: the rule's, else the model's).

    Null urls and urls without ``://`` have empty host and path, fit no rule and are scored on that.
    Rows are judged one by one; columns of the names above are replaced.
    """
    shared = pages.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # DIMENSIONS doubles

    @F.pandas_udf("double")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        own = Model(*shared.value)
        for hosts, paths in batches:
            yield pd.Series(own.scores(hosts.tolist(), paths.tolist()))

    named = pages.withColumn("host", host(F.col(url))).withColumn("path", path(F.col(url)))
    ruled = named.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("score", scored("host", "path"))
    said = F.create_map(*[F.lit(x) for rule in rules for x in rule])
    own = F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return ruled.withColumn("verdict", F.coalesce(F.try_element_at(said, F.coalesce("rule", F.lit(""))), own))


# Words that unwanted hosts are named after, and words of ordinary ones; a small labelled table is made of them.
UNWANTED = (
    "casino poker bets bet slots jackpot win lottery pills pill pharma viagra meds cheap free spam farm ads ad track tracker "
    "click popup adult porn xxx sex cams x loans payday cash replica crack warez torrent seo links bonus gamble"
).split()
ORDINARY = (
    "news blog daily open source river garden library school museum travel kitchen health science history music weather city "
    "data code docs wiki forum times post review sports energy market bank design studio home family academy research"
).split()


def labelled_urls(spark: SparkSession, rows: int = 4000, seed: int = 7, unwanted=UNWANTED, ordinary=ORDINARY) -> DataFrame:
    """A small labelled table (``url``, ``bad``) made from the word lists above, or parts of them, by a seeded rule.

    Unwanted hosts join two unwanted words; ordinary ones are one or two ordinary words or pronounceable
    names. Hyphens, paths, prefixes and endings are drawn alike for both, so that words decide and not the hyphen.
    """
    rng = np.random.default_rng(seed)
    pick = lambda options: options[int(rng.integers(len(options)))]
    ends = ("er", "on", "th", "en", "at", "ing", "tion", "ly", "re", "st")
    made_up = lambda: "".join(
        pick("bcdfghklmnprstvwz") + pick("aeiou") if rng.random() < 0.5 else pick(ends) for _ in range(2 + int(rng.integers(3)))
    )
    made = []
    for i in range(rows):
        bad = i % 2
        joined = pick(("-", "", "-"))
        if bad:
            name = joined.join(pick(unwanted) for _ in range(2))
        else:
            word = lambda: pick(ordinary) if rng.random() < 0.4 else made_up()
            name = joined.join(word() for _ in range(1 + int(rng.integers(2))))
        top = pick(("example.com", "example.org", "example.net", "com", "org", "net", "de", "fr"))
        page = f"/{pick(('en', 'de', 'fr', 'es'))}/{int(rng.integers(1000))}" + pick(("", "/", ".html"))
        made.append((pick(("http://", "https://")) + pick(("", "www.", "blog.", "m.")) + name + "." + top + page, bad))
    return spark.createDataFrame(pd.DataFrame(made, columns=["url", "bad"]), "url string, bad int")
