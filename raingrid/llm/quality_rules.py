"""Quality rules as weak supervision.

Every rule votes good, bad or abstains. Expectation-maximisation over the counts of all vote
patterns estimates how each rule votes on good and on bad documents, and the posterior
probability of good replaces a filter that demands every rule.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raingrid.llm import frames, textscan
from raingrid.session import written

SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_CONTINUES = np.zeros(256, bool)
_CONTINUES[128:192] = True

STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
         "n_upper", "n_letters", "n_loud", "n_same", "n_distinct")


def text_stats(text: str | None) -> tuple[int, ...]:
    """The numbers of ``STATS``; all zero for a null or wordless text."""
    data = (text or "").encode()
    raw = np.frombuffer(data, np.uint8)
    starts, ends = textscan.word_spans(raw)
    n = len(starts)
    if not n:
        return (0,) * len(STATS)
    words = textscan.word_hashes(data)
    lines = [x for x in data.split(b"\n") if x and x.strip(b" \t\n\x0b\x0c\r")]
    triples = textscan.windows(words, 3)
    covered = np.zeros(n, bool)
    if len(triples):
        _, back, times = np.unique(triples, return_inverse=True, return_counts=True)
        twice = times[back] > 1
        for k in range(3):
            covered[k : k + len(twice)] |= twice
    blanks = len(raw) - int((ends - starts).sum())
    return (
        n, len(raw) - int(np.count_nonzero(_CONTINUES[raw])) - blanks,
        int(np.count_nonzero(_SYMBOL[raw])), len(lines), len(lines) - len(set(lines)),
        int(np.count_nonzero(covered)), int(np.count_nonzero(_UPPER[raw])),
        int(np.count_nonzero(_LETTER[raw])), int(np.count_nonzero(raw[ends - 1] == 33)),
        int(np.count_nonzero(words[1:] == words[:-1])), len(np.unique(words)),
    )


#: Rules about one defect each: (numerator, denominator, bad). A ratio from ``bad`` on votes bad,
#: up to ``bad`` if that is negative (its size counts); else, or without a denominator, the rule
#: abstains.
DEFECTS = {
    "symbols": ("n_symbols", "n_words", 0.10),
    "repeats": ("n_repeat_words", "n_words", 0.30),
    "same_word": ("n_same", "n_words", 0.10),
    "lines": ("n_dup_lines", "n_lines", 0.30),
    "upper": ("n_upper", "n_letters", 0.40),
    "loud": ("n_loud", "n_words", 0.20),
    "word_length": ("word_chars", "n_words", 14.0),
    "letters": ("n_letters", "word_chars", -0.80),
}
#: The rule about order: good if all these ratios are at most so large, else it abstains.
CLEAN = (("n_symbols", "n_words", 0.02), ("n_repeat_words", "n_words", 0.15),
         ("n_upper", "n_letters", 0.15), ("n_loud", "n_words", 0.05))


def votes() -> F.Column:
    """One character per rule: ``b`` or ``-`` for defects, then ``g`` or ``-`` for order."""
    def share(num, den):
        return F.when(F.col(den) > 0, F.col(num) / F.col(den))

    each = [F.when(share(num, den) <= -bad if bad < 0 else share(num, den) >= bad, "b")
            .otherwise("-") for num, den, bad in DEFECTS.values()]
    order = F.lit(True)
    for num, den, most in CLEAN:
        order = order & (share(num, den) <= most)
    return F.concat(*each, F.when(order, "g").otherwise("-"))


def fit_votes(patterns: dict[str, int], rounds: int = 200, accuracy: float = 0.9,
              balance: float = 0.6, weight: float = 100.0):
    """Posterior probability of good for every vote pattern, by expectation-maximisation.

    ``patterns`` counts the documents of every pattern. Every rule has one accuracy: the chance
    that it is right where it votes. Accuracies start from ``accuracy`` and are held to it by
    ``weight`` imagined votes. An abstention says nothing, and without votes the posterior is
    ``balance``. An accuracy stays above one half, which ties class 1 to the meaning good.
    """
    names = sorted(patterns)
    if not names:
        return {}
    n = np.array([patterns[p] for p in names], float)
    vote = np.array([[{"g": 1, "b": -1, "-": 0}[c] for c in p] for p in names], float)
    right, good = np.full(vote.shape[1], accuracy), np.zeros(len(names))
    for _ in range(rounds):
        odds = math.log(balance / (1 - balance)) + vote @ np.log(right / (1 - right))
        was, good = good, 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        agree = np.where(vote > 0, good[:, None], np.where(vote < 0, 1 - good[:, None], 0))
        right = (n @ agree + weight * accuracy) / (n @ np.abs(vote) + weight)
        right = np.clip(right, 0.51, 0.999)
        if np.abs(was - good).max() < 1e-9:
            break
    return dict(zip(names, good.tolist()))


def rate_quality(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, ``STATS``, votes, posterior, base_failed and kept for every row.

    base_failed: fewer than 50 words, or more than half of them in three-word windows that occur
    twice. kept: not base_failed and a posterior of ``least`` or more. A null text has no words.
    Repeated rows count as often as they stand there; a null doc_id stays null; an empty table
    gives no rows; other columns of ``docs`` are ignored. Rule accuracies rest on all rows; only
    the counts of vote patterns, 2 to the power of the rules at most, come to the driver.
    """

    def run(cols):
        rows = [text_stats(t) for t in cols["text"]]
        return {"doc_id": cols["doc_id"], **{k: [r[i] for r in rows] for i, k in enumerate(STATS)}}

    counted = written(
        frames.map_slices(docs.select("doc_id", "text"), run,
                          "doc_id long, " + ", ".join(f"{k} long" for k in STATS))
        .withColumn("votes", votes()), "quality-stats")
    patterns = {r.votes: r.n for r in counted.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    table = docs.sparkSession.createDataFrame(
        sorted(fit_votes(patterns).items()), "votes string, posterior double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        counted.join(F.broadcast(table), "votes")  # at most 2 ** 9 short rows
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("posterior") >= least))
    )


def op6_quality_rules(spark, sf: str) -> DataFrame:
    return rate_quality(frames.documents(spark, sf)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "votes", F.round("posterior", 9).alias("posterior"))
