"""Quality rules combined by weak supervision.

Rules look at a document's measures and vote good, bad, or abstain.
No rule decides alone: expectation-maximisation estimates, without
labels, how often each rule's votes are right, and the
posterior probability that a document is good replaces a filter that all must pass.

The model only needs how many documents have each pattern of votes.  Patterns are
counted by one aggregation; there are at most ``2 ** len(RULES)`` of
them (``MAX_PATTERNS``), whatever the number of documents, so they may go to the
driver.  The fitted posteriors go back as a table of the patterns, broadcast
with that bound.  Texts are never shuffled.

Defined results: null or empty text has no words, fails the base rule and is not
kept; repeated rows are judged alike; an empty table gives an empty
result; input columns named like the results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .frames import add, any_names, unused
from .words import NOT_SPACE, covered, grams, groups, mixed

NGRAM = 5
MEASURES = T.StructType([T.StructField(n, T.LongType()) for n in (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_letters", "n_digits", "n_wide", "n_marks", "n_top_word")])
THRESHOLD = 0.5
ROUNDS = 50
START = 0.1  # probability of good to begin with, where a rule votes bad
PRIOR = 2.0  # pseudo-documents that hold rates off 0 and 1
GOOD_RULES = 2  # the first ones of RULES vote good, the others bad
LEAN = {"good": np.where(np.arange(10) < GOOD_RULES, 0.9, 0.01), "bad": np.where(np.arange(10) < GOOD_RULES, 0.4, 0.3)}

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = np.isin(np.arange(256), list(range(0x41, 0x5B)))
_LETTER = _UPPER | np.isin(np.arange(256), list(range(0x61, 0x7B)))
_DIGIT = np.isin(np.arange(256), list(range(0x30, 0x3A)))
_MARK = np.isin(np.arange(256), list(b"!?"))
_WIDE = np.arange(256) >= 0xC0  # first byte of a character outside ASCII
_START = (np.arange(256) & 0xC0) != 0x80  # first byte of a character


def _share(part: str, whole: str) -> Column:
    return F.col(part).cast("double") / F.greatest(F.col(whole), F.lit(1)).cast("double")


def rules() -> list[tuple[str, Column]]:
    """Name (as in ``RULES``) and vote (0 abstain, 1 good, 2 bad) of each rule.

    Two rules know clean prose and vote good or abstain; the others know one kind of
    junk each and vote bad or abstain.  A lone bad vote can be outvoted.
    """
    length, symbols = _share("word_chars", "n_words"), _share("n_symbols", "n_words")
    repeats, lines = _share("n_repeat_words", "n_words"), _share("n_dup_lines", "n_lines")
    upper, marks, top = _share("n_upper", "n_letters"), _share("n_marks", "n_words"), _share("n_top_word", "n_words")
    words = F.col("n_words")
    plain = (F.col("n_letters") + F.col("n_digits") + F.col("n_wide")).cast("double") / F.greatest("word_chars", F.lit(1))
    good, bad = {
        "prose": (plain >= 0.88) & (upper <= 0.4),
        "varied": (words >= 10) & (repeats <= 0.2) & (top <= 0.25),
    }, {
        "short": words < 10,
        "word_length": (length < 2.0) | (length > 20.0),
        "symbols": symbols > 0.3,
        "capitals": upper > 0.6,
        "marks": marks > 0.5,
        "repeats": repeats > 0.2,
        "top_word": (words >= 20) & (top > 0.3),
        "lines": (F.col("n_lines") >= 4) & (lines > 0.5),
    }
    return [(n, F.when(c, F.lit(1)).otherwise(F.lit(0))) for n, c in good.items()] + \
           [(n, F.when(c, F.lit(2)).otherwise(F.lit(0))) for n, c in bad.items()]


RULES = ("prose", "varied", "short", "word_length", "symbols", "capitals", "marks", "repeats", "top_word", "lines")
MAX_PATTERNS = 2 ** len(RULES)


def _measure(names: list[str], text: str, drop: set[str]):
    def run(batches):
        for batch in batches:
            column, found = batch.column(names.index(text)), []
            for g in groups(column, NOT_SPACE, False):
                found.append(_measures(g))
            if batch.num_rows:
                old = {k: batch.column(i) for i, k in enumerate(names) if k not in drop}
                new = {k: pa.array(np.concatenate([f[k] for f in found]), pa.int64()) for k in MEASURES.names}
                yield pa.RecordBatch.from_arrays([*old.values(), *new.values()], names=[*old, *new])
    return run


def _measures(g) -> dict[str, np.ndarray]:
    n = g.texts

    def bytes_of(kind, data=None):
        total = np.concatenate([[0], np.cumsum(kind[g.data] if data is None else data)])
        return total[g.bounds[1:]] - total[g.bounds[:-1]]

    key = mixed(g.hash ^ mixed(g.doc.astype(np.uint64) + np.uint64(7)))
    # 5-word windows found twice or more in a text
    w = grams(key, NGRAM)
    w = np.where(g.doc[:len(w)] == g.doc[NGRAM - 1:], w, np.uint64(0)) if len(w) else w
    at = np.flatnonzero(w)
    order = at[np.argsort(w[at], kind="stable")]
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = w[order][1:] == w[order][:-1]
    twice = order[same[1:] | same[:-1]]
    repeated = covered(len(key), twice, twice + NGRAM)
    # the most frequent word
    order = np.argsort(key)
    head = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0])) if len(order) else order
    top = np.zeros(n, np.int64)
    np.maximum.at(top, g.doc[order[head]], np.diff(np.concatenate([head, [len(order)]])))
    # lines: line ends in the data, and whether a line has a word
    lines, dup = _lines(g)
    count = np.bincount(g.doc, minlength=n)
    return {"n_words": count, "word_chars": bytes_of(None, NOT_SPACE[g.data] & _START[g.data]), "n_symbols": bytes_of(_SYMBOL),
            "n_dup_lines": dup, "n_repeat_words": np.bincount(g.doc[repeated], minlength=n), "n_lines": lines,
            "n_upper": bytes_of(_UPPER), "n_letters": bytes_of(_LETTER), "n_wide": bytes_of(_WIDE), "n_digits": bytes_of(_DIGIT),
            "n_marks": bytes_of(_MARK), "n_top_word": top}


def _lines(g) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word of each text, and those of them that equal an earlier line of the text."""
    count, dup = np.zeros(g.texts, np.int64), np.zeros(g.texts, np.int64)
    raw = g.data.tobytes()
    for i in range(g.texts):
        body = raw[g.bounds[i]:g.bounds[i + 1]]
        if b"\n" not in body:
            count[i] = bool(body.strip())
            continue
        own = [x for x in body.split(b"\n") if x.strip()]
        count[i], dup[i] = len(own), len(own) - len(set(own))
    return count, dup


@any_names
def measures(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or the columns ``keep``) with the measures the rules look at."""
    taken = {n.lower() for n in MEASURES.names}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in taken]
    src = docs.select(*keep, *([text] if text not in keep else []))
    fields = [f for f in src.schema.fields if f.name in keep]
    return src.mapInArrow(_measure(src.columns, text, {text} - set(keep)), T.StructType([*fields, *MEASURES.fields]))


def fit(patterns: list[tuple[list[int], int]]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Posterior probability of good for each pattern of votes (with its count), and how often
    each rule votes on good and on bad documents: for a rule that votes good its right and wrong
    votes, for one that votes bad its wrong and right ones.

    Starts from: a pattern with a bad vote is bad.  Rules are taken as independent given the class.
    """
    votes = np.array([v for v, _ in patterns], dtype=np.int64).reshape(len(patterns), len(RULES)) > 0
    count = np.array([c for _, c in patterns], dtype=float)[:, None]
    good = np.where(votes[:, GOOD_RULES:].any(axis=1), START, 1 - START)[:, None]
    rate: dict[str, np.ndarray] = {}
    for _ in range(ROUNDS):
        for name, weight in (("good", good * count), ("bad", (1 - good) * count)):
            rate[name] = ((votes * weight).sum(0) + PRIOR * LEAN[name]) / (weight.sum() + PRIOR)
        prior = ((good * count).sum() + PRIOR * 0.5) / (count.sum() + PRIOR)
        log = np.log(prior) - np.log1p(-prior)
        log = log + np.where(votes, np.log(rate["good"] / rate["bad"]), np.log((1 - rate["good"]) / (1 - rate["bad"]))).sum(1)
        good = 1 / (1 + np.exp(-np.clip(log, -500, 500)))[:, None]
    return good[:, 0], rate


def _pattern() -> Column:
    return F.concat(*[v.cast("string") for _, v in rules()])


def posteriors(measured: DataFrame) -> DataFrame:
    """``pattern, quality``: the fitted posterior of each pattern of votes found in ``measured``."""
    counted = measured.groupBy(_pattern().alias("pattern")).agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").collect()
    if len(counted) > MAX_PATTERNS:
        raise ValueError("more vote patterns than the rules can make")
    good = fit([([int(x) for x in r["pattern"]], r["n"]) for r in counted])[0] if counted else []
    rows = [(r["pattern"], float(q)) for r, q in zip(counted, good)]
    return measured.sparkSession.createDataFrame(rows, "pattern string, quality double")


@any_names
def judged(measured: DataFrame, table: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``measured`` with ``quality`` (posterior), ``base_failed`` and ``kept``."""
    p, q = unused(measured, "pattern", "quality")
    small = table.select(F.col("pattern").alias(p), F.col("quality").alias(q))
    out = measured.join(F.broadcast(small), _pattern() == F.col(p))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return add(out, base_failed=failed, quality=F.col(q), kept=~failed & (F.col(q) >= threshold)).drop(p, q)
