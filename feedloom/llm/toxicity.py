"""Toxicity: a counterfactual-regularised linear classifier of whole texts.

Features are the distinct words of a text, each as itself and as its leading 4, 5 and 6
characters (in lower case), named by 32-bit hashes.  A distributed count over the training
texts keeps those whose presence goes with the label by a G-test; a text's score is the
logistic function of the intercept and the weights of the kept features that it has.

Training minimises the logistic loss over labelled texts, a ridge, and a counterfactual
penalty: sentences of the labelled texts that mention an identity term, and neutral
sentences with each term, are set beside themselves with another term of the same group
swapped in, and squared changes of the score are penalised; the neutral sentences carry the
label 0.  So group mentions get no weight of their own and what is toxic by itself stays.

Training reads a sample of about `most` labelled rows, chosen by a hash of the id (a
documented bound); all of these texts are read whole, on the executors, and only the kept
features reach the driver.  Scoring covers every text whole.

A null or empty text has no words and scores the intercept.  Without labels of both kinds
the prior alone is learnt.  Repeated rows get equal scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_value, release, saved, small_batches, tidy

by_value(__name__)

#: Least G of a kept feature: chance gives that to about one in 50,000.
LEAST_G = 18.0
WORD = re.compile(r"\w+")
#: Groups of terms that a sentence may mention without being toxic; a parameter of `fitted`.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "atheists", "buddhists"),
    ("muslim", "christian", "jewish", "hindu", "atheist", "buddhist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("disabled", "deaf", "blind", "elderly", "young"),
)


def features(word: str) -> tuple[int, ...]:
    """What a word stands for: itself and its beginnings."""
    parts = [f"={word}", *(f"^{word[:k]}" for k in (4, 5, 6) if len(word) >= k)]
    return tuple(xxhash.xxh32_intdigest(p) for p in parts)


class Known(dict):
    """Word -> its features, of all or of those in `only`; kept up to a bound."""

    def __init__(self, only: dict[int, float] | None = None, most: int = 200_000):
        super().__init__()
        self.only, self.most = only, most

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        got = features(word)
        if self.only is not None:
            got = tuple(f for f in got if f in self.only)
        self[word] = got
        return got


def text_features(text: str | None, known: Known) -> set[int]:
    used: set[int] = set()
    if text:
        used.update(*map(known.__getitem__, set(WORD.findall(text.lower()))))
    return used


def swapped(text: str, groups: tuple[tuple[str, ...], ...] = IDENTITY) -> list[tuple[str, str]]:
    """Sentences of `text` with an identity term, each beside itself with the next term of the group."""
    after = {t: g[(i + 1) % len(g)] for g in groups for i, t in enumerate(g)}
    any_term = re.compile(r"\b(" + "|".join(sorted(after, key=len, reverse=True)) + r")\b", re.I)
    out = []
    for s in re.split(r"(?<=[.!?])\s+|\n", text):
        if any_term.search(s):
            out.append((s, any_term.sub(lambda m: after[m[0].lower()], s)))
    return out


def parts(batches: Iterator[pd.DataFrame], rows: int = 1000) -> Iterator[pd.DataFrame]:
    """The same rows, few at once, which bounds a worker's memory."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.iloc[at : at + rows]


@dataclass
class Classifier:
    """Weights by feature, and an intercept."""

    weights: dict[int, float] = field(default_factory=dict)
    intercept: float = 0.0


def _g(pos, neg, all_pos, all_neg) -> Column:
    """The G statistic of a feature's presence and the label."""
    n = all_pos + all_neg
    term = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    has = pos + neg
    cells = [(pos, has * all_pos / n), (neg, has * all_neg / n), (all_pos - pos, (n - has) * all_pos / n), (all_neg - neg, (n - has) * all_neg / n)]
    return 2 * sum((term(o, e) for o, e in cells), F.lit(0.0))


def fitted(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", most: int = 30_000, kept: int = 5_000, pairs_at_most: int = 50_000, groups=IDENTITY, strength: float = 4.0) -> Classifier:
    """Fit on a bounded sample of `labels` (key, label); rows without key or label are left out.

    most: labelled rows, about, chosen by a hash of `key`; a key with several labels counts as 1 if
    one of them is.  kept: features, at most, of those that tell the labels apart; the best by G,
    equals by number.  pairs_at_most: swapped sentences that count in the penalty, chosen by a hash.  The
    three bound what reaches the driver, at any size of input and of text; scoring has no bounds.

    The chosen labels are few by that bound, so they go to the texts, which are not shuffled; the
    labelled texts are stored and all else reads them there.
    """
    small_batches(docs.sparkSession)
    known_ = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), (F.col(label) > 0).cast("int").alias("y"))
    share = min(1.0, most / max(1, known_.count()))
    chosen = known_.where(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < int(share * 1_000_000)).groupBy("k").agg(F.max("y").alias("y"))
    texts_ = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    rows = saved(texts_.join(F.broadcast(chosen), "k").select("t", "y"), "labelled")
    ones, total = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count(F.lit(1))).first()
    model = Classifier(intercept=float(np.log((ones + 0.5) / (total - ones + 0.5))))
    if not 0 < ones < total:
        return model

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Known(most=100_000)
        for b in parts(batches):
            sets = [np.fromiter(text_features(t, known), np.int64) for t in b["t"]]
            if sets:
                f, back = np.unique(np.concatenate(sets), return_inverse=True)
                y = np.repeat(b["y"].to_numpy(np.int64), [len(s) for s in sets])
                have = np.bincount(back, minlength=len(f))
                pos = np.bincount(back, y, len(f)).astype(np.int64)
                yield pd.DataFrame({"f": f, "pos": pos, "neg": have - pos})

    counts = rows.mapInPandas(tidy(count), "f long, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    tested = counts.withColumn("g", _g(F.col("pos"), F.col("neg"), F.lit(ones), F.lit(total - ones))).where(F.col("g") >= LEAST_G)
    best = [r["f"] for r in tested.orderBy(F.desc("g"), "f").limit(kept).select("f").collect()]
    terms = {f for g in groups for t in g for f in features(t)}
    number = {f: i for i, f in enumerate(dict.fromkeys([*best, *sorted(terms)]))}

    def use(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Known(number)
        ids = lambda t: np.sort(np.fromiter((number[f] for f in text_features(t, known)), np.int32)).tobytes()
        for b in parts(batches):
            out = []
            for t, y in zip(b["t"], b["y"]):
                out.append((ids(t), y, None))
                out += [(ids(p), None, ids(q)) for p, q in (swapped(t, groups) if t else [])]
            yield pd.DataFrame(out, columns=["x", "y", "b"]).astype({"y": "Int32"})

    # texts, and pairs, with the same few features are one row with a number
    used = saved(rows.mapInPandas(tidy(use), "x binary, y int, b binary").groupBy("x", "y", "b").agg(F.count(F.lit(1)).alias("n")), "features")
    got = used.where("b is null").toPandas()
    both = used.where("b is not null").orderBy(F.xxhash64("x", "b"), "x", "b").limit(pairs_at_most).toPandas()
    of = lambda raw: np.frombuffer(raw, np.int32)
    neutral = [f"The {t} live and work here." for g in groups for t in g]
    known = Known(number)
    named = lambda t: np.fromiter((number[f] for f in text_features(t, known)), np.int32)
    pairs = [(of(p), of(q)) for p, q in zip(both["x"], both["b"])]
    more = [(named(p), named(q)) for s in neutral for p, q in swapped(s, groups)]
    texts = [of(x) for x in got["x"]] + [named(s) for s in neutral]
    y = np.concatenate((got["y"].to_numpy(np.float64), np.zeros(len(neutral))))
    n = np.concatenate((got["n"].to_numpy(np.float64), np.ones(len(neutral))))
    w, model.intercept = descend(texts, y, n, pairs + more, np.concatenate((both["n"].to_numpy(np.float64), np.ones(len(more)))), len(number), model.intercept, strength)
    model.weights = {f: float(w[i]) for f, i in number.items() if w[i]}
    return model


def descend(texts, y, n, pairs, times, size: int, b: float, strength: float, ridge: float = 0.02, steps: int = 400) -> tuple[np.ndarray, float]:
    """Minimise the mean loss, and the pairs' mean change of score squared, by gradient steps scaled for each weight (Adam)."""
    flat = lambda rows: (np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows) if rows else np.zeros(0, np.int32))
    row, col = flat(texts)
    ra, ca = flat([p for p, _ in pairs])
    rb, cb = flat([q for _, q in pairs])
    w = np.zeros(size)
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    # rare labels count as much as frequent ones, half at most
    share = float((n * y).sum() / n.sum())
    weight = n * np.where(y > 0, min(0.5 / share, 4), 1)
    weight /= weight.sum()
    for step in range(1, steps + 1):
        g0 = weight * (sigmoid(np.bincount(row, w[col], len(texts)) + b) - y)
        g = np.bincount(col, g0[row], size) + ridge * w / len(texts)
        if pairs:
            pa_, pb_ = sigmoid(np.bincount(ra, w[ca], len(pairs)) + b), sigmoid(np.bincount(rb, w[cb], len(pairs)) + b)
            d = 2 * strength * (pa_ - pb_) * times / times.sum()
            g += np.bincount(ca, (d * pa_ * (1 - pa_))[ra], size) - np.bincount(cb, (d * pb_ * (1 - pb_))[rb], size)
        g = np.append(g, g0.sum())
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        move = 0.08 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9) * min(1.0, 2 * (1 - step / (steps + 1)))
        w -= move[:-1] * (np.abs(g[:-1]) > 1e-12)
        b -= move[-1]
    return w, float(b)


def score(text: Column, model: Classifier) -> Column:
    """Probability of the label 1 for a whole text."""
    weights, intercept = model.weights, model.intercept

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Known(weights)
        for texts in batches:
            z = np.array([sum(weights[f] for f in text_features(t if isinstance(t, str) else "", known)) for t in texts]) + intercept
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        release()

    return run(text)
