"""Quality by a sparse ensemble of rules over text statistics.

Statistics of a whole text are Spark columns. Boosted trees of ``DEPTH`` levels over them, grown in numpy on a
bounded sample, give rules: every path from a root is a conjunction of comparisons. A logistic model with an
absolute-value penalty (lasso) keeps the few rules that matter; both classes weigh alike there, and the offset then moves half of the way (in log odds) to the share that each has. The rules are compiled into one Spark column
expression, so that scoring runs inside the scan's own stage with no Python.

The fit takes at most ``TRAIN`` labelled documents of each class outside the held-out fold (a documented bound).

Edge cases: null and empty texts have statistics 0 and score by the rules that then hold; without documents of both classes every score is
the one label there is, else 0; an empty table gives no rows; texts of any length are measured whole; where several splits of a tree gain alike the first statistic's
lowest bound is taken, so reruns agree; rows come out once each; other columns are ignored unless kept by the caller.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hondana.llm import sampling

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.5
TRAIN = 3000
TREES = 40
DEPTH = 3
BINS = 32
PENALTY = 0.004


def statistics(docs: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """``docs`` with columns s_* over the whole text, and their names."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def hits(pattern: str) -> Column:
        return F.regexp_count("_t", F.lit(pattern)).cast("double")

    base = docs.select(*keep, t.alias("_t"))
    base = base.withColumn("_words", F.split(F.regexp_replace("_t", "[\\x00-\\x20]+", " "), " ")).withColumn("_lines", F.split("_t", "\n"))
    chars, words = F.greatest(F.length("_t"), F.lit(1)).cast("double"), F.greatest(F.size("_words"), F.lit(1)).cast("double")
    stats = {
        "chars": F.length("_t").cast("double"),
        "word_length": F.length("_t") / words,
        "letters": F.length(F.regexp_replace("_t", "[^\\p{L}]+", "")) / chars,
        "upper": F.length(F.regexp_replace("_t", "[^\\p{Lu}]+", "")) / chars,
        "digits": (F.length("_t") - F.length(F.translate("_t", "0123456789", ""))) / chars,
        "marks": (F.length("_t") - F.length(F.translate("_t", "!?|#$%&*<>{}[]=_~^+@/\\", ""))) / chars,
        "bars": (F.length("_t") - F.length(F.translate("_t", "|", ""))) / chars,
        "bangs": (F.length("_t") - F.length(F.translate("_t", "!", ""))) / chars,
        "stops": (F.length("_t") - F.length(F.translate("_t", ".,;:", ""))) / chars,
        "lines": F.size("_lines") / chars,
        "distinct_words": F.size(F.array_distinct("_words")) / words,
        "distinct_lines": F.size(F.array_distinct("_lines")) / F.size("_lines"),
        "repeats": hits("(?<!\\S)(\\S++)(?=\\s\\1(?!\\S))") / words,
    }
    return base.select(*keep, *[x.cast("double").alias(f"s_{k}") for k, x in stats.items()]), [f"s_{k}" for k in stats]


@dataclass
class Rules:
    """A document scores 1 / (1 + exp(-(offset + sum of weights of rules that hold)))."""

    names: list[str]
    rules: list[tuple[tuple[int, bool, float], ...]] = field(default_factory=list)  # (statistic, above?, bound)
    weights: list[float] = field(default_factory=list)
    offset: float = 0.0
    constant: float | None = None

    def column(self) -> Column:
        """The score as one expression."""
        if self.constant is not None:
            return F.lit(float(self.constant))
        total = F.lit(self.offset)
        for rule, weight in zip(self.rules, self.weights):
            holds = F.lit(True)
            for k, above, bound in rule:
                holds = holds & (F.col(self.names[k]) > bound if above else F.col(self.names[k]) <= bound)
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def text(self) -> list[str]:
        """The rules in words, largest weights first."""
        order = np.argsort(-np.abs(self.weights), kind="stable")
        return [f"{self.weights[i]:+.3f} if " + " and ".join(f"{self.names[k]} {'>' if up else '<='} {b:.5g}" for k, up, b in self.rules[i]) for i in order]


def holds(rule: tuple[tuple[int, bool, float], ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, bound in rule:
        out &= x[:, k] > bound if above else x[:, k] <= bound
    return out


def grow(x: np.ndarray, bins: list[np.ndarray], binned: np.ndarray, gradient: np.ndarray, weight: np.ndarray, depth: int, least: int = 8) -> tuple[list[tuple], np.ndarray]:
    """One regression tree on ``gradient``: all its paths, and its prediction for every row."""
    paths, value = [], np.zeros(len(x))

    def split(rows: np.ndarray, path: tuple, level: int) -> None:
        g, w = gradient[rows], weight[rows]
        value[rows] = (g * w).sum() / max(w.sum(), 1e-9)
        if path:
            paths.append(path)
        if level == depth or len(rows) < 2 * least:
            return
        best = (1e-9, -1, 0)
        base = (g * w).sum() ** 2 / w.sum()
        for k in range(x.shape[1]):
            if not len(bins[k]):
                continue
            b = binned[rows, k]
            gw, ww, n = (np.cumsum(np.bincount(b, v, len(bins[k]) + 1))[:-1] for v in (g * w, w, np.ones(len(rows))))
            fine = (n >= least) & (n <= len(rows) - least)
            if fine.any():
                gain = np.where(fine, gw**2 / np.maximum(ww, 1e-9) + (g @ w - gw) ** 2 / np.maximum(w.sum() - ww, 1e-9) - base, 0)
                at = int(np.argmax(gain))
                if gain[at] > best[0]:
                    best = (float(gain[at]), k, at)
        if best[1] < 0:
            return
        _, k, at = best
        above = binned[rows, k] > at
        bound = float(bins[k][at])
        split(rows[~above], (*path, (k, False, bound)), level + 1)
        split(rows[above], (*path, (k, True, bound)), level + 1)

    split(np.arange(len(x)), (), 0)
    return paths, value


def lasso(z: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 600) -> tuple[np.ndarray, float]:
    """Logistic weights and offset with an absolute-value penalty on the weights, by accelerated proximal steps."""
    a = np.c_[z, np.ones(len(z))].astype(np.float64)
    weight = weight / weight.sum()
    step = 4 / np.linalg.norm((a.T * weight) @ a, 2)
    w = v = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ v, -60, 60)))
        new = v - step * (a.T @ (weight * (p - y)))
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, w = new + (before - 1) / t * (new - w), new
    return w[:-1], float(w[-1])


def fit(x: np.ndarray, y: np.ndarray, names: list[str], counts: dict[int, int] | None = None, trees: int = TREES, penalty: float = PENALTY) -> Rules:
    """Rules from statistics ``x`` and labels ``y``; ``counts``: documents of each class there are."""
    if len(set(y.tolist())) < 2:
        return Rules(names, constant=float(y[0]) if len(y) else 0.0)
    have = counts or {k: int((y == k).sum()) for k in (0, 1)}
    # Classes count alike while rules are sought; the offset then shifts half of the way to how many documents each has.
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * len(y)
    bins = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    bins = [(b[:-1] + b[1:]) / 2 if len(b) > 1 else b for b in bins]
    binned = np.stack([np.searchsorted(b, x[:, k], side="left") for k, b in enumerate(bins)], axis=1)
    total, rules = np.zeros(len(x)), []
    rng = np.random.default_rng(11)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        part = weight * (rng.random(len(x)) < 0.7)
        paths, value = grow(x, bins, binned, (y - p) * 4, np.maximum(part, 1e-6), DEPTH)
        rules += paths
        total += 0.3 * value
    seen: dict[bytes, tuple] = {}
    for rule in sorted(set(rules), key=lambda r: (len(r), r)):
        h = holds(rule, x)
        if 0 < h.sum() < len(x):
            seen.setdefault(min(h.tobytes(), (~h).tobytes()), rule)
    chosen = list(seen.values())
    if not chosen:
        return Rules(names, constant=have.get(1, 0) / max(1, sum(have.values())))
    z = np.stack([holds(r, x) for r in chosen], axis=1)
    w, offset = lasso(z, y, weight, penalty)
    on = np.flatnonzero(np.abs(w) > 1e-6)
    return Rules(names, [chosen[k] for k in on], [float(w[k]) for k in on], offset + 0.5 * float(np.log((have.get(1, 1)) / max(1, have.get(0, 1)))))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN) -> Rules:
    chosen, counts = sampling.sample(labels, "quality", FOLDS, HELD_OUT, most)
    # At most 2 * most rows of two numbers: a fixed size, so broadcast.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    stats, names = statistics(rows, ("doc_id", "label"))
    got = sorted(tuple(r) for r in stats.collect())
    return fit(np.array([r[2:] for r in got], np.float64).reshape(-1, len(names)), np.array([r[1] for r in got], np.int64), names, counts)


def op7_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, by the rules that the labels outside the held-out fold give."""
    rules = train(docs, labels)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (sampling.fold(FOLDS) == HELD_OUT).alias("held_out"), "text")
    stats, _ = statistics(given, ("doc_id", "held_out"))
    scored = stats.select("doc_id", "held_out", rules.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
