"""Quality classifier: a sparse rule ensemble over text statistics.

The statistics of each whole text are Spark columns. On at most ``most`` labelled
rows, boosted shallow trees are grown; every path from a root is one conjunctive
rule. A lasso keeps few rules with logistic weights, and these are compiled into
one column expression, so scoring is a projection.

Defined results: null and empty texts have statistics of 0 and a score like any other;
rows are scored one by one; of labelled rows that share an id one is used; null labels
are left out; without labels of both kinds every score is their mean, or 0.5. An empty
table gives an empty one. Statistics replace columns of their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.sample import bounded


def statistics(text: str) -> dict[str, Column]:
    """Statistics of one text column, by name."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    words = F.filter(F.split(t, r"[ \n\t\r]+"), lambda w: w != "")
    n_words = F.greatest(F.size(words), F.lit(1))
    lines = F.split(t, "\n")

    def share(pattern: str) -> Column:
        return F.regexp_count(t, F.lit(pattern)) / n

    return {
        "log_chars": F.log1p(F.length(t).cast("double")),
        "word_length": F.length(t) / n_words,
        "distinct_words": F.log1p(F.size(F.array_distinct(words)).cast("double")) / F.log1p(n_words.cast("double")),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "line_words": F.log1p(n_words / F.size(lines)),
        "symbols": share(r"[#$%&*|!]"),
        "capitals": share("[A-Z]"),
        "digits": share("[0-9]"),
        "stops": share("[.?]"),
        "other": share(r"[^A-Za-z0-9\sÀ-ɏ.,?#$%&*|!]"),
    }


@dataclass
class Rules:
    """score = 1 / (1 + exp(-(intercept + sum of the weights of rules that hold)))."""

    intercept: float
    #: each rule: its weight and its (statistic, is over, bound)
    rules: list[tuple[float, tuple[tuple[str, bool, float], ...]]]

    def score(self, of: dict[str, Column]) -> Column:
        total = F.lit(self.intercept)
        for weight, rule in self.rules:
            holds = reduce(lambda a, b: a & b, (of[s] > bound if over else of[s] <= bound for s, over, bound in rule))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _tree(x: np.ndarray, codes: np.ndarray, edges: list[np.ndarray], residual: np.ndarray, hessian: np.ndarray, rows: np.ndarray, depth: int, least: int, step: np.ndarray, path: tuple, paths: list) -> None:
    """Grow one regression tree by histograms; adds its paths and moves ``step``."""
    g, h = residual[rows].sum(), hessian[rows].sum()
    best = (1e-6, None, None)
    if depth:
        for f in range(x.shape[1]):
            c = codes[rows, f]
            size = len(edges[f]) + 1
            gl = np.cumsum(np.bincount(c, residual[rows], size))[:-1]
            hl = np.cumsum(np.bincount(c, hessian[rows], size))[:-1]
            nl = np.cumsum(np.bincount(c, minlength=size))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(nl < least) | (len(rows) - nl < least)] = 0
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), f, int(gain.argmax()))
    if best[1] is None:
        step[rows] = g / (h + 1)
        return
    _, f, at = best
    low = codes[rows, f] <= at
    for over, part in ((False, rows[low]), (True, rows[~low])):
        longer = (*path, (f, over, float(edges[f][at])))
        paths.append(longer)
        _tree(x, codes, edges, residual, hessian, part, depth - 1, least, step, longer, paths)


def _shortened(rule: tuple) -> tuple:
    """One bound for each statistic and direction."""
    tight: dict[tuple[int, bool], float] = {}
    for f, over, bound in rule:
        old = tight.get((f, over), bound)
        tight[f, over] = max(old, bound) if over else min(old, bound)
    return tuple(sorted((f, over, bound) for (f, over), bound in tight.items()))


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 40, depth: int = 3, most_rules: int = 40) -> Rules:
    """Tree paths as rules, then the smallest lasso penalty that leaves at most ``most_rules``."""
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = Rules(float(np.log(mean / (1 - mean))), [])
    if len(np.unique(y)) < 2:
        return base
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], 1)
    margin, paths, rng = np.full(len(y), base.intercept), [], np.random.default_rng(7)
    least = max(5, len(y) // 500)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(len(y))
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        _tree(x, codes, edges, y - p, p * (1 - p), rows, depth, least, step, (), paths)
        margin += 0.3 * step
    rules = sorted({_shortened(p) for p in paths})
    if not rules:
        return base
    holds = np.stack([np.logical_and.reduce([(x[:, f] > b) if over else (x[:, f] <= b) for f, over, b in r]) for r in rules], 1).astype(np.float32)
    _, first = np.unique(holds, axis=1, return_index=True)
    holds, rules = holds[:, first], [rules[i] for i in first]
    spread = np.maximum(holds.std(0), 1e-3)
    z = ((holds - holds.mean(0)) / spread).astype(np.float32)
    rate = 4 * len(y) / np.linalg.norm(z, 2) ** 2 * 0.95
    top = np.abs(z.T @ (y - mean)).max() / len(y)
    w, b = np.zeros(z.shape[1]), base.intercept
    best = (w, b)
    for penalty in top * np.geomspace(0.5, 0.002, 12):
        v, momentum = w.copy(), 1.0
        for _ in range(150):
            p = 1 / (1 + np.exp(-(z @ v.astype(np.float32) + b)))
            b -= 2 * float((p - y).mean())
            new = v - rate * (z.T @ (p - y)) / len(y)
            new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
            after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
            v, w, momentum = new + (momentum - 1) / after * (new - w), new, after
        if (w != 0).sum() > most_rules:
            break
        best = (w.copy(), b)
    w, b = best
    weights = w / spread
    kept = np.flatnonzero(weights)
    return Rules(float(b - (weights * holds.mean(0)).sum()), [(float(weights[i]), tuple((names[f], over, bound) for f, over, bound in rules[i])) for i in kept])


def train(stats: DataFrame, labels: DataFrame, names: list[str], doc_id: str = "doc_id", label: str = "quality", most: int = 20_000) -> Rules:
    """Rules from at most ``most`` rows of ``labels``, joined with their statistics."""
    chosen = bounded(labels.select(doc_id, F.col(label).cast("int").alias("__y")).where("__y is not null"), doc_id, most)
    rows = stats.join(F.broadcast(chosen), doc_id).select(doc_id, "__y", *names).dropDuplicates([doc_id]).orderBy(doc_id).collect()
    x = np.array([[r[c] for c in names] for r in rows], float).reshape(-1, len(names))
    return fit_rules(x, np.array([min(1, max(0, r["__y"])) for r in rows], float), names)


def with_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, list[str]]:
    """``doc_id`` and the statistics of each row, and their names."""
    found = statistics(text)
    return docs.select(F.col(doc_id), *(c.alias(n) for n, c in found.items())), list(found)
