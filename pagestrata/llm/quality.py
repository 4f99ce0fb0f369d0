"""Quality classifier: a sparse ensemble of rules over text statistics.

Small regression trees are boosted on a bounded sample of labelled rows; every
path from a root to a node becomes a conjunctive rule; a lasso logistic
regression gives most rules no weight; the rest are compiled into one Spark
column expression that scores whole texts without Python.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_columns, id_remainder

#: The most labelled rows that a model is fitted on, those of least hash.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS = 40, 3, 32
PENALTY = 2e-3

Rule = tuple[tuple[str, bool, float], ...]


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text (null: empty), all doubles, 0 for an empty one."""
    text = F.coalesce(text, F.lit(""))
    chars = F.length(text)
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)

    def share(pattern: str) -> Column:
        return (F.lit(1.0) - F.length(F.regexp_replace(text, pattern, "")) / F.greatest(chars, F.lit(1))) * F.when(chars > 0, 1.0).otherwise(0.0)

    per_word = lambda x: x.cast("double") / F.greatest(n, F.lit(1))
    return {
        "log_chars": F.log1p(chars.cast("double")),
        "word_length": per_word(chars),
        "repeated_words": F.lit(1.0) - per_word(F.size(F.array_distinct(words))) - F.when(n > 0, 0.0).otherwise(1.0),
        "doubled_words": per_word(F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++) (?=\1(?![^\x20\x09-\x0D]))"))),
        "symbols": share(r"[*$#%&@^~<>{}\[\]\\_=+]+"),
        "bars": share(r"[|]+"),
        "capitals": share(r"\p{Lu}+"),
        "exclaims": share(r"[!?]+"),
        "digits": share(r"[0-9]+"),
        "stops": share(r"[.,;:]+"),
        "line_feeds": share(r"\n+"),
    }


FEATURES = ("log_chars", "word_length", "repeated_words", "doubled_words", "symbols", "bars", "capitals", "exclaims", "digits", "stops", "line_feeds")


@dataclass
class Model:
    """log-odds = bias + the weights of the rules that hold."""

    bias: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self) -> Column:
        """Over columns named as FEATURES."""

        def holds(rule: Rule) -> Column:
            tests = [F.col(f) <= F.lit(t) if below else F.col(f) > F.lit(t) for f, below, t in rule]
            return reduce(lambda a, b: a & b, tests)

        odds = reduce(lambda a, b: a + b, [F.when(holds(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.rules], F.lit(float(self.bias)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))

    def apply(self, x: np.ndarray, names: tuple[str, ...] = FEATURES) -> np.ndarray:
        odds = np.full(len(x), self.bias)
        for rule, weight in self.rules:
            odds += weight * _holds(rule, x, names)
        return 1 / (1 + np.exp(-odds))


def _holds(rule: Rule, x: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
    ok = np.ones(len(x), dtype=bool)
    for name, below, at in rule:
        v = x[:, names.index(name)]
        ok &= v <= at if below else v > at
    return ok


def _grow(x: np.ndarray, cuts: list[np.ndarray], target: np.ndarray, names: tuple[str, ...], path: Rule, out: list[Rule], rows: np.ndarray, value: np.ndarray) -> None:
    """Split ``rows`` for the least squared error of ``target``; ``value`` gets the leaves' means."""
    mean = float(target[rows].mean())
    value[rows] = mean
    if len(path) >= DEPTH or len(rows) < 20:
        return
    best: tuple[float, int, float] | None = None
    total, n = target[rows].sum(), len(rows)
    for f, at in enumerate(cuts):
        if not len(at):
            continue
        cell = np.searchsorted(at, x[rows, f], side="left")
        count = np.bincount(cell, minlength=len(at) + 1)[:-1].cumsum()
        sums = np.bincount(cell, weights=target[rows], minlength=len(at) + 1)[:-1].cumsum()
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where((count >= 5) & (n - count >= 5), sums**2 / count + (total - sums) ** 2 / (n - count), -np.inf)
        k = int(gain.argmax())
        if gain[k] > total**2 / n + 1e-9 and (best is None or gain[k] > best[0]):
            best = (float(gain[k]), f, float(at[k]))
    if best is None:
        return
    _, f, at = best
    low = x[rows, f] <= at
    for below, part in ((True, rows[low]), (False, rows[~low])):
        rule = (*path, (names[f], below, at))
        out.append(rule)
        _grow(x, cuts, target, names, rule, out, part, value)


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty, by accelerated proximal gradient steps; the bias is free."""
    n, m = z.shape
    step = 4.0 / (np.linalg.norm(z, 2) ** 2 / n + 1)
    w, v, b, c, t = np.zeros(m), np.zeros(m), 0.0, 0.0, 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(z @ v + c))) - y
        moved = v - step * (z.T @ error) / n
        now = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        bias = c - step * error.mean()
        ahead = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = now + (t - 1) / ahead * (now - w), bias + (t - 1) / ahead * (bias - b)
        w, b, t = now, bias, ahead
    return b, w


def fit(x: np.ndarray, y: np.ndarray, names: tuple[str, ...] = FEATURES, penalty: float = PENALTY, seed: int = 5) -> Model:
    """Rules and weights for labels y (0 or 1). No rows: even odds; one class only: that class's smoothed odds."""
    ones, n = int(y.sum()), len(y)
    if ones in (0, n) or n < 10:
        return Model(float(np.log((ones + 1) / (n - ones + 1))))
    rng = np.random.default_rng(seed)
    cuts = []
    for f in range(x.shape[1]):
        at = np.unique(x[:, f])
        middle = (at[1:] + at[:-1]) / 2
        cuts.append(np.unique(middle[np.linspace(0, len(middle) - 1, min(BINS, len(middle))).astype(int)]) if len(middle) <= BINS else np.unique(np.concatenate([np.quantile(x[:, f], np.linspace(0.01, 0.99, BINS)), np.linspace(at[0], at[-1], BINS // 2 + 2)[1:-1]])))
    odds = np.full(n, np.log(ones / (n - ones)))
    found: list[Rule] = []
    for _ in range(TREES):
        target = y - 1 / (1 + np.exp(-odds))
        rows = np.flatnonzero(rng.random(n) < 0.5)
        if len(rows) < 20:
            rows = np.arange(n)
        used = set(rng.choice(x.shape[1], size=max(1, x.shape[1] * 2 // 3), replace=False).tolist())
        mine: list[Rule] = []
        value = np.zeros(n)
        _grow(x, [c if f in used else c[:0] for f, c in enumerate(cuts)], target, names, (), mine, rows, value)
        # the tree's prediction for all rows: its deepest rules that hold
        shift = np.zeros(n)
        for rule in sorted(mine, key=len):
            holds = _holds(rule, x, names)
            shift[holds] = target[holds].mean() if holds.any() else 0.0
        odds += 2.0 * shift
        found += mine
    rules = list(dict.fromkeys(tuple(sorted(r)) for r in found))
    z = np.stack([_holds(r, x, names) for r in rules], axis=1).astype(np.float64)
    seen: dict[bytes, int] = {}
    for k in range(z.shape[1]):  # rules that hold for the same rows count once
        seen.setdefault(z[:, k].tobytes(), k)
    keep = [k for k in seen.values() if 0 < z[:, k].sum() < n]
    bias, weights = _lasso(z[:, keep], y.astype(np.float64), penalty)
    return Model(float(bias), [(rules[k], float(w)) for k, w in zip(keep, weights, strict=True) if abs(w) > 1e-6])


def may_train(column: Column) -> Column:
    """Rows that labels may be learned from; the others are held out."""
    return id_remainder(column, 3) != 1


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` labelled rows that are not held out, those of least hash of their id.

    Labels other than 0 and 1, and those without a document, are passed over;
    of contradictory labels of an id the greater counts, and of an id's texts
    the one of least hash, so that at most ``rows`` rows of numbers are
    collected however often ids repeat.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_label")).filter("_id is not null and _label in (0, 1)")
    chosen = known.filter(may_train(F.col("_id"))).groupBy("_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    # at most ``rows`` pairs of numbers
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    told = joined.select("_id", "_label", F.xxhash64("text").alias("_h"), F.struct(*[c.alias(k) for k, c in statistics(F.col("text")).items()]).alias("_s"))
    once = told.groupBy("_id").agg(F.max("_label").alias("_label"), F.min_by("_s", "_h").alias("_s"))
    got = once.select("_id", "_label", "_s.*").toPandas().sort_values(["_id", *FEATURES])
    return fit(got[list(FEATURES)].to_numpy(dtype=np.float64), got["_label"].to_numpy())


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if score >= 0.5).

    Whole texts are scored by their statistics alone, at any length; a null
    text counts as empty and gets a score too; ids, null or repeated, are not
    looked at. Repeated rows get equal scores, and a score of 0.5 counts as
    good. An empty table gives an empty table. Columns named score or predicted
    are replaced, others pass through, whatever their names.
    """
    kept = drop_columns(docs, ["score", "predicted"])
    with_stats = kept.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("_row"), *[c.alias(k) for k, c in statistics(F.col("text")).items()])
    scored = with_stats.select("_row", model.score().alias("score"))
    return scored.select("_row.*", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = train(docs, labels)
    scored = score_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (~may_train(F.col("doc_id"))).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that a model fitted on ``labels`` rejects; all columns stay."""
    model = train(docs, labels)
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("text"))
    return score_documents(marked, model).filter("predicted = 1").select("_doc.*")
