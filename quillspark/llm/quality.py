"""Quality classifier: a sparse ensemble of rules over text statistics, compiled into Spark column expressions.

1. Statistics of whole texts are Spark column expressions (STATISTICS).
2. Small boosted trees over the statistics of labelled rows are grown in numpy; every path from a root to a node is
   a conjunctive rule (statistic <= cut and ...).
3. Logistic regression with an L1 penalty gives weights to the rules; most become zero.
4. The rules that stay are compiled into one column expression, so scoring is a plain projection of the documents.

The classifier is fitted on at most TRAIN_ROWS labelled rows, those with the smallest hash of doc_id; rows that
fit() is not given take no part. Labels, doc_id, lang and source are no inputs of a score.

Case rules: a null text is scored like the empty one; labels that are null, or whose doc_id has no document, are left
out; a doc_id with several labels or several texts gives a training row for each; without training rows of both
labels the score is the share of label 1 (0.5 without any rows).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import once

TRAIN_ROWS = 20_000
TREES = 40
DEPTH = 3
BINS = 32
LASSO = 2e-4
BLANK = r"[\x20\x09-\x0D]+"


def statistics(text: Column) -> dict[str, Column]:
    """Name -> double statistic of the whole text. The array of words comes from the column words."""
    n = F.greatest(F.char_length(text), F.lit(1)).cast("double")
    w = F.col("words")
    n_words = F.greatest(F.size(w), F.lit(1)).cast("double")
    share = lambda pattern: (F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))) / n
    lines = F.split(text, "\n")
    return {
        "log_chars": F.log1p(F.char_length(text).cast("double")),
        "log_words": F.log1p(F.size(w).cast("double")),
        "word_chars": n / n_words,
        "upper": share(r"\p{Lu}+"),
        "digit": share(r"\p{N}+"),
        "stop": share(r"[.,;:!?]+"),
        "symbol": share(r"[^\p{L}\p{N}\s.,;:!?'\"-]+"),
        "bang": share("!+"),
        "pipe": share(r"\|+"),
        "distinct": F.size(F.array_distinct(w)) / n_words,
        "echo": (F.size(w) - F.size(F.filter(w, lambda x, i: ~x.eqNullSafe(F.get(w, i - 1))))) / n_words,
        "line_chars": F.log1p(n / F.size(lines)),
        "line_distinct": F.size(F.array_distinct(lines)) / F.size(lines),
        "inner_upper": share(r"(?<=\p{Lu})\p{Lu}+"),
        "symbol_ends": F.size(F.filter(w, lambda x: x.rlike(r"[#$%&*!|]$"))) / n_words,
    }


STATISTICS = ["log_chars", "log_words", "word_chars", "upper", "digit", "stop", "symbol", "bang", "pipe", "distinct", "echo", "line_chars", "line_distinct", "inner_upper", "symbol_ends"]


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    rows = once(rows, "words", F.filter(F.split("text", BLANK), lambda x: x != ""))
    stats = statistics(F.col("text"))
    out = once(rows, "stats", F.struct(*[stats[s].cast("double").alias(s) for s in STATISTICS]))
    return out.select(*keep, *[F.col("stats").getField(s).alias(s) for s in STATISTICS])


Rule = tuple[tuple[int, float, bool], ...]  # (statistic, cut, is it at most the cut)


@dataclass
class RuleEnsemble:
    base: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def column(self, names: list[str] = STATISTICS) -> Column:
        """The probability of label 1 over columns names."""
        total = F.lit(float(self.base))
        for rule, weight in self.rules:
            holds = F.lit(True)
            for s, cut, below in rule:
                holds = holds & ((F.col(names[s]) <= cut) if below else (F.col(names[s]) > cut))
            total = total + F.when(holds, float(weight)).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for rule, weight in self.rules:
            total += weight * holds(rule, x)
        return 1 / (1 + np.exp(-total))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for s, cut, below in rule:
        out &= (x[:, s] <= cut) if below else (x[:, s] > cut)
    return out


def _tree(x: np.ndarray, gradient: np.ndarray, cuts: list[np.ndarray], depth: int, least: int) -> tuple[list[Rule], np.ndarray]:
    """The paths of a regression tree that is grown on binned statistics, and its prediction of the gradient."""
    paths: list[Rule] = []
    out = np.zeros(len(x))

    def grow(rows: np.ndarray, path: Rule) -> None:
        g = gradient[rows]
        out[rows] = g.mean()
        if path:
            paths.append(path)
        if len(path) >= depth or len(rows) < 2 * least:
            return
        best = (1e-9, 0, 0.0)
        for s, own in enumerate(cuts):
            if not len(own):
                continue
            bins = np.searchsorted(own, x[rows, s], side="left")
            n = np.cumsum(np.bincount(bins, minlength=len(own) + 1))[:-1]
            total = np.cumsum(np.bincount(bins, g, len(own) + 1))[:-1]
            right = len(rows) - n
            gain = np.where((n >= least) & (right >= least), total**2 / np.maximum(n, 1) + (g.sum() - total) ** 2 / np.maximum(right, 1), 0) - g.sum() ** 2 / len(rows)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), s, float(own[i]))
        if best[2] == 0.0 and best[1] == 0 and best[0] <= 1e-9:
            return
        _, s, cut = best
        below = x[rows, s] <= cut
        grow(rows[below], (*path, (s, cut, True)))
        grow(rows[~below], (*path, (s, cut, False)))

    grow(np.arange(len(x)), ())
    return paths, out


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[Rule]:
    cuts = [np.unique(np.quantile(x[:, s], np.linspace(0, 1, BINS + 1)[1:-1])) for s in range(x.shape[1])]
    score, rules = np.full(len(x), np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9))), {}
    for _ in range(trees):
        gradient = y - 1 / (1 + np.exp(-score))
        paths, out = _tree(x, gradient, cuts, depth, max(5, len(x) // 500))
        rules |= dict.fromkeys(paths)
        score += 0.5 * out / max(1e-3, float(np.mean(y * 0 + 0.25)))
    return list(rules)


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float = LASSO, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Base and weights that minimise mean logistic loss + penalty * |weights|, by accelerated proximal gradient steps."""
    a1 = np.concatenate([np.ones((len(a), 1), np.float32), a.astype(np.float32)], 1)
    v = np.random.default_rng(0).normal(size=a1.shape[1]).astype(np.float32)
    for _ in range(20):
        v = a1.T @ (a1 @ v)
        v /= np.linalg.norm(v)
    step = 4 * len(a1) / float(v @ (a1.T @ (a1 @ v)))
    w = z = np.zeros(a1.shape[1], np.float32)
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(a1 @ z)))
        new = z - step * (a1.T @ (p - y)) / len(y)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z = (new + (last - 1) / t * (new - w)).astype(np.float32)
        w = new
    return float(w[0]), w[1:].astype(float)


def fit_rows(x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return RuleEnsemble(float(np.log(share / (1 - share))))
    rules = tree_rules(x, y)
    a = np.stack([holds(r, x) for r in rules], 1)
    base, weights = lasso_logistic(a, y)
    return RuleEnsemble(base, [(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-6])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> RuleEnsemble:
    """Learns label (column quality of labels: 0 or 1) from the texts of docs, on at most rows of them."""
    chosen = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    # the chosen rows are at most `rows` pairs of numbers
    marked = docs.join(F.broadcast(chosen), "doc_id")
    table = with_statistics(marked, ["quality"]).toPandas()
    return fit_rows(table[STATISTICS].to_numpy(float), table["quality"].to_numpy(float))


def scored(docs: DataFrame, model: RuleEnsemble, keep: list[str]) -> DataFrame:
    """The columns keep, score (0 to 1, high: good) and predicted."""
    rows = with_statistics(docs, keep).withColumn("score", model.column())
    return rows.select(*keep, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def held_out(doc_id: Column, parts: int = 3) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == 1, F.lit(False))
