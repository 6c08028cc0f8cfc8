"""Quality rules: fixed base statistics, and a decision list learned by sequential covering. DataFrame operations only.

Statistics are expressions over a document's own row: words, windows of words and lines are arrays, repeated windows are found by
sorting the windows' hashes with their places. No row is moved to compute them.

Learning. A bounded sample of labelled documents (the `max_rows` smallest hashes of labelled ids) gives rows of statistics and labels. Rules
are conjunctions of thresholds with an outcome, reject or keep. For either outcome a rule grows on two thirds of the sample by the condition of the
largest FOIL gain until it covers no document of the other label, and is pruned from its end on the other third. The one that is more precise
there (reject on a tie) is next in the list if it is precise enough; what it covers is removed, and the next rules grow on the rest. So a rule
speaks only of what those before it leave, and order counts. Learning ends when what is left is of one label or no precise rule is left. The list
becomes an ordered Spark conditional expression. What no rule covers is kept, unless all that is left of the sample is to be rejected: then a
last rule without conditions says so.

Edge cases: a null text has no words and fails the base; repeated rows give repeated rows; a null doc_id is kept and has no label; with no
labels, or one kind only, the list is empty and the base decides; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = "[\\x20\\x09-\\x0D]+"
TRIM = " \t\n\x0b\x0c\r"
WINDOW = 5
#: What rules may look at: ratios of the statistics, so that a threshold means the same for short and long texts.
FEATURES = ("n_words", "mean_word", "symbols_a_word", "repeats_a_word", "dup_lines_a_line", "upper_a_char", "bangs_a_word", "distinct_words_a_word")


def _let(value: Column, use) -> Column:  # noqa: ANN001
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(windows: Column) -> Column:
    """Words that lie in a window whose hash comes twice or more, from the hashes of all windows in order."""

    def covered(ranked: Column) -> Column:
        last = F.size(ranked) - 1

        def twin(k: Column) -> Column:
            own = ranked[k]["h"]
            return ((k > 0) & (ranked[F.greatest(k - 1, F.lit(0))]["h"] == own)) | ((k < last) & (ranked[F.least(k + 1, last)]["h"] == own))

        places = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), last), twin), lambda k: ranked[k]["i"]))
        # Windows that begin less than WINDOW words apart share words.
        return _let(places, lambda p: F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(WINDOW).cast("long"), lambda s, k: s + F.least(F.lit(WINDOW), p[k] - p[k - 1])))

    return _let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered)


def text_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of `keep` and the statistics of column `text`: base ones and FEATURES."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = F.btrim(F.col("__text"), F.lit(TRIM))
    length = lambda c: F.length(c).cast("long")
    at = docs.select(*keep, text.alias("__text"))
    at = at.select(*keep, "__text", bare.alias("__bare"))
    at = at.select(*keep, "__text", F.when(F.col("__bare") == "", F.array().cast("array<string>")).otherwise(F.split("__bare", SPACES)).alias("__words"))
    lines = F.filter(F.split("__text", "\n"), lambda x: F.btrim(x, F.lit(TRIM)) != "")
    at = at.select(
        *keep,
        "__text",
        F.size("__words").cast("long").alias("n_words"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__hashes"),
        lines.alias("__lines"),
        length(F.regexp_replace("__text", SPACES, "")).alias("word_chars"),
        length(F.regexp_replace("__text", "[^#*$%&|<>]+", "")).alias("n_symbols"),
        length(F.regexp_replace("__text", "[^A-Z]+", "")).alias("__upper"),
        length(F.regexp_replace("__text", "[^!]+", "")).alias("__bangs"),
    )
    rest = [c for c in at.columns if c not in ("__text", "__lines", "__hashes")]
    hashes = F.col("__hashes")
    windows = F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW), lambda i: F.xxhash64(*[hashes[i + k] for k in range(WINDOW)]))).otherwise(F.array().cast("array<long>"))
    at = at.select(
        *rest,
        windows.alias("__windows"),
        F.size(F.array_distinct(hashes)).alias("__distinct"),
        F.size("__lines").alias("__n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
    )
    windows = F.col("__windows")
    repeats = F.when(F.size(F.array_distinct(windows)) < F.size(windows), _repeat_words(windows)).otherwise(F.lit(0)).cast("long")
    at = at.select(*[c for c in at.columns if c != "__windows"], repeats.alias("n_repeat_words"))
    a_word = F.greatest(F.col("n_words"), F.lit(1))
    return at.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (F.col("word_chars") / a_word).alias("mean_word"),
        (F.col("n_symbols") / a_word).alias("symbols_a_word"),
        (F.col("n_repeat_words") / a_word).alias("repeats_a_word"),
        (F.col("n_dup_lines") / F.greatest(F.col("__n_lines"), F.lit(1))).alias("dup_lines_a_line"),
        (F.col("__upper") / F.greatest(F.col("word_chars"), F.lit(1))).alias("upper_a_char"),
        (F.col("__bangs") / a_word).alias("bangs_a_word"),
        (F.col("__distinct") / a_word).alias("distinct_words_a_word"),
    )


BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        own = F.col(self.feature)
        return own >= self.threshold if self.at_least else own <= self.threshold

    def holds(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        own = rows[self.feature]
        return own >= self.threshold if self.at_least else own <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<='} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    """All conditions together (none: always), and what becomes of a text for which they hold."""

    conditions: tuple[Condition, ...]
    keep: bool

    def column(self) -> Column:
        holds = F.lit(True)
        for c in self.conditions:
            holds = holds & c.column()
        return holds

    def holds(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        found = np.ones(len(rows[FEATURES[0]]), bool)
        for c in self.conditions:
            found &= c.holds(rows)
        return found

    def __str__(self) -> str:
        return f"{'keep' if self.keep else 'reject'} if {' and '.join(map(str, self.conditions)) or 'nothing else holds'}"


def best_condition(rows: dict[str, np.ndarray], wanted: np.ndarray, inside: np.ndarray, cuts: int) -> Condition | None:
    """The condition of the largest FOIL gain among thresholds at quantiles of what is inside, or None if none gains."""
    p, n = int((inside & wanted).sum()), int((inside & ~wanted).sum())
    best = (0.0, None)
    for feature in FEATURES:
        own, hit = rows[feature][inside], wanted[inside]
        edges = np.unique(np.concatenate([np.quantile(own, np.linspace(0, 1, cuts + 1)), np.quantile(own[hit], np.linspace(0, 1, cuts // 2 + 1))]))
        order = np.sort(own[hit]), np.sort(own[~hit])
        for at_least in (True, False):
            pos, neg = (np.searchsorted(o, edges, "left" if at_least else "right") for o in order)
            pos, neg = (len(order[0]) - pos, len(order[1]) - neg) if at_least else (pos, neg)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pos > 0, pos * (np.log2(pos / (pos + neg)) - np.log2(p / (p + n))), -1)
            k = int(np.argmax(gain))
            if gain[k] > best[0] + 1e-12:
                best = (float(gain[k]), Condition(feature, at_least, float(edges[k])))
    return best[1]


def grow_rule(rows: dict[str, np.ndarray], wanted: np.ndarray, left: np.ndarray, grow: np.ndarray, most_conditions: int, cuts: int) -> tuple[list[Condition], tuple[float, int]]:
    """Conditions for the rows that are wanted, pruned, and their worth on the rows that they did not grow on: precision and wanted rows covered."""
    found: list[Condition] = []
    inside = left & grow
    while len(found) < most_conditions and (inside & wanted).any() and (inside & ~wanted).any():
        best = best_condition(rows, wanted, inside, cuts)
        if best is None:
            break
        found.append(best)
        inside &= best.holds(rows)

    def worth(conditions: list[Condition]) -> tuple[float, int]:
        covered = np.logical_and.reduce([c.holds(rows) for c in conditions]) & left & ~grow
        p, n = int((covered & wanted).sum()), int((covered & ~wanted).sum())
        return (p / (p + n) if p else 0.0, p)

    while len(found) > 1 and worth(found[:-1]) >= worth(found):
        found.pop()
    return found, worth(found) if found else (0.0, 0)


def learn_rules(rows: dict[str, np.ndarray], good: np.ndarray, grow: np.ndarray, most_rules: int = 12, most_conditions: int = 4, precision: float = 0.95, cuts: int = 48) -> list[Rule]:
    """Sequential covering; `grow` marks the rows that rules grow on, the others prune and judge them."""
    left, rules = np.ones(len(good), bool), []
    while len(rules) < most_rules and (left & grow & ~good).any() and (left & grow & good).any():
        either = [(*grow_rule(rows, good if keep else ~good, left, grow, most_conditions, cuts), keep) for keep in (False, True)]
        able = [(worth[0], not keep, found) for found, worth, keep in either if found and worth[0] >= precision]
        if not able:
            break
        _, reject, found = max(able, key=lambda x: x[:2])
        rule = Rule(tuple(found), not reject)
        rules.append(rule)
        left &= ~rule.holds(rows)
    if rules and rules[-1].keep and (left & ~grow & ~good).any() and not (left & good).any():
        rules.append(Rule((), False))
    while rules and rules[-1].keep:  # what no rule covers is kept anyway
        rules.pop()
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> list[Rule]:
    """Learns from at most max_rows labelled documents: those of the smallest hashes of doc_id. labels: doc_id, quality."""
    known = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")  # at most max_rows rows
    names = list(dict.fromkeys([*FEATURES, "n_repeat_words"]))
    found = text_stats(joined, ["doc_id", "quality"]).select("doc_id", "quality", *names).orderBy(F.xxhash64("doc_id"), *names).limit(max_rows).collect()
    rows = {n: np.array([r[n] for r in found], float) for n in names}
    good = np.array([r["quality"] == 1 for r in found], bool)
    passed = ~((rows["n_words"] < 10) | (100 * rows["n_repeat_words"] > 20 * rows["n_words"]))  # what fails the base needs no rule
    grow = np.array([r["doc_id"] % 3 != 0 for r in found], bool)
    return learn_rules({n: v[passed] for n, v in rows.items()}, good[passed], grow[passed]) if passed.any() else []


def verdict(rules: list[Rule]) -> Column:
    """The decision list: the base rejects first, then the first rule that holds decides; a text that none holds for is kept."""
    found = F.when(F.expr(BASE_FAILED), False)
    for rule in rules:
        found = found.when(rule.column(), rule.keep)
    return found.otherwise(True)


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Per document: doc_id, the base statistics, base_failed, kept."""
    stats = text_stats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"])
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.expr(BASE_FAILED).alias("base_failed"), verdict(rules).alias("kept"))


def keep_good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents (all columns) that the list keeps."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    row = docs.select(F.struct(*own).alias("__row"), F.col("text"))
    # The row number makes the verdict one that the planner doesn't push below: pushed down, each statistic would be
    # spelt out anew wherever the condition names it, and computed anew for every word.
    judged = text_stats(row, ["__row"]).select("__row", (verdict(rules) & (F.monotonically_increasing_id() >= 0)).alias("__kept"))
    return judged.where("__kept").select("__row.*")
