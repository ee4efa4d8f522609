"""Quality rules as a learned decision list, in DataFrame expressions only.

Base statistics of a text are array expressions inside one row, so nothing is
shuffled. The list is learned by sequential covering (grow on two thirds of
the labelled rows, prune on the rest): a rule is a conjunction of thresholds,
grown by FOIL gain from per-bin label counts that Spark aggregates, cut back
while that raises its worth on the pruning rows, and emitted as one branch of
a Spark CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm._common import WORD, let, materialise, unused, words

SYMBOLS = "[#*$%&|<>]"
#: Marks that shouted text repeats; counted beside SYMBOLS.
SHOUTS = "!"
CAPITALS = "[A-Z]"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Ratios the rules are learned on; each is comparable between short and long texts.
FEATURES = [
    "symbols_per_word", "shouts_per_word", "repeat_share", "dup_lines_per_word", "mean_word_length",
    "capitals_share",
]


def _repeat_words(ws: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    A window becomes one long: hash bits above, its place below. Sorted longs
    put equal windows side by side; a neighbour with the same hash bits is
    compared word by word, and the covered places are counted."""
    count = F.greatest(F.size(ws) - 2, F.lit(0))
    hashes = F.transform(F.slice(ws, 1, count), lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))

    def same(i: Column, j: Column) -> Column:
        return (
            (F.get(ws, i) == F.get(ws, j))
            & (F.get(ws, i + 1) == F.get(ws, j + 1))
            & (F.get(ws, i + 2) == F.get(ws, j + 2))
        )

    def covered(hs: Column) -> Column:
        bits = F.length(F.bin(F.size(hs)))
        place_mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        packed = let(
            bits,
            lambda b: F.transform(hs, lambda h, i: F.call_function("shiftleft", h, b).bitwiseOR(i.cast("long"))),
        )

        def find(ordered: Column) -> Column:
            def beside(x: Column, y: Column, mask: Column) -> Column:
                alike = x.bitwiseXOR(y) <= mask
                place = lambda v: v.bitwiseAND(mask).cast("int")
                return F.coalesce(alike & (x.bitwiseXOR(y) >= 0) & same(place(x), place(y)), F.lit(False))

            return let(
                place_mask,
                lambda mask: F.transform(
                    F.filter(
                        ordered,
                        lambda x, i: beside(x, F.get(ordered, i + 1), mask) | beside(x, F.get(ordered, i - 1), mask),
                    ),
                    lambda x: x.bitwiseAND(mask),
                ),
            )

        places = let(F.sort_array(packed), find)
        return F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(p, p + 1, p + 2)))))

    return let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), 0).otherwise(covered(hs)))


def base_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus the columns BASE, shouts and capitals (long), which replace
    columns of these names. Null text counts as empty: all zero."""
    docs = docs.drop(*[c for c in docs.columns if c in (*BASE, "shouts", "capitals")])
    of_text, of_lines = unused(docs, "of_text"), unused(docs, "of_lines")
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))

    def of_words(ws: Column) -> Column:
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.char_length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            _repeat_words(ws).cast("long").alias("n_repeat_words"),
        )

    stats = docs.withColumn(of_text, let(words(F.col(text_col)), of_words)).withColumn(
        of_lines, let(lines, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long"))
    )
    return stats.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.col(of_text)["n_words"].alias("n_words"),
        F.col(of_text)["word_chars"].alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.col(of_lines).alias("n_dup_lines"),
        F.col(of_text)["n_repeat_words"].alias("n_repeat_words"),
        F.regexp_count(text, F.lit(SHOUTS)).cast("long").alias("shouts"),
        F.regexp_count(text, F.lit(CAPITALS)).cast("long").alias("capitals"),
    )


def features(stats: DataFrame) -> DataFrame:
    """The columns FEATURES beside the statistics; 0 for a text without words."""
    per = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return stats.withColumns(
        {
            "symbols_per_word": F.col("n_symbols") / per,
            "shouts_per_word": F.col("shouts") / per,
            "repeat_share": F.col("n_repeat_words") / per,
            "dup_lines_per_word": F.col("n_dup_lines") / per,
            "mean_word_length": F.col("word_chars") / per,
            "capitals_share": F.col("capitals") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"),
        }
    )


def base_failed() -> Column:
    """Too short, or more than half of the words lie in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """``feature >= threshold`` (or ``<``)."""

    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value >= F.lit(self.threshold) if self.at_least else value < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


@dataclass
class Rule:
    conditions: list[Condition] = field(default_factory=list)

    def column(self) -> Column:
        test = F.lit(True)
        for c in self.conditions:
            test = test & c.column()
        return test


@dataclass
class DecisionList:
    """Ordered rejecting rules; a text that none fits is kept."""

    rules: list[Rule] = field(default_factory=list)

    def rule_number(self) -> Column:
        """1-based number of the first rule that fits, null if none does."""
        first = F.lit(None).cast("int")
        for n, rule in reversed(list(enumerate(self.rules, 1))):
            first = F.when(rule.column(), F.lit(n)).otherwise(first)
        return first

    def verdict(self) -> Column:
        """CASE expression: false at the first rule that fits, else true."""
        return self.rule_number().isNull()

    def __str__(self) -> str:
        return "\n".join(" and ".join(map(str, r.conditions)) for r in self.rules)


def learn(
    labelled: DataFrame,
    label_col: str = "quality",
    feature_cols: list[str] | None = None,
    max_rules: int = 8,
    max_conditions: int = 3,
    bins: int = 64,
    min_precision: float = 0.9,
    min_support: int = 3,
) -> DecisionList:
    """Learn rules for rows whose label is 0.

    ``labelled`` has the feature columns and a label of 0 (to reject) or 1;
    rows with a null label or feature take no part. The driver sees only counts
    per (feature, bin, label): at most features x bins x 2 rows a step. No
    rejected label, or none that a rule of ``min_precision`` on the pruning
    rows can tell, gives an empty list.
    """
    cols = feature_cols or FEATURES
    rows = labelled.where(F.col(label_col).isin(0, 1)).dropna(subset=cols)
    fold = F.pmod(F.xxhash64(*[F.col(c) for c in cols]), F.lit(3))
    rows = materialise(rows.select(*cols, F.col(label_col).cast("int").alias("y"), (fold > 0).alias("grow")), "labelled")
    edges = rows.agg(
        *[F.percentile_approx(c, [i / bins for i in range(1, bins)], 1000).alias(c) for c in cols]
    ).first()
    cuts = {c: sorted(set(edges[c])) if edges[c] else [] for c in cols}
    found = DecisionList()
    left = rows
    while len(found.rules) < max_rules:
        rule = _grow(left.where("grow"), cuts, max_conditions)
        rule = _prune(left.where("not grow"), rule)
        if not rule.conditions:
            break
        bad, good = _covered(left.where("not grow"), [rule])[0]
        if bad < min_support or bad < min_precision * (bad + good):
            break
        found.rules.append(rule)
        left = left.where(~rule.column())
    return found


def _grow(rows: DataFrame, cuts: dict[str, list[float]], max_conditions: int) -> Rule:
    rule = Rule()
    while len(rule.conditions) < max_conditions:
        here = rows.where(rule.column())
        counted = here.select(
            "y",
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(c).alias("feature"), _bin(c, cuts[c]).alias("bin"))
                        for c in cuts
                    ]
                )
            ).alias("b"),
        )
        counts = counted.groupBy("b.feature", "b.bin").agg(
            F.sum(F.when(F.col("y") == 0, 1).otherwise(0)).alias("bad"),
            F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("good"),
        )
        table: dict[str, dict[int, tuple[int, int]]] = {}
        for r in counts.collect():  # features x bins rows
            table.setdefault(r["feature"], {})[r["bin"]] = (r["bad"], r["good"])
        step = _best_condition(table, cuts)
        if step is None:
            break
        rule.conditions.append(step[0])
        if step[1] == 0:
            break
    return rule


def _bin(feature: str, cuts: list[float]) -> Column:
    """How many cuts the value reaches."""
    reached = F.filter(F.array(*[F.lit(float(x)) for x in cuts]).cast("array<double>"), lambda x: x <= F.col(feature))
    return F.size(reached)


def _best_condition(
    table: dict[str, dict[int, tuple[int, int]]], cuts: dict[str, list[float]]
) -> tuple[Condition, int] | None:
    """The condition of the largest FOIL gain, and the good rows it leaves."""
    best, best_gain = None, 1e-9
    for feature, by_bin in sorted(table.items()):
        bad = sum(b for b, _ in by_bin.values())
        good = sum(g for _, g in by_bin.values())
        if not bad or not good:
            return None
        start = math.log2(bad / (bad + good))
        below_bad = below_good = 0
        for i, cut in enumerate(cuts[feature]):
            b, g = by_bin.get(i, (0, 0))
            below_bad, below_good = below_bad + b, below_good + g
            for at_least, p, n in ((False, below_bad, below_good), (True, bad - below_bad, good - below_good)):
                if p and (gain := p * (math.log2(p / (p + n)) - start)) > best_gain:
                    best, best_gain = (Condition(feature, at_least, float(cut)), n), gain
    return best


def _prune(rows: DataFrame, rule: Rule) -> Rule:
    """The prefix of the rule with the largest (bad - good) / (bad + good) on the pruning rows."""
    prefixes = [Rule(rule.conditions[:n]) for n in range(1, len(rule.conditions) + 1)]
    if not prefixes:
        return rule
    worth = [(b - g) / (b + g) if b + g else -1.0 for b, g in _covered(rows, prefixes)]
    return prefixes[max(range(len(worth)), key=lambda i: (worth[i], -i))]


def _covered(rows: DataFrame, rules: list[Rule]) -> list[tuple[int, int]]:
    sums = []
    for i, r in enumerate(rules):
        for y in (0, 1):
            sums.append(F.coalesce(F.sum(F.when(r.column() & (F.col("y") == y), 1)), F.lit(0)).alias(f"c{i}_{y}"))
    row = rows.agg(*sums).first()
    return [(row[f"c{i}_0"], row[f"c{i}_1"]) for i in range(len(rules))]


def fit(
    docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, id_col: str = "doc_id", **options
) -> DecisionList:
    """Learn from at most ``max_labelled`` labelled documents (those of the
    smallest hash of their id), a documented bound of the fitting sample; that
    list of ids is small by this bound and is broadcast. Ids with labels that
    differ, null ids and null labels take no part; repeated ids of ``docs`` count
    once each; no labels or no documents give an empty list."""
    picked = (
        labels.where(F.col(id_col).isNotNull() & F.col("quality").isin(0, 1))
        .groupBy(id_col)
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("__high"))
        .where("quality = __high")
        .select(id_col, "quality")
        .orderBy(F.xxhash64(id_col), id_col)
        .limit(max_labelled)
    )
    # written first: else the base test is pushed below the join, over every document
    texts = materialise(docs.select(id_col, "text").join(F.broadcast(picked), id_col), "labelled-texts")
    # texts that fail the base test need no rule
    return learn(features(base_statistics(texts)).where(~base_failed()), "quality", **options)


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """``docs`` plus BASE, FEATURES, base_failed, rule (the first rule that
    fits, else null) and kept. A column of ``docs`` of one of these names is
    replaced. Null and empty texts fail the base test."""
    made = {*BASE, *FEATURES, "shouts", "capitals", "base_failed", "rule", "kept"}
    clean = docs.drop(*[c for c in docs.columns if c in made])
    scored = features(base_statistics(clean)).withColumn("base_failed", base_failed())
    scored = scored.withColumn("rule", rules.rule_number())
    return scored.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
