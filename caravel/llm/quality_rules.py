"""Learned decision lists for quality, in DataFrame operations only.

Sequential covering: rules are conjunctions of thresholds on a document's statistics. A rule grows by the condition with the best gain on
two thirds of a labelled sample, is pruned on the other third, and what it covers leaves both. The list becomes one ordered conditional
expression. Each step is one small aggregation over the sample's statistics; no row of it reaches Python.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_id, keyed, materialize

SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = "#*$%&|<>"
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "distinct_share", "digit_share")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(w: Column) -> Column:
    """Words in 5-word windows found twice or more, the first time included."""

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def again(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            at = F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))
            return _let(at, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(p, k + 1) - x, F.lit(5)))), F.lit(0), lambda a, x: a + x))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(ordered, again))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))
    return F.when(F.size(w) < 6, F.lit(0)).otherwise(_let(windows, covered))


def statistics(docs: DataFrame) -> DataFrame:
    """(id, t, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the shares that rules look at, from whole texts."""
    text = F.col("text")
    without = lambda chars: F.char_length(text) - F.char_length(F.translate(text, chars, ""))
    w = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    out = docs.select(
        "id", "t", F.char_length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"), without(SYMBOLS).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), _let(lines, lambda x: F.size(x)).alias("n_lines"),
        _let(w, lambda x: F.struct(F.size(x).cast("long").alias("n"), _repeat_words(x).cast("long").alias("r"), F.size(F.array_distinct(x)).alias("d"))).alias("w"),
        without(UPPER).alias("upper"), without("!?").alias("marks"), without("0123456789").alias("digits"),
    )
    out = out.select("*", F.col("w.n").alias("n_words"), F.col("w.r").alias("n_repeat_words"))
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return out.select(
        "id", "t", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", share("word_chars", "n_words").alias("mean_word"), share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"), share("upper", "word_chars").alias("upper_share"),
        share("marks", "n_words").alias("mark_share"), (F.col("w.d") / F.greatest("n_words", F.lit(1))).alias("distinct_share"), share("digits", "word_chars").alias("digit_share"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return (F.col(self.feature) > self.threshold) if self.above else (F.col(self.feature) <= self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Documents that any rule covers are rejected; rules are tried in order."""

    rules: list[list[Condition]] = field(default_factory=list)

    def rejected(self) -> Column:
        out = F.lit(False)
        for rule in reversed(self.rules):
            out = F.when(_all(rule), F.lit(True)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join(f"WHEN {' AND '.join(map(str, r))} THEN reject" for r in self.rules)


def _all(rule: list[Condition]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def _counts(rows: DataFrame, tests: list[Column]) -> list[tuple[int, int]]:
    """(bad, good) rows that pass each test, in one aggregation."""
    if not tests:
        return []
    passed = rows.select("bad", F.explode(F.filter(F.array(*[F.when(t, F.lit(i)).otherwise(F.lit(-1)) for i, t in enumerate(tests)]), lambda x: x >= 0)).alias("test"))
    found = {r["test"]: (r["b"], r["g"]) for r in passed.groupBy("test").agg(F.sum("bad").alias("b"), F.sum(1 - F.col("bad")).alias("g")).collect()}
    return [found.get(i, (0, 0)) for i in range(len(tests))]


def learn(rows: DataFrame, max_rules: int = 6, max_conditions: int = 3, cuts: int = 16, precision: float = 0.9, min_cover: int = 5) -> DecisionList:
    """From rows (bad 0/1, part 0-2, FEATURES): part 2 prunes, the others grow."""
    quantiles = rows.agg(*[F.percentile_approx(f, [(i + 0.5) / cuts for i in range(cuts)], 2000).alias(f) for f in FEATURES]).first()
    candidates = [Condition(f, above, float(t)) for f in FEATURES for t in sorted(set(quantiles[f] or [])) for above in (True, False)]
    out = DecisionList()
    while len(out.rules) < max_rules:
        left = rows.where(~out.rejected())
        grow, prune = left.where("part < 2"), left.where("part = 2")
        rule: list[Condition] = []
        best = (0.0, 0)
        while len(rule) < max_conditions:
            counts = _counts(grow.where(_all(rule)), [c.column() for c in candidates])
            # Laplace precision first, then coverage
            scored = [((b + 1) / (b + g + 2), b, i) for i, (b, g) in enumerate(counts) if b >= min_cover]
            if not scored:
                break
            p, b, i = max(scored, key=lambda x: (x[0] * (x[1] ** 0.1), x[1]))
            if p <= best[0] + 1e-3:
                break
            rule.append(candidates[i])
            best = (p, b)
        if not rule:
            break
        shorter = [rule[:k] for k in range(1, len(rule) + 1)]
        kept = max(zip(_counts(prune, [_all(r) for r in shorter]), shorter, strict=True), key=lambda x: ((x[0][0] + 1) / (x[0][0] + x[0][1] + 2), x[0][0]))
        (b, g), rule = kept
        if b < 2 or b / (b + g) < precision:
            break
        out.rules.append(rule)
    return out


def base_failed(min_words: int = 10, max_repeat: int = 20) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))


def quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 20_000) -> tuple[DataFrame, DecisionList]:
    """(doc_id, t, the statistics, base_failed, kept) per row of df, and the list that decided.

    The list is learned from about `sample` labelled ids that pass the base rules, chosen by a hash of the id. Without labels it is empty
    and the base rules decide alone. Null and empty texts have no words and fail; null ids stay null; repeated rows get equal verdicts;
    other columns are ignored; an empty table gives no rows; texts of any length are counted whole. Of conditions that tie, the first in
    the order of FEATURES and thresholds is taken.
    """
    y = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).alias("y"))
    n = y.count()
    if n > sample:
        y = y.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    docs = keyed(df, id_col, text_col)
    rows = statistics(docs.join(F.broadcast(y.select("id")), "id", "left_semi"))  # about `sample` ids at most
    rows = rows.where(~base_failed()).join(y, "id").select((1 - F.col("y")).cast("long").alias("bad"), F.pmod(F.xxhash64("id", F.lit(5)), F.lit(3)).alias("part"), *FEATURES)
    rules = learn(materialize(rows.repartition(8), "quality-sample"))  # numbers of the sample only
    out = statistics(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~(F.col("base_failed") | rules.rejected()))
    return out.withColumn("doc_id", doc_id()).drop("id"), rules
