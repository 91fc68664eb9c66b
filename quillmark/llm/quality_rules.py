"""Quality rules as a learned decision list over exact statistics of whole texts.

Rules are learned by sequential covering: each is grown on two thirds of the labelled rows, condition by condition, by
the gain in information over all thresholds of all statistics, and pruned on the rest, condition by condition from the
end; the rows that it covers are then taken away. What comes out is an ordered list of conjunctions of thresholds that
reads as one Spark conditional expression.

Everything is built from DataFrame functions. The driver sees histograms: one row for each value of each statistic, and
statistics are whole numbers from 0 to :data:`TOP`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

SPACE = "\\x20\\x09-\\x0D"
WINDOW = 5
#: Statistics end here; shares are parts of ten thousand.
TOP = 10_000
STATISTICS = ["words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "marks", "echoes"]
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Condition:
    statistic: str
    at_least: bool
    threshold: int

    def column(self) -> Column:
        return F.col(self.statistic) >= self.threshold if self.at_least else F.col(self.statistic) <= self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.at_least else '<='} {self.threshold}"


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns that are evaluated once for each row, however often later ones read them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, :data:`BASE` counts and :data:`STATISTICS` of every row.

    Words are runs of anything but ASCII white space; an echo is a word equal to the one before it. ``n_repeat_words`` counts words inside windows of five words that
    occur twice or more in the text, ``n_dup_lines`` lines with a word that equal an earlier one. Null texts count as
    empty; texts may have any length; repeated rows are judged each; other columns are not read. Windows are known by 64
    bits within their text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text = F.col("text")

    def left(pattern: str) -> Column:
        return F.length(F.regexp_replace(text, pattern, "")).cast("long")

    read = _once(
        rows,
        hashes=F.transform(F.array_remove(F.split(text, f"[{SPACE}]+"), ""), lambda w: F.xxhash64(w)),
        lines=F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]")),
        word_chars=left(f"[{SPACE}]+"),
        n_symbols=left("[^#*$%&|<>]+"),
        n_upper=left("[^\\p{Lu}]+"),
        n_digits=left("[^0-9]+"),
        n_marks=left(f"[\\p{{L}}\\p{{M}}\\p{{N}}{SPACE}]+"),
    ).drop("text")
    n = F.size("hashes")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("hashes", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    cut = _once(read, n_words=n.cast("long"), n_echoes=F.size(F.filter("hashes", lambda h, i: F.coalesce(F.when(i > 0, F.get("hashes", i - 1)) == h, F.lit(False)))).cast("long"), n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"), windows=windows).drop("hashes", "lines")
    # only texts with a repeated window sort theirs
    places = F.when(F.size("windows") > F.size(F.array_distinct("windows")), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h: bigint, i: int>>"))
    ordered = _once(cut, places=places).drop("windows")
    at = F.col("places")
    twice = F.filter(at, lambda x, k: F.coalesce(F.when(k > 0, F.get(at, k - 1)["h"]) == x["h"], F.lit(False)) | F.coalesce(F.get(at, k + 1)["h"] == x["h"], F.lit(False)))
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(starts, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n")), lambda a: a["n"])
    counted = _once(ordered, n_repeat_words=covered.cast("long")).drop("places")

    def share(part: str, whole: str, times: int = TOP) -> Column:
        return F.coalesce(F.least(F.expr(f"cast(try_divide({part} * {times}L, {whole}) as bigint)"), F.lit(TOP)), F.lit(0)).cast("long")

    return counted.select(
        "doc_id",
        *BASE,
        F.least("n_words", F.lit(TOP)).cast("long").alias("words"),
        share("word_chars", "n_words", 100).alias("word_length"),
        share("n_symbols", "word_chars").alias("symbols"),
        share("n_dup_lines", "n_words").alias("dup_lines"),
        share("n_repeat_words", "n_words").alias("repeats"),
        share("n_upper", "word_chars").alias("upper"),
        share("n_digits", "word_chars").alias("digits"),
        share("n_marks", "word_chars").alias("marks"),
        share("n_echoes", "n_words").alias("echoes"),
    )


def _gain(p: int, n: int, before: float) -> float:
    return p * (math.log2(p / (p + n)) - before) if p else 0.0


def best_condition(histogram: list[tuple[str, int, int, int]]) -> tuple[float, Condition | None]:
    """The threshold with the largest gain in information from rows (statistic, value, bad, good); ties go to the first
    statistic by name, then to "at least", then to the smaller threshold."""
    by: dict[str, list[tuple[int, int, int]]] = {}
    for name, value, bad, good in sorted(histogram):
        by.setdefault(name, []).append((value, bad, good))
    best: tuple[float, Condition | None] = (1e-9, None)
    for name, values in by.items():
        bad, good = sum(v[1] for v in values), sum(v[2] for v in values)
        if not bad or not good:
            return 0.0, None
        before, p, n = math.log2(bad / (bad + good)), 0, 0
        above, below = [], []
        for value, b, g in values:
            above.append((_gain(bad - p, good - n, before), Condition(name, True, value)))
            p, n = p + b, n + g
            below.append((_gain(p, n, before), Condition(name, False, value)))
        for gain, condition in above + below:
            if gain > best[0] * (1 + 1e-12):
                best = gain, condition
    return best


def learn(labelled: DataFrame, max_rules: int = 12, max_conditions: int = 4, least_precision: float = 0.9, least_bad: int = 3) -> list[list[Condition]]:
    """Rules for bad rows, in order, from rows with :data:`STATISTICS`, ``bad`` (boolean) and ``prunes`` (boolean: the
    row is held back for pruning).

    A rule ends the list when it covers fewer than ``least_bad`` bad rows among those held back, or when of the rows that
    it covers there fewer than ``least_precision`` are bad. Tables without bad rows, or without good ones, give no rule.
    """
    rules: list[list[Condition]] = []
    left = F.lit(True)
    tall = F.explode(F.map_from_arrays(F.array(*[F.lit(s) for s in STATISTICS]), F.array(*STATISTICS))).alias("statistic", "value")
    count = [F.sum(F.col("bad").cast("long")).alias("b"), F.sum((~F.col("bad")).cast("long")).alias("g")]
    while len(rules) < max_rules:
        rule: list[Condition] = []
        rest = labelled.where(left)
        while len(rule) < max_conditions:
            covered = rest.where(~F.col("prunes"))
            for c in rule:
                covered = covered.where(c.column())
            histogram = covered.select("bad", tall).groupBy("statistic", "value").agg(*count)
            _, found = best_condition([tuple(r) for r in histogram.collect()])  # at most a row for each statistic and value
            if found is None:
                break
            rule.append(found)
        if not rule:
            break
        reach = sum((_all(rule[:n]).cast("int") for n in range(1, len(rule) + 1)), F.lit(0))  # conditions that hold, from the first on
        held = {r[0]: (r[1], r[2]) for r in rest.where("prunes").groupBy(reach.alias("reach")).agg(*count).collect()}
        worth = []
        for n in range(1, len(rule) + 1):
            p, q = (sum(v[k] for at, v in held.items() if at >= n) for k in (0, 1))
            worth.append(((p - q) / (p + q) if p + q else -1.0, -n, p, q))
        _, n, p, q = max(worth)
        if p < least_bad or p < least_precision * (p + q):
            break
        rules.append(rule[:-n])
        left = left & ~_all(rules[-1])
    return rules


def _all(conditions: list[Condition]) -> Column:
    out = conditions[0].column()
    for c in conditions[1:]:
        out = out & c.column()
    return out


def decision(rules: list[list[Condition]]) -> Column:
    """The number (from 1) of the first rule that a row of statistics meets, or null: one conditional expression."""
    out = F.lit(None).cast("int")
    for n in range(len(rules), 0, -1):
        out = F.when(_all(rules[n - 1]), F.lit(n)).otherwise(out)
    return out


def labelled_statistics(found: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Statistics of labelled rows, whether they are bad (label 0; the smallest label of a document counts) and whether
    they are held back for pruning: a third, by a checksum of the id. Null ids and labels are left out."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    verdicts = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    prunes = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return found.join(verdicts, "doc_id").select(*STATISTICS, (F.col("label") == 0).alias("bad"), prunes.alias("prunes"))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **learning) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, :data:`BASE`, base_failed, kept, rule, rules.

    ``base_failed``: fewer than ten words, or more than a fifth of them in repeated windows. ``kept`` is false for those
    and for rows that a learned rule covers; ``rule`` is that rule's number and ``rules`` the list as text. All labelled
    rows are learned from, by their texts' statistics alone; without labels nothing is learned. Null, empty and repeated
    rows and extra columns are handled as :func:`statistics` says; an empty table gives an empty result.
    """
    found = stored(statistics(docs, id_col, text_col), "statistics")
    rules = learn(stored(labelled_statistics(found, labels, id_col, label_col), "labelled"), **learning)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = found.select("doc_id", *BASE, failed.alias("base_failed"), decision(rules).alias("rule"))
    said = "; ".join(" and ".join(map(str, r)) for r in rules)
    return judged.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule", F.lit(said).alias("rules"))
