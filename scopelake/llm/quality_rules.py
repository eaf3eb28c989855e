"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

The features of a text are computed inside its row, so no text is ever shuffled.  The
cascade first measures every rule on a bounded sample of rows, the first by a hash of
their doc_id, whatever the length of their texts: its cost (seconds of a job that
evaluates it alone and over and over, less those of a job that evaluates nothing) and its
selectivity (share rejected).  Rules are then nested in one CASE expression, highest
rejection per cost first, and a row stops at the first rule that rejects it.  Rules only
read the row, so their order changes the time and never the verdict.

Repeated windows of three words are found by their 64-bit hashes: where all differ there
are none; else by one sort of numbers that hold a hash and the window's place; words are compared wherever hashes are equal, and a
text where equal hashes meet unequal words is done again by the words themselves.

Defined results: a null or blank text has no words, all features 0 and fails the base
test.  A text without symbols or repeats has zeros there.  Texts of any length count
whole.  Extra columns of the input are ignored; repeated rows give repeated results; an
empty table gives no rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scopelake.llm.common import words_of, written

#: Rows of the sample that only orders the rules, and how often each is evaluated to rise above the cost of a job.
SAMPLE_ROWS, REPEATS = 400, 4


@dataclass(frozen=True)
class Rule:
    """rejects: a boolean expression over the feature columns and ``text``."""

    name: str
    rejects: Column


def features(docs: DataFrame, window_hash: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """doc_id, text, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words; any window_hash gives the same."""
    text = F.coalesce(F.col("text"), F.lit(""))
    a = docs.select("doc_id", text.alias("text")).withColumn("_w", words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    windows = F.slice("_w", 1, F.greatest(F.size("_w") - 2, F.lit(0)))
    # a place takes as many low bits as the text needs; hashes fill the others
    bits = F.greatest(F.lit(1), F.ceil(F.log2(F.size("_w") + 1))).cast("int")
    a = a.withColumns({"_l": lines, "_b": bits, "_h": F.transform(windows, lambda x, i: window_hash(x, F.get("_w", i + 1), F.get("_w", i + 2)))})
    # texts whose hashes all differ have no window twice, and nothing below is evaluated for them
    marked = lambda h, i: F.call_function("shiftleft", h, F.col("_b")).bitwiseOR(i.cast("long"))
    a = a.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", marked))))
    hashed = lambda x: F.call_function("shiftright", x, F.col("_b"))
    again = F.filter("_s", lambda x, k: F.coalesce(hashed(F.get("_s", k - 1)) == hashed(x), F.lit(False)) | F.coalesce(hashed(F.get("_s", k + 1)) == hashed(x), F.lit(False)))
    place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_b")) - 1).cast("int")
    a = a.withColumn("_e", again)
    a = a.withColumn("_p", F.transform("_e", place))
    # neighbours of one hash hold the same words, or the hash is not to be trusted in this text
    word = lambda k, o: F.get("_w", F.get("_p", k) + o)
    unequal = lambda x, k: (hashed(F.get("_e", k - 1)) == hashed(x)) & ~((word(k, 0) == word(k - 1, 0)) & (word(k, 1) == word(k - 1, 1)) & (word(k, 2) == word(k - 1, 2)))
    chance = F.exists(F.filter("_e", lambda x, k: F.coalesce(unequal(x, k), F.lit(False))), lambda x: F.lit(True))
    by_words = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("a"), F.get("_w", i + 1).alias("b"), F.get("_w", i + 2).alias("c"), i.alias("i"))))
    a = a.withColumn("_x", F.when(chance, by_words))
    same = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
    twice = F.filter("_x", lambda x, k: same(x, F.get("_x", k - 1)) | same(x, F.get("_x", k + 1)))
    a = a.withColumn("_p", F.sort_array(F.when(F.col("_x").isNotNull(), F.transform(twice, lambda x: x["i"])).otherwise(F.col("_p"))))
    covered = F.aggregate(
        F.transform("_p", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("_p", k + 1) - x, F.lit(3))).cast("long")),
        F.lit(0).cast("long"),
        lambda s, x: s + x,
    )
    return a.select(
        "doc_id",
        "text",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def default_rules() -> list[Rule]:
    """Thresholds in the style of published web-text filters."""
    n, text = F.col("n_words"), F.col("text")
    # what is left without the others: a match per run of others, not one per letter
    letters, capitals = (F.length(F.regexp_replace(text, p, "")) for p in (r"\P{L}+", r"\P{Lu}+"))
    return [
        Rule("mean_word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 12 * n)),
        Rule("symbols_per_word", 10 * F.col("n_symbols") > n),
        Rule("duplicate_lines", 2 * F.col("n_dup_lines") > F.col("n_lines")),
        Rule("few_letters", 10 * letters < 6 * F.col("word_chars")),
        Rule("shouting", 2 * capitals > letters),
        Rule("ellipsis_lines", 10 * F.regexp_count(text, F.lit("(?m)(\\.\\.\\.|…)[ \t\r]*$")) > 3 * F.greatest(F.col("n_lines"), F.lit(1))),
        Rule("bullet_lines", 10 * F.regexp_count(text, F.lit("(?m)^[ \t]*[-*•]")) > 9 * F.greatest(F.col("n_lines"), F.lit(1))),
    ]


def order_rules(featured: DataFrame, rules: list[Rule], repeats: int = REPEATS) -> list[tuple[Rule, float, float]]:
    """(rule, cost, selectivity) by rejection per cost, highest first; ties keep the given order.

    featured has the features of a sample; the sample decides nothing but the order.  A
    cost is the seconds of a job beyond the quickest of two that evaluate nothing, a
    millisecond at least; jobs run one at a time over the same rows, each row repeated.
    """
    sample = written(featured, "cascade-sample")
    share = sample.agg(*[F.coalesce(F.avg(r.rejects.cast("int")), F.lit(0.0)).alias(f"r{i}") for i, r in enumerate(rules)]).first()
    over = sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(repeats))))

    def seconds(what: Column) -> float:
        began = time.perf_counter()
        over.agg(F.count_if(what & (F.col("_again") > 0))).collect()
        return time.perf_counter() - began

    nothing = min(seconds(F.col("text").isNotNull()) for _ in range(2))
    measured = [(r, max(seconds(r.rejects) - nothing, 1e-3), float(share[i])) for i, r in enumerate(rules)]
    return sorted(measured, key=lambda m: -m[2] / m[1])


def cascade(ordered: list[Rule]) -> Column:
    """True for rows that no rule rejects; later rules run only where earlier ones pass."""
    verdict = None
    for r in ordered:
        rejects = F.coalesce(r.rejects, F.lit(False))
        verdict = F.when(rejects, F.lit(False)) if verdict is None else verdict.when(rejects, F.lit(False))
    return F.lit(True) if verdict is None else verdict.otherwise(F.lit(True))


def apply_rules(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs (doc_id, text) with features, base_failed and kept, one row per input row."""
    rules = default_rules() if rules is None else rules
    featured = features(docs)
    order = []
    if rules:
        chosen = docs.select(F.col("doc_id").alias("_id")).orderBy(F.xxhash64("_id"), "_id").limit(sample_rows).distinct()  # some hundred ids
        sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id").limit(sample_rows)
        order = [r for r, _, _ in order_rules(features(sample), rules)]
    judged = featured.withColumn("base_failed", base_failed())
    return judged.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(order)))
