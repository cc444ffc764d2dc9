"""Quality rules as weak supervision, in DataFrame operations only.

Each rule votes good (1), bad (-1) or abstains (0) on a text.  Expectation-maximisation over the counts of vote patterns (at
most 3^8 rows, whatever the corpus) estimates how often each rule is right when it votes; by Bayes' rule a text's
posterior log-odds are a sum over the votes, which is a column expression.  Two hard bounds
(`base_failed`) stand before it.

Defined results: null or empty texts have no words, fail the base and are not kept; very long texts are one row, whole in one task; a
posterior of just 0.5 is kept; rows are answered one by one, so repeated rows repeat; an empty table gives an empty result; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstrata.llm.common import let, split_words, spool

RULES = ("symbols", "symbol_runs", "plain_words", "capitals", "shouting", "repeats", "lines", "length")
#: EM starts from these accuracies of a vote, and counts them as HOLD votes that were seen before, which fade as the corpus grows; a rule
#: is never taken for worse than chance.
START = {"symbols": 0.9, "symbol_runs": 0.9, "plain_words": 0.8, "capitals": 0.9, "shouting": 0.9, "repeats": 0.9, "lines": 0.8, "length": 0.6}
GOOD_PRIOR, HOLD, LEAST, MOST, ROUNDS = 0.8, 200, 0.5, 0.99, 60


def repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more.  Windows are compared by 64-bit hashes."""

    def covered(grams: Column) -> Column:
        same = lambda j, step: F.coalesce(F.get(grams, j + step)["h"] == grams[j]["h"], F.lit(False))
        twice = F.filter(F.sequence(F.lit(0), F.size(grams) - 1), lambda j: same(j, -1) | same(j, 1))
        places = F.transform(twice, lambda j: F.array(grams[j]["i"], grams[j]["i"] + 1, grams[j]["i"] + 2))
        return F.size(F.array_distinct(F.flatten(places)))

    grams = lambda w: F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i"))))
    return let(words, lambda w: F.when(F.size(w) >= 3, let(grams(w), covered)).otherwise(0))


def features(docs: DataFrame) -> DataFrame:
    """doc_id and counts for each row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_line = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    by_word = let(split_words(text), lambda w: F.struct(F.size(w).alias("n_words"), repeat_words(w).alias("n_repeat_words")))
    counted = docs.select(
        "doc_id",
        by_word.alias("w"),
        by_line.alias("l"),
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).alias("n_upper"),
        F.regexp_count(text, F.lit(r"!")).alias("n_bang"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]{2,}")).alias("n_runs"),
        F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])[\p{L}'-]+[.,;:!?]?(?![^\x20\x09-\x0D])")).alias("n_plain"),
    )
    return counted.select("doc_id", *(F.col(f"w.{c}").cast("long").alias(c) for c in ("n_words", "n_repeat_words")), *(F.col(f"l.{c}").cast("long").alias(c) for c in ("n_lines", "n_dup_lines")), *(F.col(c).cast("long").alias(c) for c in ("word_chars", "n_symbols", "n_upper", "n_bang", "n_runs", "n_plain")))


def votes() -> dict[str, Column]:
    def rule(value: Column, good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    share = {"symbols": F.col("n_symbols") / words, "capitals": F.col("n_upper") / chars, "shouting": F.col("n_bang") / words, "repeats": F.col("n_repeat_words") / words, "lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), "symbol_runs": F.col("n_runs") / words, "plain_words": F.col("n_plain") / words, "length": F.col("n_words")}
    never = lambda x: F.lit(False)
    bounds = {  # that a text isn't junk of one kind doesn't show that it is good: most rules only vote bad
        "symbols": (never, lambda x: x > 0.2),
        "capitals": (never, lambda x: x > 0.3),
        "shouting": (never, lambda x: x > 0.2),
        "repeats": (never, lambda x: x > 0.3),
        "lines": (never, lambda x: x > 0.3),
        "length": (lambda x: x >= 80, lambda x: x < 50),
        "symbol_runs": (never, lambda x: x > 0.1),
        "plain_words": (lambda x: x > 0.9, lambda x: x < 0.7),
    }
    return {r: rule(share[r], bounds[r][0](share[r]), bounds[r][1](share[r])) for r in RULES}


def fit(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[float]]:
    """EM over (votes, count): the prior probability of a good text, and each rule's accuracy when it votes.  An abstention tells nothing."""
    prior, accuracy = GOOD_PRIOR, [START[r] for r in RULES]
    for _ in range(ROUNDS):
        right, voted, good, total = [0.0] * len(RULES), [0.0] * len(RULES), 0.0, 0.0
        for pattern, n in patterns:
            odds = math.log(prior / (1 - prior)) + sum(v * math.log(a / (1 - a)) for a, v in zip(accuracy, pattern, strict=True))
            post = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
            good, total = good + n * post, total + n
            for j, v in enumerate(pattern):
                if v:
                    right[j] += n * (post if v > 0 else 1 - post)
                    voted[j] += n
        prior = min(MOST, max(1 - MOST, (good + HOLD * GOOD_PRIOR) / (total + HOLD))) if total else prior
        accuracy = [min(MOST, max(LEAST, (x + HOLD * START[r]) / (n + HOLD))) if n else a for r, a, x, n in zip(RULES, accuracy, right, voted, strict=True)]
    return prior, accuracy


def judge(docs: DataFrame) -> DataFrame:
    """features, the rules' votes, base_failed, posterior and kept for each row of docs."""
    voted = spool(features(docs).select("*", *(v.cast("byte").alias(f"vote_{r}") for r, v in votes().items())), "votes")
    names = [f"vote_{r}" for r in RULES]
    patterns = [(tuple(row[:-1]), row[-1]) for row in voted.groupBy(*names).count().collect()]
    prior, accuracy = fit(sorted(patterns))
    odds = F.lit(math.log(prior / (1 - prior)))
    for name, a in zip(names, accuracy, strict=True):
        odds = odds + F.col(name) * math.log(a / (1 - a))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return voted.select("*", failed.alias("base_failed"), (1 / (1 + F.exp(-odds))).alias("posterior")).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def report(docs: DataFrame) -> DataFrame:
    """The columns of query op3."""
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
