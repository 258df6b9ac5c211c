"""Quality filtering by weak supervision, with DataFrame functions only.

Rules vote bad (-1), abstain (0) or vote good (1) on each document. The true
quality is a hidden class; given it, the rules vote independently, each with
its own rate of bad votes in either class. Expectation-maximisation estimates
those rates and the share of bad documents from the votes alone, and a
document's posterior probability of being good decides.

The votes of all documents are first counted by pattern (at most 3 to the
number of rules, however many documents), so each EM step is one aggregate over
that bounded table; the driver sees only the sums of a step.

Edge cases: a null or empty text has no words and fails the base rule. Texts
are read whole, whatever their length. A rule without a basis (no words, a
single line) abstains. Repeated rows stay repeated. An empty table gives an
empty result with the initial rates. Other columns of `docs` are kept by
`quality`; added ones start with `q_`, with underscores in front where the
table has such columns already.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovework.llm.common import BLANKS, free_prefix, written

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _features(docs: DataFrame, text: str) -> DataFrame:
    """`docs` with q_ columns: the base counts and those of the rules."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        "*",
        F.array_remove(F.split(whole, f"[{BLANKS}]+"), "").alias("q_words"),
        F.filter(F.split(whole, "\n"), lambda x: x.rlike(f"[^{BLANKS}]")).alias("q_lines"),
        F.regexp_replace(whole, r"[^#*$%&|<>!]+", "").alias("q_marks"),
        F.regexp_replace(whole, r"[^\p{Lu}]+", "").alias("q_capitals"),
    )
    rows = rows.withColumn("q_n_words", F.size("q_words").cast("long")).withColumn(
        # a hash for each window of five words; equal windows have equal hashes
        "q_windows",
        F.when(
            F.col("q_n_words") >= 5,
            F.transform(F.sequence(F.lit(1), F.size("q_words") - 4), lambda i: F.xxhash64(F.slice("q_words", i, 5))),
        ),
    )
    rows = rows.withColumn(
        "q_sorted",
        F.when(
            F.size(F.array_distinct("q_windows")) < F.size("q_windows"),
            F.sort_array(F.transform("q_windows", lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i")))),
        ),
    ).drop("q_windows")
    same = lambda a, b: (a.h == b.h) & (F.slice("q_words", a.i, 5) == F.slice("q_words", b.i, 5))
    rows = rows.withColumn(
        "q_found",
        F.array_distinct(
            F.flatten(
                F.zip_with(
                    F.slice("q_sorted", F.lit(1), F.size("q_sorted") - 1),
                    F.slice("q_sorted", F.lit(2), F.size("q_sorted") - 1),
                    lambda a, b: F.when(same(a, b), F.array(a.i, b.i)).otherwise(F.array().cast("array<int>")),
                )
            )
        ),
    ).drop("q_sorted")
    covered = F.size(F.array_distinct(F.flatten(F.transform("q_found", lambda i: F.sequence(i, i + 4)))))
    return rows.select(
        *docs.columns,
        "q_n_words",
        F.char_length(F.array_join("q_words", "")).cast("long").alias("q_word_chars"),
        F.char_length(F.replace(F.col("q_marks"), F.lit("!"), F.lit(""))).cast("long").alias("q_n_symbols"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("q_n_dup_lines"),
        F.when(F.col("q_found").isNotNull(), covered).otherwise(0).cast("long").alias("q_n_repeat_words"),
        F.size("q_lines").cast("long").alias("q_n_lines"),
        F.char_length("q_marks").cast("long").alias("q_n_marks"),
        F.char_length("q_capitals").cast("long").alias("q_n_capitals"),
        F.size(F.array_distinct("q_words")).cast("long").alias("q_n_distinct"),
    )


def base_failed() -> Column:
    return (F.col("q_n_words") < 10) | (100 * F.col("q_n_repeat_words") > 20 * F.col("q_n_words"))


def rules() -> dict[str, Column]:
    """Votes by name: -1 bad, 1 good, 0 abstains."""

    def vote(basis: Column, bad: Column, good: Column) -> Column:
        return F.when(~F.coalesce(basis, F.lit(False)), 0).when(bad, -1).when(good, 1).otherwise(0).cast("tinyint")

    n, some = F.col("q_n_words"), F.col("q_n_words") > 0
    share = lambda c, of: F.col(c) / F.nullif(F.col(of), F.lit(0))
    symbols, marks = share("q_n_symbols", "q_n_words"), share("q_n_marks", "q_n_words")
    lines, repeats = share("q_n_dup_lines", "q_n_lines"), share("q_n_repeat_words", "q_n_words")
    mean, capitals, distinct = share("q_word_chars", "q_n_words"), share("q_n_capitals", "q_word_chars"), share("q_n_distinct", "q_n_words")
    return {
        "symbols": vote(some, symbols > 0.2, symbols < 0.05),
        "marks": vote(some, marks > 0.4, marks < 0.1),
        "lines": vote(F.col("q_n_lines") > 1, lines > 0.3, lines < 0.1),
        "repeats": vote(some, repeats > 0.2, repeats < 0.1),
        "word_length": vote(some, (mean < 2.5) | (mean > 15), (mean >= 3) & (mean <= 12)),
        "capitals": vote(some, capitals > 0.4, capitals < 0.15),
        "variety": vote(n >= 50, distinct < 0.15, distinct > 0.25),
        "length": vote(n >= 0, n < 10, n >= 20),
    }


@dataclass
class Rates:
    """Share of bad documents, and each rule's rate of bad votes among its
    votes on bad and on good documents."""

    bad: float
    on_bad: dict[str, float]
    on_good: dict[str, float]

    def log_odds(self) -> Column:
        """Of being bad, from columns v_<rule>."""
        odds = F.lit(math.log(self.bad / (1 - self.bad)))
        for r, a in self.on_bad.items():
            b = self.on_good[r]
            odds = odds + F.when(F.col(f"v_{r}") == -1, math.log(a / b)).when(F.col(f"v_{r}") == 1, math.log((1 - a) / (1 - b))).otherwise(0.0)
        return odds

    def posterior_good(self) -> Column:
        return 1 / (1 + F.exp(self.log_odds()))


def estimate(votes: DataFrame, names: list[str], steps: int = 30, tolerance: float = 1e-4) -> Rates:
    """EM over the counts of vote patterns. Starts from rules that are right
    more often than not, which settles which hidden class is the bad one, and
    keeps every rule at least as apt to vote bad on bad documents."""
    patterns = written(votes.groupBy([f"v_{r}" for r in names]).agg(F.count("*").alias("n")), "patterns")
    rates = Rates(0.1, dict.fromkeys(names, 0.4), dict.fromkeys(names, 0.05))
    for _ in range(steps):
        rows = patterns.withColumn("good", F.col("n") * rates.posterior_good()).withColumn("ill", F.col("n") - F.col("good"))
        sums = [F.sum("n").alias("n"), F.sum("ill").alias("ill")]
        for r in names:
            v = F.col(f"v_{r}")
            for side in ("ill", "good"):
                sums.append(F.sum(F.when(v == -1, F.col(side))).alias(f"{side}_{r}_bad"))
                sums.append(F.sum(F.when(v != 0, F.col(side))).alias(f"{side}_{r}_all"))
        got = {k: v or 0.0 for k, v in rows.agg(*sums).first().asDict().items()}
        # pseudo-counts keep the rates inside of (0, 1)
        rate = lambda side, r, start: (got[f"{side}_{r}_bad"] + start) / (got[f"{side}_{r}_all"] + 1)
        on_good = {r: rate("good", r, 0.05) for r in names}
        now = Rates((got["ill"] + 0.1) / (got["n"] + 1), {r: max(rate("ill", r, 0.4), on_good[r]) for r in names}, on_good)
        moved = max(
            abs(now.bad - rates.bad),
            *(abs(now.on_bad[r] - rates.on_bad[r]) for r in names),
            *(abs(now.on_good[r] - rates.on_good[r]) for r in names),
        )
        rates = now
        if moved < tolerance:
            break
    return rates


def quality(docs: DataFrame, text: str = "text", at_least: float = 0.5, keep_text: bool = True) -> DataFrame:
    """`docs` with q_ columns: counts, q_base_failed, q_good (posterior
    probability) and q_kept. The rows are written once to the shared folder;
    without `keep_text`, the text is not among them."""
    names, added = docs.columns, free_prefix(docs.columns, "q_")
    numbered = {name: f"c{k}" for k, name in enumerate(names)}
    own, rows = rules(), _features(docs.toDF(*numbered.values()), numbered[text])
    rows = written(rows if keep_text else rows.drop(numbered[text]), "features")
    voted = rows.select("*", *(c.alias(f"v_{r}") for r, c in own.items()))
    rates = estimate(voted, [*own])
    voted = voted.withColumn("q_base_failed", base_failed()).withColumn("q_good", rates.posterior_good())
    voted = voted.withColumn("q_kept", ~F.col("q_base_failed") & (F.col("q_good") >= at_least))
    kept = [F.col(c).alias(name) for name, c in numbered.items() if keep_text or name != text]
    return voted.select(*kept, *(F.col(c).alias(added + c[2:]) for c in voted.columns if c.startswith("q_")))


def only_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are kept, with their own columns."""
    return quality(docs, text).filter(free_prefix(docs.columns, "q_") + "kept").select(*docs.columns)
