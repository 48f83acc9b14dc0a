"""Quality rules as weak supervision, in DataFrame functions only.

Every rule reads a text's statistics and votes good, bad or abstains. What the
rules are worth is not stated but estimated: expectation-maximisation over the
vote patterns of all documents finds the share of good documents and, for each
rule, how often it votes right on good and on bad ones. A document is kept by
its posterior probability of being good, not by passing every rule.

The patterns are counted by Spark; at most 3^rules of them reach the driver,
whatever the number of documents.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertspark.functions.arrays import let
from alertspark.llm.common import Scratch

GOOD, BAD, ABSTAIN = 1, -1, 0
_SPACE = r"[\x20\x09-\x0D]+"
_WS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_SYMBOL_LINE = r"(?:[#*$%&|<>][^#*$%&|<>]*){3}"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def _count(text: Column, chars: str) -> Column:
    """How many characters of the text are among ``chars``."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _repeated(h: Column) -> Column:
    """Words that lie in a three-word window which occurs twice or more; ``h`` are the word hashes.

    Window hashes are sorted together with their places (packed in the low
    bits), so that equal windows meet; the places found are then joined.
    """
    windows = F.slice(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))), 1, F.greatest(F.size(h) - 2, F.lit(1)))

    def places(t: Column) -> Column:
        low = F.pow(F.lit(2.0), F.ceil(F.log2(F.size(t) + F.lit(1.0)))).cast("long") - 1

        def found(s: Column) -> Column:
            def place(x: Column, j: Column) -> Column:
                at = x.bitwiseAND(s["low"]).cast("int")
                same = lambda y: F.coalesce(F.get(t, at) == F.get(t, y.bitwiseAND(s["low"]).cast("int")), F.lit(False))
                return F.when(same(F.get(s["sorted"], j + 1)) | (j > 0) & same(F.get(s["sorted"], F.greatest(j - 1, F.lit(0)))), at).otherwise(-1)

            return F.sort_array(F.filter(F.transform(s["sorted"], place), lambda p: p >= 0))

        def packed(mask: Column) -> Column:
            return F.struct(mask.alias("low"), F.sort_array(F.transform(t, lambda x, i: x.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long")))).alias("sorted"))

        return let(let(low, packed), found)

    def joined(p: Column) -> Column:
        return F.aggregate(p, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), lambda s, x: F.struct((s["n"] + F.least(F.lit(3), x - s["last"])).alias("n"), x.alias("last")), lambda s: s["n"])

    return F.when(F.size(h) < 4, F.lit(0).cast("long")).otherwise(
        let(windows, lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0).cast("long")).otherwise(let(places(t), joined)))
    )


def text_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and the statistics of each whole text; null counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashes = F.transform(F.filter(F.split(text, _SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))
    words = let(hashes, lambda h: F.struct(F.size(h).cast("long").alias("n_words"), F.size(F.array_distinct(h)).cast("long").alias("n_distinct"), _repeated(h).alias("n_repeat_words")))
    lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.size(F.filter(x, lambda y: y.rlike(_SYMBOL_LINE))).cast("long").alias("n_symbol_lines")))
    return docs.select(
        F.col(id_col).alias("id"),
        words.alias("w"),
        lines.alias("l"),
        F.length(F.translate(text, _WS, "")).cast("long").alias("word_chars"),
        _count(text, _SYMBOLS).alias("n_symbols"),
        _count(text, _UPPER).alias("n_upper"),
        _count(text, "!").alias("n_shouts"),
        _count(text, ".?!").alias("n_stops"),
        _count(text, ",;:").alias("n_pauses"),
    ).select("id", "w.*", "word_chars", "n_symbols", "l.*", "n_upper", "n_shouts", "n_stops", "n_pauses")


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


def rules() -> dict[str, Column]:
    """The rules by name; every one votes by a share, so that long and short texts are treated alike."""
    c = F.col
    share = lambda a, b: c(a) / F.greatest(c(b), F.lit(1))
    symbols, repeats, dup = share("n_symbols", "word_chars"), share("n_repeat_words", "n_words"), share("n_dup_lines", "n_lines")
    marks = (c("n_symbols") + c("n_stops") + c("n_pauses")) / F.greatest(c("word_chars"), F.lit(1))
    length, upper, shouts, fresh, stops = share("word_chars", "n_words"), share("n_upper", "word_chars"), share("n_shouts", "n_words"), share("n_distinct", "n_words"), share("n_stops", "n_words")
    return {
        "symbols": _vote(symbols > 0.06, symbols < 0.02),
        "symbols_per_word": _vote(share("n_symbols", "n_words") > 0.25, share("n_symbols", "n_words") < 0.1),
        "symbol_lines": _vote(share("n_symbol_lines", "n_lines") > 0.5, share("n_symbol_lines", "n_lines") < 0.2),
        "marks": _vote(marks > 0.12, marks < 0.08),
        "repeats": _vote(repeats > 0.4, repeats < 0.15),
        "dup_lines": _vote(dup > 0.3, c("n_dup_lines") == 0),
        "word_length": _vote((length < 2.5) | (length > 14), length.between(3, 10)),
        "upper_case": _vote(upper > 0.4, upper < 0.15),
        "shouts": _vote(shouts > 0.3, shouts < 0.05),
        "fresh_words": _vote(fresh < 0.15, fresh > 0.3),
        "sentences": _vote(stops < 0.01, stops.between(0.02, 0.7)),
    }


@dataclass
class RuleModel:
    """Share of good documents, and per rule P(votes good | good) and P(votes bad | bad), among its votes."""

    good: float
    on_good: list[float]
    on_bad: list[float]

    def evidence(self, r: int, vote: int) -> float:
        """Log odds that a vote of rule ``r`` adds for good."""
        if vote == GOOD:
            return log(self.on_good[r] / (1 - self.on_bad[r]))
        return log((1 - self.on_good[r]) / self.on_bad[r]) if vote == BAD else 0.0

    def posterior(self, votes: tuple[int, ...]) -> float:
        x = log(self.good / (1 - self.good)) + sum(self.evidence(r, v) for r, v in enumerate(votes))
        return 1 / (1 + exp(-max(-700.0, min(700.0, x))))


def estimate(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 50) -> RuleModel:
    """Expectation-maximisation over counted vote patterns.

    Starts from rules that are mostly right and a majority of good documents;
    every estimate is smoothed by a weak belief in that start, which decides
    where there are no votes.
    """
    model = RuleModel(0.8, [0.95] * n_rules, [0.4] * n_rules)
    for _ in range(rounds):
        share = [model.posterior(v) for v, _ in patterns]
        total = sum(n for _, n in patterns)
        good = (8 + sum(p * n for p, (_, n) in zip(share, patterns))) / (10 + total)
        on_good, on_bad = [], []
        for r in range(n_rules):
            seen = [(v[r], n, p) for p, (v, n) in zip(share, patterns) if v[r] != ABSTAIN]
            on_good.append((9.5 + sum(n * p for v, n, p in seen if v == GOOD)) / (10 + sum(n * p for _, n, p in seen)))
            on_bad.append((4 + sum(n * (1 - p) for v, n, p in seen if v == BAD)) / (10 + sum(n * (1 - p) for _, n, p in seen)))
        new = RuleModel(good, on_good, on_bad)
        if max(abs(a - b) for a, b in zip([good, *on_good, *on_bad], [model.good, *model.on_good, *model.on_bad])) < 1e-9:
            return new
        model = new
    return model


def weak_quality(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, posterior quality and verdict of every document.

    Words are runs without ASCII white space. One row per input row: id,
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed
    (fewer than 50 words, or over half of them repeated), posterior, kept (not
    base_failed and posterior >= threshold). A null, empty or wordless text has
    counts of 0 and fails the base. The model is estimated on the documents that
    pass the base. Repeated rows give repeated results, a null id stays null,
    other columns are not read. No shuffle but the count of vote patterns.
    """
    scratch = Scratch(docs.sparkSession)
    named = rules()
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    stats = text_statistics(docs, id_col, text_col).withColumns({"base_failed": failed, **{f"vote_{k}": v for k, v in named.items()}})
    stats = scratch.keep(stats, "statistics")
    votes = [f"vote_{k}" for k in named]
    counted = stats.filter("not base_failed").groupBy(*votes).agg(F.count("*").alias("n")).orderBy(*votes).collect()
    model = estimate([(tuple(r[v] for v in votes), r["n"]) for r in counted], len(votes))
    odds = F.lit(log(model.good / (1 - model.good)))
    for r, v in enumerate(votes):
        odds = odds + F.when(F.col(v) == GOOD, model.evidence(r, GOOD)).when(F.col(v) == BAD, model.evidence(r, BAD)).otherwise(0.0)
    posterior = 1 / (1 + F.exp(-odds))
    return stats.select(
        F.col("id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        posterior.alias("posterior"),
        (~F.col("base_failed") & (posterior >= threshold)).alias("kept"),
    )
