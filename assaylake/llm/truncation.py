"""Answers cut off by a field limit, or in their transfer.

Two rules, told apart in every result.

`limit`, the histograms: per table and source, the texts' lengths in characters and in bytes are counted, and with them how many
end without terminal punctuation. A limit shows as a spike of such endings over the lengths around it. A value whose length is
at a spike of its source is cut unless it ends whole beyond doubt: with terminal punctuation, closed delimiters or a full
closing line. A labelled value that could be a cut word is whole elsewhere, and cut here.

`transfer`, for values at no spike: lanes that break off anywhere have no typical length. There a value is cut only if it shows
so itself: an open delimiter, a collector's mark, or a sentence without an end, the last only in sources whose answers do end
with punctuation as a rule (see HABIT): where most answers have none, its lack proves nothing off the limits.

Texts are measured without a collector's mark behind the cut. Equal texts count once in a histogram, so repeated rows make no
spike. Nulls, blank texts and placeholders are whole here (they are empty, another defect). Null sources form a source of their
own. Repeated rows are judged alike; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.functions.arrow import map_rows
from assaylake.llm.answers import shape

#: A spike is a count of n, where the lengths at most AROUND away have a mean of m (of at least half a value in all), whose
#: Poisson deviance n ln(n / m) - n + m is at least CHANCE: chances of under e^-CHANCE. Three values alone in their
#: surroundings reach it, thirty among ten don't.
AROUND, CHANCE = 25, 9.5
#: A source has no habit of punctuation if more than this share of its values at no spike lacks it beyond chance (Wilson's lower bound).
HABIT = 0.5
# Sentence ends, closed delimiters and what may close behind them, at the end of a text; what collectors add.
ENDED = "[.!?。！？}\\]`][\"'”’»)\\]}*_」』）`]*\\s*$"
MARKED = "\\s?(<cut>|<truncated>|\\[\\.\\.\\.\\.?\\]|\\[…\\]|\\[truncated\\]|\\(truncated\\)|\\(cut\\)|…|\\.\\.\\.|\uFFFD)\\s*$"


def with_lengths(answers: DataFrame) -> DataFrame:
    """answers with chars and bytes (without a mark behind a cut), bare (no terminal punctuation) and repaired (false if there is none)."""
    tail = F.substring("text", -16, 16)
    marked = tail.rlike("(?i)" + MARKED)
    core = F.when(marked, F.regexp_replace("text", "(?i)" + MARKED, "")).otherwise(F.col("text"))
    known = {} if "repaired" in answers.columns else {"repaired": F.lit(False)}
    return answers.withColumns(known | {
        "chars": F.length(core).cast("long"), "bytes": F.octet_length(core).cast("long"), "bare": marked | ~tail.rlike(ENDED),
    })


def length_histogram(answers: DataFrame) -> DataFrame:
    """tab, source, unit ('chars' or 'bytes'), length, n (distinct texts), n_bare (those without terminal punctuation)."""
    sized = with_lengths(answers.filter("text is not null"))
    texts = sized.select("tab", "source", "chars", "bytes", "bare", F.xxhash64("text").alias("h")).distinct()
    lengths = F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length")))
    return texts.select("tab", "source", F.inline(lengths), "bare").groupBy("tab", "source", "unit", "length").agg(F.count("*").alias("n"), F.sum(F.col("bare").cast("long")).alias("n_bare"))


def length_spikes(histogram: DataFrame, chance: float = CHANCE, around: int = AROUND) -> DataFrame:
    """The rows of a histogram whose count of bare endings stands out, with the mean count of the lengths around them."""
    near = Window.partitionBy("tab", "source", "unit").orderBy("length").rangeBetween(-around, around)
    usual = (F.sum("n_bare").over(near) - F.col("n_bare")) / F.lit(2.0 * around)
    floor = F.greatest("usual", F.lit(0.5 / around))
    deviance = F.col("n_bare") * F.ln(F.greatest("n_bare", F.lit(1)) / floor) - F.col("n_bare") + floor
    return histogram.withColumn("usual", usual).filter((F.col("n_bare") > floor) & (deviance >= chance))


def source_marks(answers: DataFrame) -> DataFrame:
    """tab, source, char_limits, byte_limits (the lengths of its spikes), punctuated (whether its other answers end with punctuation)."""
    histogram = length_histogram(answers)
    spikes = length_spikes(histogram)
    limits = spikes.groupBy("tab", "source").agg(
        F.collect_set(F.when(F.col("unit") == "chars", F.col("length"))).alias("char_limits"),
        F.collect_set(F.when(F.col("unit") == "bytes", F.col("length"))).alias("byte_limits"),
    )
    sums = histogram.filter("unit = 'chars'").groupBy("tab", "source").agg(F.sum("n").alias("n"), F.sum("n_bare").alias("bare"))
    spiked = spikes.filter("unit = 'chars'").groupBy("tab", "source").agg(F.sum("n").alias("s_n"), F.sum("n_bare").alias("s_bare"))
    same = lambda x, y: (F.col(f"{x}.tab") == F.col(f"{y}.tab")) & F.col(f"{x}.source").eqNullSafe(F.col(f"{y}.source"))
    n = F.greatest(F.col("n") - F.coalesce("s_n", F.lit(0)), F.lit(1)).cast("double")
    p = (F.col("bare") - F.coalesce("s_bare", F.lit(0))) / n
    low = (p + 1.92 / n - 1.96 * F.sqrt(p * (1 - p) / n + 0.96 / (n * n))) / (1 + 3.84 / n)
    return (
        sums.alias("h").join(limits.alias("l"), same("h", "l"), "left").join(spiked.alias("s"), same("h", "s"), "left")
        .select("h.tab", "h.source", "char_limits", "byte_limits", (low <= HABIT).alias("punctuated"))
    )


def surely_whole() -> Column:
    """Prose whose last character is a full stop: decided in the JVM, as `answers.shape` would decide it."""
    return (
        F.col("text").endswith(".") & ~F.col("text").endswith("..") & ~F.contains("text", F.lit("```"))
        & ~F.substring("text", 1, 40).rlike(r"[{\[]")
    )


def ending(got) -> str:
    """How a text of this shape ends: '' (whole), 'loose', 'sentence', or what is open ('json', 'fence', 'marker')."""
    return got.reason if not got.whole else "loose" if got.fragile else ""


def rule_of(end: Column, chars: Column, length_bytes: Column) -> Column:
    """'limit', 'transfer' or null for values with the columns of source_marks."""
    at_limit = F.coalesce(F.array_contains("char_limits", chars), F.lit(False)) | F.coalesce(F.array_contains("byte_limits", length_bytes), F.lit(False))
    shown = end.isin("json", "fence", "marker") | ((end == "sentence") & F.coalesce("punctuated", F.lit(True)))
    return F.when(end == "", None).when(at_limit, "limit").when(shown, "transfer")


def truncated(answers: DataFrame) -> DataFrame:
    """The cut answers: tab, row_id, turn_no, source, kind, ending, rule ('limit' or 'transfer')."""

    def make():
        def row(tab, row_id, turn_no, source, text, repaired, chars, length_bytes):
            got = shape(text, repaired)
            end = ending(got)
            if end:
                yield tab, row_id, turn_no, source, got.kind, end, chars, length_bytes

        return row

    marks = source_marks(answers)
    doubtful = with_lengths(answers.filter(F.col("text").isNotNull() & ~surely_whole()))
    schema = "tab string, row_id long, turn_no long, source string, kind string, ending string, chars long, bytes long"
    found = map_rows(doubtful, ["tab", "row_id", "turn_no", "source", "text", "repaired", "chars", "bytes"], make, schema).alias("a")
    on = (F.col("a.tab") == F.col("l.tab")) & F.col("a.source").eqNullSafe(F.col("l.source"))
    rule = rule_of(F.col("ending"), F.col("chars"), F.col("bytes"))
    return found.join(marks.alias("l"), on, "left").select("a.tab", "row_id", "turn_no", "a.source", "kind", "ending", rule.alias("rule")).filter("rule is not null")


def truncation_by_source(answers: DataFrame) -> DataFrame:
    """tab, source, n_answers, n_truncated, n_at_limit, n_in_transfer, share_truncated: null answers count as answers."""
    total = answers.groupBy("tab", "source").agg(F.count("*").alias("n_answers"))
    cut = truncated(answers).groupBy("tab", "source").agg(
        F.count("*").alias("n_truncated"), F.sum((F.col("rule") == "limit").cast("long")).alias("n_at_limit"), F.sum((F.col("rule") == "transfer").cast("long")).alias("n_in_transfer")
    )
    on = (F.col("t.tab") == F.col("c.tab")) & F.col("t.source").eqNullSafe(F.col("c.source"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return total.alias("t").join(cut.alias("c"), on, "left").select(
        "t.tab", "t.source", "n_answers", *[zero(c).alias(c) for c in ("n_truncated", "n_at_limit", "n_in_transfer")], (zero("n_truncated") / F.col("n_answers")).alias("share_truncated")
    )
