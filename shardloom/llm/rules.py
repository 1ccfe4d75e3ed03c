"""Quality rules with adaptive thresholds.

Each text's counts give a few rates.  For every rate, language and source the rates go into a
quantile sketch: logarithmic buckets with their counts (relative error under one per cent).  Such
sketches merge by adding counts, so they are one aggregation, partial before the shuffle, and
the sketches of a language or of everything are sums of those of its sources.

The thresholds are fences about the quartiles: beyond them by three interquartile ranges, or, where
most texts have a rate of zero and that range says nothing, by what a few events make in a text of the
group's median size, which comes from a sketch too.  Every quartile and median is drawn towards that of
the language, and a language's towards that of all texts, with the weight of ``PRIOR`` texts: small
groups follow their language, large ones themselves.  The verdicts follow from one join of the counts
with the thresholds.

Defined results: a null or empty text has no words and fails the base rule; null languages and
sources are groups of their own (as the empty string); repeated rows count each; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, slices, text_or_empty

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
#: Growth of the sketch's buckets; the relative error of a quantile is under half of it.
GAMMA = 1.015
#: Fences lie so many interquartile ranges beyond the quartiles.
FENCE = 3.0
#: Rate: (events that a text of median size may have beyond the quartile, that size; None: the sketch's
#: own error instead, and a fence below too).
RATES = {"symbol_rate": (3, "word_chars"), "mean_word": None, "dup_line_rate": (3, "n_lines"), "repeat_rate": (30, "n_words")}
SIZES = ("word_chars", "n_lines", "n_words")
#: Texts that a language weighs against a source's own, and all texts against a language's own.
PRIOR = 100
#: Threshold rows that are broadcast; more are joined by shuffle, with a hot group's texts dealt over ``SALT`` parts.
BROADCAST, SALT = 100_000, 32
BASE_WORDS, BASE_REPEATS = 10, 20
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def text_counts(text: str) -> tuple[int, ...]:
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in SPACE)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return n, chars, symbols, len(lines) - len(set(lines)), _repeat_words(words), len(lines)


def _repeat_words(words: list[bytes], width: int = 5) -> int:
    """Words in windows that occur twice or more, the first occurrence included."""
    windows = list(zip(*(words[k:] for k in range(width))))
    if len(set(windows)) == len(windows):
        return 0
    first: dict[tuple, int] = {}
    again = np.zeros(len(words) + 1, np.int64)
    marked: set[int] = set()
    for i, w in enumerate(windows):
        at = first.setdefault(w, i)
        if at != i:
            marked.add(at)
            marked.add(i)
    at = np.fromiter(marked, np.int64, len(marked))
    again[at] += 1
    np.subtract.at(again, np.minimum(at + width, len(words)), 1)
    return int((np.cumsum(again)[:-1] > 0).sum())


def count_table(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            table = np.array([text_counts(t) for t in batch.column(3).to_pylist()], np.int64).reshape(-1, len(_COUNTS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), *(pa.array(table[:, i]) for i in range(len(_COUNTS)))],
                ["doc_id", "lang", "source", *_COUNTS],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    group = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    source = documents.select("doc_id", *group, text_or_empty().alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, lang string, source string, " + ", ".join(f"{c} long" for c in _COUNTS))


def rates() -> dict[str, Column]:
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return {
        "symbol_rate": share("n_symbols", "word_chars"),
        "mean_word": share("word_chars", "n_words"),
        "dup_line_rate": share("n_dup_lines", "n_lines"),
        "repeat_rate": share("n_repeat_words", "n_words"),
    }


def sketch(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, bucket, n: the mergeable sketch of each group (bucket null: zero)."""
    bucket = F.when(F.col(value) > 0, F.ceil(F.log(value) / float(np.log(GAMMA))).cast("int"))
    return values.groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], at: dict[str, float]) -> DataFrame:
    """The named quantiles of each group, with its number of values."""
    order = Window.partitionBy(*keys).orderBy(F.col("bucket").asc_nulls_first())
    ranked = sketches.withColumn("_to", F.sum("n").over(order)).withColumn("_of", F.sum("n").over(Window.partitionBy(*keys)))
    # The middle of a bucket (gamma^(b-1), gamma^b] in relative terms.
    middle = F.when(F.col("bucket").isNull(), 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bucket")) * (2 / (1 + GAMMA)))
    picks = [F.min(F.when(F.col("_to") >= q * F.col("_of"), middle)).alias(name) for name, q in at.items()]
    return ranked.groupBy(*keys).agg(*picks, F.max("_of").alias("_n"))


def thresholds(counts: DataFrame) -> DataFrame:
    """lang, source and a map from rate to its (low, high)."""
    measured = {**rates(), **{k: F.col(k).cast("double") for k in SIZES}}
    pairs = F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in measured]), F.array(*measured.values()))).alias("rate", "value")
    by_source = settle(sketch(counts.where(~base_failed()).select("lang", "source", pairs), ["lang", "source", "rate"], "value"), "sketches")
    marks = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
    named = lambda df, p: df.select(*[c for c in ("lang", "source", "rate") if c in df.columns], *[F.col(c).alias(f"{p}{c}") for c in (*marks, "_n")])
    own = named(quantiles(by_source, ["lang", "source", "rate"], marks), "s_")
    language = named(quantiles(merge(by_source, ["lang", "rate"]), ["lang", "rate"], marks), "l_")
    whole = named(quantiles(merge(by_source, ["rate"]), ["rate"], marks), "w_")
    joined = own.join(language, ["lang", "rate"]).join(F.broadcast(whole), "rate")  # one row a rate
    drawn = lambda n, q, towards: (F.col(n) * q + PRIOR * towards) / (F.col(n) + PRIOR)
    for c in marks:
        joined = joined.withColumn(c, drawn("s__n", F.col(f"s_{c}"), drawn("l__n", F.col(f"l_{c}"), F.col(f"w_{c}"))))
    values = F.map_from_entries(F.collect_list(F.struct("rate", F.struct(*marks))))  # seven entries a group
    group = joined.groupBy("lang", "source").agg(values.alias("_q"))
    fences = []
    for name, guard in RATES.items():
        q1, q3 = F.col("_q")[name]["q1"], F.col("_q")[name]["q3"]
        least = F.lit(guard[0]) / F.greatest(F.col("_q")[guard[1]]["q2"], F.lit(1.0)) if guard else 2 * (GAMMA - 1) * q3
        reach = F.greatest(FENCE * (q3 - q1), least)
        low = q1 - reach if guard is None else F.lit(None).cast("double")
        fences += [F.lit(name), F.struct(low.alias("low"), (q3 + reach).alias("high"))]
    return group.select("lang", "source", F.create_map(*fences).alias("fences"))


def base_failed() -> Column:
    return (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEATS * F.col("n_words"))


def apply_rules(documents: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """Every row's counts, ``base_failed`` and ``kept``."""
    counts = settle(count_table(documents), "text-counts")
    fences = settle(thresholds(counts), "fences")
    inside = F.lit(True)
    for name, value in rates().items():
        fence = F.col("fences")[name]
        inside &= F.coalesce(value <= fence["high"], F.lit(True)) & F.coalesce(value >= fence["low"], F.lit(True))
    if fences.count() <= broadcast:
        judged = counts.join(F.broadcast(fences), ["lang", "source"], "left")
    else:  # a group's texts meet copies of its one row in SALT parts
        salted = counts.withColumn("_salt", (F.xxhash64("doc_id", *_COUNTS) % SALT).cast("int"))
        copies = fences.withColumn("_salt", F.explode(F.sequence(F.lit(1 - SALT), F.lit(SALT - 1))))
        judged = salted.join(copies, ["lang", "source", "_salt"], "left")
    return judged.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & inside)


def op4(documents: DataFrame) -> DataFrame:
    return apply_rules(documents).select("doc_id", *_COUNTS[:5], "base_failed", "kept")
