"""Quality rules whose thresholds follow each language and source.

Every text gets a few measures from built-in SQL functions.  Their values are
counted in logarithmic buckets (a quantile sketch with a relative error of one
part in a hundred) for each language and source; sketches merge by adding
counts, to those of a language and of all texts.  A group's quartiles are drawn
to those of its language, and these to those of all texts, as if SHRINK more
rows stood there; so they move smoothly with the group's size.  A text passes
if each measure lies within the fences of its group: upper quartile plus FENCE
times the quartile distance, and a tolerance for measures that are zero in most
texts and so have no distance of their own.

Everything is DataFrame functions.  Only the measures, never texts, are
shuffled, and only counts by group, measure and bucket meet in one task.

Results for odd input: a null text has no words, no symbols and no lines, and
fails the base rule as every text under 50 words does; null languages and
sources are groups of their own; a null ``doc_id`` stays null; repeated rows
are judged each; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
#: Relative error of a sketch, and its bucket base.
ERROR = 0.01
GAMMA = (1 + ERROR) / (1 - ERROR)
#: The bucket of the value 0.
ZERO = -100_000
#: Measures: numerator, denominator, tolerance beyond the fence.
MEASURES = {
    "symbols": ("n_symbols", "word_chars", 0.1),
    "dup_lines": ("n_dup_lines", "n_lines", 0.3),
    "repeats": ("n_repeat_words", "n_words", 0.2),
    "capitals": ("n_capitals", "word_chars", 0.0),
    "marks": ("n_marks", "word_chars", 0.1),
    "word_length": ("word_chars", "n_words", 0.0),
}
#: Quartile distances from the quartile to the fence.
FENCE = 12.0
#: So many rows with the quartiles of the next larger group are added to each group.
SHRINK = 50.0


def _dropped(text: Column, characters: str) -> Column:
    """How many of these characters the text has."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"),
    )
    split = source.withColumns({
        "_words": F.filter(F.split("text", SPACE), lambda w: w != ""),
        "_lines": F.filter(F.split("text", "\n"), lambda line: F.translate(line, BLANKS, "") != ""),
    })
    # the hash of each three-word window with its place, in the order of hashes
    windows = split.withColumn("n_words", F.size("_words").cast("long")).withColumn("_windows", F.when(
        F.col("n_words") >= 3,
        F.sort_array(F.transform(
            F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")),
            lambda i: F.struct(F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("p")),
        )),
    ))
    # places of windows whose neighbour in that order has the same hash
    repeated = windows.withColumn("_places", F.sort_array(F.filter(F.transform(
        "_windows",
        lambda w, i: F.when((F.get("_windows", i - 1)["h"] == w["h"]) | (F.get("_windows", i + 1)["h"] == w["h"]), w["p"]),
    ), lambda p: p.isNotNull())))
    covered = F.aggregate(
        "_places",
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(3), p - s["last"])).alias("n")),
        lambda s: s["n"],
    )
    return repeated.select(
        "doc_id", "lang", "source", "n_words",
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        _dropped(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        _dropped(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_capitals"),
        _dropped(F.col("text"), "!?").cast("long").alias("n_marks"),
    )


def bucket(value: Column) -> Column:
    """The sketch's bucket of a value: (GAMMA**(i-1), GAMMA**i] is bucket i."""
    return F.when(value <= 0, ZERO).otherwise(F.ceil(F.log(value) / F.lit(math.log(GAMMA)))).cast("int")


def bucket_value(index: Column) -> Column:
    return F.when(index == ZERO, F.lit(0.0)).otherwise(F.lit(2 / (GAMMA + 1)) * F.pow(F.lit(GAMMA), index))


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n: the mergeable quantile sketches."""
    long = measured.select("lang", "source", F.explode(F.array(*(
        F.struct(F.lit(name).alias("measure"), bucket(F.col(a) / F.when(F.col(b) > 0, F.col(b)).otherwise(1)).alias("bucket")) for name, (a, b, _) in MEASURES.items()
    ))).alias("m"))
    return long.groupBy("lang", "source", "m.measure", "m.bucket").agg(F.count(F.lit(1)).alias("n"))


def quartiles(merged: DataFrame, group: list[str]) -> DataFrame:
    """n, q1 and q3 of each group and measure, from its merged buckets."""
    counts = merged.groupBy(*group, "measure", "bucket").agg(F.sum("n").alias("n"))
    # a group has at most some hundreds of buckets of a measure
    by = Window.partitionBy(*group, "measure")
    up_to = by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumns({"_upto": F.sum("n").over(up_to), "_all": F.sum("n").over(by)})
    at = lambda q: bucket_value(F.min(F.when(F.col("_upto") >= F.ceil(F.lit(q) * F.col("_all")), F.col("bucket"))))
    return ranked.groupBy(*group, "measure").agg(F.max("_all").alias("n"), at(0.25).alias("q1"), at(0.75).alias("q3"))


def limits(sketch: DataFrame) -> DataFrame:
    """lang, source and the highest (and for word length lowest) value of each measure."""
    small = quartiles(sketch, ["lang", "source"])
    middle = quartiles(sketch, ["lang"]).select(F.col("lang").alias("_lang"), F.col("measure").alias("_m1"), F.col("n").alias("n1"), F.col("q1").alias("q11"), F.col("q3").alias("q31"))
    whole = quartiles(sketch, []).select(F.col("measure").alias("_m2"), F.col("q1").alias("q12"), F.col("q3").alias("q32"))
    # one row for each measure
    joined = small.join(middle, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("measure") == F.col("_m1"))).join(F.broadcast(whole), F.col("measure") == F.col("_m2"))
    drawn = lambda n, q, to: (F.col(n) * F.col(q) + F.lit(SHRINK) * to) / (F.col(n) + F.lit(SHRINK))
    chosen = joined.select("lang", "source", "measure", *(drawn("n", q, drawn("n1", f"{q}1", F.col(f"{q}2"))).alias(q) for q in ("q1", "q3")))
    slack = F.when(F.lit(False), 0.0)
    for name, (_, _, tolerance) in MEASURES.items():
        slack = slack.when(F.col("measure") == name, tolerance)
    away = F.lit(FENCE) * (F.col("q3") - F.col("q1")) + slack
    fenced = chosen.select("lang", "source", "measure", (F.col("q3") + away).alias("high"), (F.col("q1") - away).alias("low"))
    return fenced.groupBy("lang", "source").agg(
        *(F.max(F.when(F.col("measure") == name, F.col("high"))).alias(f"max_{name}") for name in MEASURES),
        F.max(F.when(F.col("measure") == "word_length", F.col("low"))).alias("min_word_length"),
    )


def judge(docs: DataFrame) -> DataFrame:
    """The counts of every text, base_failed, and kept by the group's limits."""
    measured = materialise(measures(docs), "measures")
    bounds = limits(sketches(measured)).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = measured.join(bounds, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    within = F.lit(True)
    for name, (a, b, _) in MEASURES.items():
        value = F.col(a) / F.when(F.col(b) > 0, F.col(b)).otherwise(1)
        within = within & (value <= F.col(f"max_{name}"))
        if name == "word_length":
            within = within & (value >= F.col("min_word_length"))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (~base_failed & F.coalesce(within, F.lit(True))).alias("kept"),
    )


def sql() -> str:
    """The same in DuckDB's SQL, over ``documents``."""
    value = lambda a, b: f"{a}::DOUBLE / (CASE WHEN {b} > 0 THEN {b} ELSE 1 END)"
    index = lambda v: f"CASE WHEN {v} <= 0 THEN {ZERO} ELSE ceil(ln({v}) / {math.log(GAMMA)!r})::INT END"
    back = lambda i: f"(CASE WHEN {i} = {ZERO} THEN 0.0 ELSE {2 / (GAMMA + 1)!r} * pow({GAMMA!r}, {i}) END)"
    long = " UNION ALL ".join(f"SELECT lang, source, '{name}' AS measure, {index(value(a, b))} AS bucket FROM counted" for name, (a, b, _) in MEASURES.items())
    drawn = lambda q: f"(s.n * s.{q} + {SHRINK}::DOUBLE * ((m.n * m.{q} + {SHRINK}::DOUBLE * w.{q}) / (m.n + {SHRINK}::DOUBLE))) / (s.n + {SHRINK}::DOUBLE)"
    slack = " ".join(f"WHEN '{name}' THEN {t}::DOUBLE" for name, (_, _, t) in MEASURES.items())

    def level(name: str, group: str) -> str:
        keys = f"{group}, " if group else ""
        return f"""{name}_c AS (SELECT {keys}measure, bucket, sum(n) AS n FROM sketch GROUP BY {keys}measure, bucket),
{name}_r AS (SELECT *, sum(n) OVER (PARTITION BY {keys}measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys}measure) AS total FROM {name}_c),
{name} AS (SELECT {keys}measure, max(total) AS n, {back("min(CASE WHEN upto >= ceil(0.25 * total) THEN bucket END)")} AS q1, {back("min(CASE WHEN upto >= ceil(0.75 * total) THEN bucket END)")} AS q3 FROM {name}_r GROUP BY {keys}measure)"""

    within = " AND ".join(
        [f"{value(a, b)} <= max_{name}" for name, (a, b, _) in MEASURES.items()] + [f"{value('word_chars', 'n_words')} >= min_word_length"]
    )
    return rf"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs),
windows AS (SELECT r, p, words[p] AS a, words[p + 1] AS b, words[p + 2] AS c FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS p FROM split WHERE len(words) >= 3)),
again AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM again) GROUP BY r),
counted AS (SELECT s.doc_id, s.lang, s.source, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
 (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
 coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
 (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_capitals, (length(text) - length(regexp_replace(text, '[!?]', '', 'g')))::BIGINT AS n_marks
 FROM split s LEFT JOIN covered c USING (r)),
long AS ({long}),
sketch AS (SELECT lang, source, measure, bucket, count(*) AS n FROM long GROUP BY ALL),
{level("small", "lang, source")},
{level("middle", "lang")},
{level("whole", "")},
chosen AS (SELECT s.lang, s.source, s.measure, {drawn("q1")} AS q1, {drawn("q3")} AS q3
 FROM small s JOIN middle m ON s.lang IS NOT DISTINCT FROM m.lang AND s.measure = m.measure JOIN whole w ON s.measure = w.measure),
fenced AS (SELECT lang, source, measure, q3 + ({FENCE}::DOUBLE * (q3 - q1) + (CASE measure {slack} END)) AS high, q1 - ({FENCE}::DOUBLE * (q3 - q1) + (CASE measure {slack} END)) AS low FROM chosen),
bounds AS (SELECT lang, source, {", ".join(f"max(CASE WHEN measure = '{name}' THEN high END) AS max_{name}" for name in MEASURES)}, max(CASE WHEN measure = 'word_length' THEN low END) AS min_word_length FROM fenced GROUP BY lang, source),
judged AS (SELECT c.*, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, coalesce({within}, true) AS within_limits
 FROM counted c LEFT JOIN bounds b ON c.lang IS NOT DISTINCT FROM b.lang AND c.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND within_limits) AS kept FROM judged"""
