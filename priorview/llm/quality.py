"""Quality rules whose cutoffs are controlled for false rejection."""

from __future__ import annotations

import re
from math import log, log1p, pi

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.frames import computed_once
from .common import fresh, stored, table

SPACES = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
RISK = 0.05    # of the good documents of a stratum, at most this share may be rejected by the learned cutoffs
ERROR = 0.05   # chance that this fails in any stratum
TOP = 10_000   # greatest value of a rule
#: value of each rule, a whole number up to TOP; large values are rejected.
RULES = {
    "symbols": "n_symbols * 1000 div n_words",
    "repeated_words": "n_repeat_words * 1000 div n_words",
    "repeated_lines": "n_dup_lines * 1000 div n_lines",
    "long_words": "word_chars * 100 div n_words",
    "short_words": f"{TOP} - least(word_chars * 100 div n_words, {TOP})",
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _covered(low: str, size: Column) -> Column:
    """Words in windows that stand twice or more, from (hash, place) in order."""
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    sides = F.arrays_zip(F.col(low).alias("own"), F.concat(none, F.slice(low, 1, size - 1)).alias("left"),
                         F.concat(F.slice(low, 2, size), none).alias("right"))
    twice = F.filter(sides, lambda x: x["own"]["h"].eqNullSafe(x["left"]["h"]) | x["own"]["h"].eqNullSafe(x["right"]["h"]))
    return F.sort_array(F.transform(twice, lambda x: x["own"]["i"]))


def measured(docs: DataFrame, *also: str, text_col: str = "text") -> DataFrame:
    """The columns `also` of every row and the MEASURES of its whole text (null: empty), as longs:
    words, their characters, symbols, lines equal to an earlier one (lines with a word count),
    words in three-word windows that stand twice or more, and lines with a word.

    A row's windows are hashed (64 bits) and sorted inside the row, so no word is shuffled.
    Repeated rows stay, an empty table gives no rows.
    """
    text, words, lines, hashes, windows, low, twice, at = fresh(
        docs, "m_text", "m_words", "m_lines", "m_hashes", "m_windows", "m_low", "m_twice", "m_at")
    taken = fresh(docs.select(*also), *MEASURES)
    if taken != list(MEASURES):
        raise ValueError("rename the kept columns that are called like a measure")
    out = docs.select(*also, F.coalesce(F.col(text_col), F.lit("")).alias(text))
    bare = F.translate(text, SPACES, " " * len(SPACES))
    visible = F.filter(F.split(F.col(text), "\n"), lambda x: F.trim(x, F.lit(SPACES + " ")) != "")
    out = computed_once(out, **{words: F.array_remove(F.split(bare, " "), ""), lines: visible})
    measures = {"n_words": F.size(words), "word_chars": F.length(F.replace(bare, F.lit(" "), F.lit(""))),
                "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
                "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)), "n_lines": F.size(lines)}
    out = out.select(*also, *[m.cast("long").alias(n) for n, m in measures.items()], F.transform(words, lambda x: F.xxhash64(x)).alias(hashes))
    size = F.greatest(F.size(hashes) - 2, F.lit(0))
    pairs = F.zip_with(F.slice(hashes, 1, size), F.slice(hashes, 2, size), lambda x, y: F.xxhash64(x, y))
    out = computed_once(out, **{windows: F.zip_with(pairs, F.slice(hashes, 3, size), lambda x, y: F.xxhash64(x, y))})
    # Most texts have no window twice; only the others sort their windows with places.
    out = out.drop(hashes).withColumn(twice, F.size(F.array_distinct(windows)) < F.size(windows))
    placed = F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    out = computed_once(out, **{low: F.when(F.col(twice), F.sort_array(placed)).otherwise(empty)})
    out = computed_once(out, **{at: F.when(F.col(twice), _covered(low, F.size(low))).otherwise(F.array().cast("array<int>"))})
    steps = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda x, y: F.least(y - x, F.lit(3)))
    words_in = F.aggregate(steps, F.lit(0), lambda n, x: n + F.coalesce(x, F.lit(3)))
    return out.select(*also, *[F.col(m) if m != "n_repeat_words" else words_in.cast("long").alias(m) for m in MEASURES])


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def _value(rule: str) -> Column:
    """A rule's value. Divisors are 1 at least: Spark may work a division out ahead of the base rules
    that set texts without words aside."""
    return F.least(F.expr(re.sub(r"div (\w+)", r"div greatest(\1, 1)", RULES[rule])), F.lit(TOP))


def _log_factorial(x: Column) -> Column:
    """Of whole numbers: Stirling's series beyond 8, which is exact to a double's precision there."""
    y = x + 9.0
    series = (y - 0.5) * F.log(y) - y + 0.5 * log(2 * pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    for k in range(1, 9):
        series = series - F.log(x + float(k))
    return series


def most_failures(strata: DataFrame, risk: float, error: float) -> DataFrame:
    """(stratum, n) -> (stratum, allowed): the most failures among n that a share of failures of
    `risk` has with a chance of at most `error`; strata where even none has more are absent.

    This is the exact one-sided binomial bound. Chances are summed from nine standard deviations
    below the expected number, which leaves out less than a double holds.
    """
    mean = F.col("n") * risk
    window = strata.select("stratum", "n", F.explode(F.sequence(F.greatest(F.floor(mean - 9 * F.sqrt(mean) - 40), F.lit(0)), F.floor(mean))).alias("k"))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    chance = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * log(risk) + (n - k) * log1p(-risk))
    below = F.sum(chance).over(Window.partitionBy("stratum").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return window.withColumn("below", below).where(F.col("below") <= error).groupBy("stratum").agg(F.max("k").alias("allowed"))


def cutoffs(features: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, symbols, ...): the cutoff of each rule in each stratum, null where none is safe
    or useful, from features (id, stratum, measures) and labels (id, quality 0/1).

    Labelled rows that pass the base rules are split by a checksum of the id. In the holdout
    (two thirds) a cutoff is safe if its false rejections are so few that a share of
    risk / rules of the stratum's good rows is excluded at error / (rules * strata). Cutoffs
    are tried from the greatest value down and fall with the first that is not safe; as each
    rejects what those above it reject, this order needs no further correction. Among the safe
    ones the other third chooses: the most bad rows less good rows rejected, the greatest
    cutoff of equals, none unless bad ones outweigh. So with the chance 1 - error no stratum
    loses more than `risk` of its good rows.

    A row with several labels is good if one says so. Labels of other ids and null ids serve
    nothing. What is windowed here has at most TOP + 1 rows for a rule of a stratum.
    """
    known = labels.where("quality in (0, 1)").groupBy("id").agg(F.max("quality").alias("quality"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), _value(r).cast("int").alias("value")) for r in RULES])
    rows = features.where(~base_failed()).join(known, "id").select(
        "stratum", "quality", (F.crc32(F.col("id").cast("string")) % 3 == 0).alias("chooses"), F.inline(rules))
    count = lambda cond: F.count_if(cond).alias
    held, good = ~F.col("chooses"), F.col("quality") == 1
    histogram = stored(rows.groupBy("stratum", "rule", "value").agg(
        count(held & good)("held"), count(~held & good)("good"), count(~held & ~good)("bad")), "quality-histogram")
    strata = histogram.where(F.col("rule") == next(iter(RULES))).groupBy("stratum").agg(F.sum("held").alias("n"))
    bounds = most_failures(strata, risk / len(RULES), error / (len(RULES) * max(1, strata.count())))
    down = Window.partitionBy("stratum", "rule").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
    summed = histogram.select("stratum", "rule", "value", F.sum("held").over(down).alias("lost"),
                              (F.sum("bad").over(down) - F.sum("good").over(down)).alias("gain"))
    safe = summed.join(bounds.withColumnRenamed("stratum", "of"), F.col("stratum").eqNullSafe(F.col("of"))).where("lost <= allowed and gain > 0")
    best = safe.groupBy("stratum", "rule").agg(F.max(F.struct("gain", "value")).alias("best"))
    return best.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("best.value"))).alias(r) for r in RULES])


def with_verdicts(features: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds base_failed and kept to features (stratum, measures): rows that fail the base rules or
    reach a cutoff of their stratum are not kept."""
    limits = limits.withColumnsRenamed({c: f"{c}_cutoff" for c in limits.columns})
    reached = F.lit(False)
    for rule in RULES:
        reached = reached | F.coalesce(_value(rule) >= F.col(f"{rule}_cutoff"), F.lit(False))
    joined = features.join(limits, features.stratum.eqNullSafe(limits.stratum_cutoff), "left")
    return joined.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & ~reached}).drop(*limits.columns)


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
           risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(id, stratum, measures, base_failed, kept) of every row; see `measured` and `cutoffs`.
    labels has the id column and quality. Rows of a null stratum are a stratum, rows without
    words fail. Repeated rows stay (and count), other columns are not read."""
    own = docs.select(F.col(id_col).alias("id"), F.col(stratum_col).alias("stratum"), F.col(text_col).alias("text"))
    features = stored(measured(own, "id", "stratum"), "quality-features")
    return with_verdicts(features, cutoffs(features, labels.select(F.col(id_col).alias("id"), "quality"), risk, error))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("doc_id"), *MEASURES[:5], "base_failed", "kept")


_SPACES_SQL = " || ".join(f"chr({ord(c)})" for c in SPACES)
_RULES_SQL = {r: v.replace(" div ", " // ") for r, v in RULES.items()}

OP13_SQL = f"""
WITH texts AS (
    SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text, translate(coalesce(text, ''), {_SPACES_SQL}, '     ') AS bare FROM documents
), listed AS (
    SELECT *, list_filter(string_split(bare, ' '), lambda x: x <> '') AS words,
           list_filter(string_split(text, chr(10)), lambda x: trim(x, {_SPACES_SQL} || ' ') <> '') AS lines FROM texts
), placed AS (
    SELECT r, unnest(range(1, len(words) - 1)) AS i, unnest(words[1:len(words) - 2]) AS a, unnest(words[2:len(words) - 1]) AS b, unnest(words[3:]) AS c
    FROM listed WHERE len(words) >= 3
), windows AS (
    SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS times FROM placed
), repeated AS (
    SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM windows WHERE times > 1) GROUP BY r
), measures AS (
    SELECT l.r, doc_id, lang, len(words)::BIGINT AS n_words, length(replace(bare, ' ', ''))::BIGINT AS word_chars,
           (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
           coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines
    FROM listed AS l LEFT JOIN repeated AS p ON p.r = l.r
), features AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measures
), known AS (
    SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY doc_id
), checked AS (
    SELECT doc_id, quality, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(doc_id::VARCHAR)),
        lambda i: ascii((doc_id::VARCHAR)[i + 1])::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
        lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 3 = 0 AS chooses FROM known
), valued AS (
    SELECT f.*, quality, chooses, rule, least(value, {TOP}) AS value FROM (
        {' UNION ALL '.join(f"SELECT r, '{r}' AS rule, {v} AS value FROM features WHERE n_words > 0" for r, v in _RULES_SQL.items())}
    ) AS v JOIN features AS f ON f.r = v.r LEFT JOIN checked AS c ON c.doc_id = f.doc_id
), histogram AS (
    SELECT lang, rule, value, count(*) FILTER (WHERE NOT chooses AND quality = 1) AS held,
           count(*) FILTER (WHERE chooses AND quality = 0) - count(*) FILTER (WHERE chooses AND quality = 1) AS gain
    FROM valued WHERE quality IS NOT NULL AND NOT base_failed GROUP BY ALL
), strata AS (
    SELECT lang, sum(held) AS n, count(*) OVER () AS strata FROM histogram WHERE rule = 'symbols' GROUP BY lang
), chances AS (
    SELECT lang, strata, k, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({RISK / len(RULES)}) + (n - k) * ln(1 - {RISK / len(RULES)})))
           OVER (PARTITION BY lang ORDER BY k) AS below
    FROM (SELECT lang, strata, n::DOUBLE AS n, unnest(range(floor(n * {RISK / len(RULES)})::BIGINT + 1)) AS k FROM strata)
), bounds AS (
    SELECT lang, max(k) AS allowed FROM chances WHERE below <= {ERROR / len(RULES)} / strata GROUP BY lang
), summed AS (
    SELECT lang, rule, value, sum(held) OVER w AS lost, sum(gain) OVER w AS gain FROM histogram
    WINDOW w AS (PARTITION BY lang, rule ORDER BY value DESC)
), best AS (
    SELECT s.lang, rule, arg_max(value, gain * {2 * TOP} + value) AS cutoff
    FROM summed AS s JOIN bounds AS b ON s.lang IS NOT DISTINCT FROM b.lang WHERE lost <= allowed AND gain > 0 GROUP BY s.lang, rule
), reached AS (
    SELECT DISTINCT r FROM valued AS v JOIN best AS b ON b.lang IS NOT DISTINCT FROM v.lang AND b.rule = v.rule AND v.value >= b.cutoff
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND x.r IS NULL AS kept
FROM features AS f LEFT JOIN reached AS x ON x.r = f.r
"""
