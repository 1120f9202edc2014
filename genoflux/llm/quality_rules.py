"""Quality rules as a short-circuit cascade, on DataFrame and SQL functions alone.

Each rule has a rejection test (a SQL condition on `text` and the base columns). On a hashed sample of rows that pass the base the
cascade measures what a rule costs (the least time of several passes over the sample, less that of a pass without a rule, so that
a job's own overhead is not counted) and what it rejects; rules are then ordered by rejections per cost, and one CASE
evaluates them in that order, so a row pays for no rule after the first that rejects it, and a row that fails the base for none. The
costly rules read every word or line; they are conditions of their own, not columns, so that only rows that reach them pay. The
order decides speed only: kept is the same in any order.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Words are runs of characters other than blank and the controls 9 to 13.
GAP = r"[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Rows that costs and selectivities are measured on (twice as many at most), parts they lie in, and passes over them for each rule.
SAMPLE, PARTS, PASSES = 2000, 4, 1


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: str
    """SQL condition over the columns of the table; null counts as not rejecting."""


def with_words(docs: DataFrame) -> DataFrame:
    """Adds words (array of string; empty for a null or blank text)."""
    return docs.withColumn("words", F.expr(rf"filter(split(coalesce(cast(text as string), ''), '{GAP}'), w -> w != '')"))


def base_columns(docs: DataFrame) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of each text; a null text has no words.

    Repeats: 3-word windows are hashed, sorted with their places, and those equal to a neighbour are put back in text order; each
    adds the words that the one before did not cover. Texts whose windows are all distinct skip the sort.
    """
    text = "coalesce(cast(text as string), '')"
    df = with_words(docs)
    df = df.withColumn("n_words", F.expr("cast(size(words) as long)"))
    df = df.withColumn("word_chars", F.expr(f"cast(length(translate({text}, ' \\t\\n\\u000B\\u000C\\r', '')) as long)"))
    df = df.withColumn("n_symbols", F.expr(f"cast(length({text}) - length(translate({text}, '{SYMBOLS}', '')) as long)"))
    df = df.withColumn("_lines", F.expr(rf"filter(split({text}, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"))
    df = df.withColumn("n_dup_lines", F.expr("cast(size(_lines) - size(array_distinct(_lines)) as long)"))
    df = df.withColumn("_grams", F.expr("case when n_words >= 3 then zip_with(zip_with(slice(words, 1, size(words) - 2), slice(words, 2, size(words) - 2), (a, b) -> xxhash64(a, b)), slice(words, 3, size(words) - 2), (h, c) -> xxhash64(h, c)) else cast(array() as array<long>) end"))
    places = "sort_array(transform(_grams, (h, i) -> struct(h, i)))"
    same = "filter(transform(s, (x, i) -> if((i > 0 and s[i - 1].h = x.h) or (i < size(s) - 1 and s[i + 1].h = x.h), x.i, -1)), i -> i >= 0)"
    covered = "aggregate(sort_array(p), struct(cast(0 as long) as n, -3 as last), (acc, i) -> struct(acc.n + least(3, i - acc.last) as n, i as last), acc -> acc.n)"
    repeat = f"element_at(transform(array({places}), s -> element_at(transform(array({same}), p -> {covered}), 1)), 1)"
    df = df.withColumn("n_repeat_words", F.expr(f"case when size(array_distinct(_grams)) = size(_grams) then cast(0 as long) else {repeat} end"))
    return df.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")).drop("_lines", "_grams")


_TEXT = "coalesce(cast(text as string), '')"

#: Beyond the base: junk that no prose in any language comes near. The first three read base columns; the others read the text.
RULES = (
    Rule("symbols", "10 * n_symbols > word_chars"),
    Rule("dup_lines", f"n_dup_lines >= 5 and 2 * n_dup_lines > size(split({_TEXT}, '\\n'))"),
    Rule("word_length", "word_chars > 25 * n_words or word_chars < 2 * n_words"),
    Rule("letters", rf"2 * length(regexp_replace({_TEXT}, '[^\\p{{L}}]+', '')) < word_chars"),
    Rule("few_words", "50 * size(array_distinct(words)) < least(n_words, 2000)"),
    Rule("one_word", "2 * aggregate(sort_array(words), struct(cast(0 as long) as best, cast(0 as long) as run, '' as last), (a, w) -> struct(greatest(a.best, if(w = a.last, a.run + 1, 1L)) as best, if(w = a.last, a.run + 1, 1L) as run, w as last), a -> a.best) > n_words"),
    Rule("cut_lines", f"size(split({_TEXT}, '\\n')) >= 10 and 10 * size(filter(split({_TEXT}, '\\n'), x -> endswith(rtrim(x), '...') or endswith(rtrim(x), '\u2026'))) > 9 * size(split({_TEXT}, '\\n'))"),
)


def hashed_sample(docs: DataFrame, sample: int) -> DataFrame:
    """About `sample` rows of the whole table and never more than twice as many, by a hash of a row's place and doc_id, so that ids which
    are null or repeat are drawn no more often than others."""
    share = min(1.0, sample / max(1, docs.count()))
    rows = docs.where(F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(1 << 20)) <= F.lit(int(share * (1 << 20))))
    return rows.limit(2 * sample)


def measured_order(docs: DataFrame, rules=RULES, passes: int = PASSES) -> list[tuple[Rule, float, float]]:
    """(rule, rejected share, seconds) over sampled rows, in the order to apply the rules: most rejections per second first; rules that
    reject none come last, the cheapest first; equal ones go by name. It orders the rules and decides no row. The sample is written once."""
    scratch = Scratch(docs.sparkSession)
    held = scratch.write(docs)

    def timed(condition: str) -> tuple[int, float]:
        took = []
        for _ in range(passes):
            began = time.perf_counter()
            n = held.agg(F.count_if(F.expr(f"coalesce({condition}, false)"))).first()[0]
            took.append(time.perf_counter() - began)
        return n, min(took)

    rows = max(1, timed("true")[0])
    _, empty = timed("n_words < 0")
    out = []
    for r in rules:
        rejected, took = timed(r.rejects)
        out.append((r, rejected / rows, max(took - empty, 1e-4)))
    scratch.drop(held)
    return sorted(out, key=lambda x: (-x[1] / x[2], x[2] if not x[1] else 0, x[0].name))


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects the row, in this order; null if none does. Later rules are not evaluated."""
    out = None
    for r in rules:
        test = F.coalesce(F.expr(r.rejects), F.lit(False))
        out = F.when(test, r.name) if out is None else out.when(test, r.name)
    return out if out is not None else F.lit(None).cast("string")


def quality_verdicts(docs: DataFrame, rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept.

    A null, empty or blank text has no words, so base_failed is true. Whole texts are judged, however long. Rows that repeat are
    judged each; other columns are ignored, whatever their names; an empty table gives an empty one. kept is false where the base
    fails or a rule rejects; rules of equal rejections per cost go by name.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [r for r, _, _ in measured_order(base_columns(hashed_sample(rows, sample).repartition(PARTS)).where("not base_failed"), rules)]
    df = base_columns(rows).withColumn("kept", F.when(F.col("base_failed"), False).otherwise(cascade(order).isNull()))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
