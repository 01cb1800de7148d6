"""Quality rules as a short-circuit cascade. DataFrame functions only."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, text_of

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """rejects: whether a row with the columns of measured() goes. sql: the same in DuckDB SQL."""

    name: str
    rejects: Callable[[], Column]
    sql: str


#: Each share is over the words or lines of the text; all are far from what prose has.
RULES = (
    Rule("symbols", lambda: F.col("n_symbols") * 4 > F.col("n_words"), "n_symbols * 4 > n_words"),
    Rule("exclamations", lambda: (F.length("text") - F.length(F.replace("text", F.lit("!"), F.lit("")))) * 4 > F.col("n_words"), "(length(text) - length(replace(text, '!', ''))) * 4 > n_words"),
    Rule("repeated_lines", lambda: F.col("n_dup_lines") * 2 > F.size(F.filter(F.split("text", "\n"), has_word)), "n_dup_lines * 2 > len(lines)"),
    Rule("word_length", lambda: (F.col("word_chars") < F.col("n_words") * 2) | (F.col("word_chars") > F.col("n_words") * 20), "word_chars < n_words * 2 OR word_chars > n_words * 20"),
    Rule("capitals", lambda: F.length(F.regexp_replace("text", r"[^\p{Lu}]", "")) * 2 > F.col("word_chars"), r"length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) * 2 > word_chars"),
    # distinct words grow about as the square root of a text's length, with a factor of ten and more in prose
    Rule("few_distinct_words", lambda: F.pow(F.size(F.array_distinct("words")), F.lit(2)) < F.col("n_words") * 9, "pow(len(list_distinct(words)), 2) < n_words * 9"),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, also where body reads it for each element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def repeated_words(words: Column) -> Column:
    """How many words lie in 3-word windows that the text holds twice or more.

    Windows are compared by 64-bit hashes of their three words. A text whose windows are all distinct ends there;
    else windows are sorted by hash and those equal to a neighbour give their positions.
    """
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda a, b: F.coalesce(a == b, F.lit(False))
        twice = let(placed, lambda s: F.filter(s, lambda x, j: same(F.when(j > 0, F.get(s, j - 1)["h"]), x["h"]) | same(F.get(s, j + 1)["h"], x["h"])))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    return F.when(F.size(words) < 4, 0).otherwise(let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w))))


def measured(docs: DataFrame) -> DataFrame:
    """All columns of docs under `row`, with text, words and the base measures beside them."""
    rows = docs.select(F.struct("*").alias("row"), text_of().alias("text"))
    words = F.array_remove(F.split("text", SPACE + "+"), "")
    # bound by let(): were `words` a column of its own, a filter pushed below would split the text anew for each window
    of_words = let(words, lambda w: F.struct(w.alias("words"), F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")))
    lines = F.filter(F.split("text", "\n"), has_word)
    rows = rows.select("row", "text", of_words.alias("of_words")).select(
        "row", "text", "of_words.words", "of_words.n_words",
        F.length(without(F.col("text"), " \t\n\x0b\x0c\r")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        "of_words.n_repeat_words",
    )
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = 1000) -> list[Rule]:
    """The rules in falling order of rejections per cost.

    Both are estimated on those of the first `sample` texts that pass the base: a rule's cost is the time of a job
    that evaluates it over them, less that of a job that evaluates nothing. The texts are taken partition after
    partition until there are enough, so the sample's cost does not grow with the input. The order decides only how
    soon a bad text is left, never which texts are kept; so neither the sample nor a disturbed clock can change a
    result.
    """
    texts = [(r[0],) for r in docs.select(text_of()).head(sample)]
    part = measured(docs.sparkSession.createDataFrame(texts, "text string")).drop("row").cache()
    try:
        passed = part.filter(~F.col("base_failed"))
        total = passed.count()
        if not total:
            return list(rules)

        def run(column: Column) -> tuple[int, float]:
            began = time.perf_counter()
            return passed.agg(F.sum(column.cast("int"))).first()[0], time.perf_counter() - began

        run(F.lit(False))
        idle = run(F.lit(False))[1]
        value = {}
        for rule in rules:
            rejected, took = run(F.coalesce(rule.rejects(), F.lit(False)))
            value[rule.name] = (rejected + 0.5) / (total + 1) / max(took - idle, 1e-3)
        return sorted(rules, key=lambda r: -value[r.name])
    finally:
        part.unpersist()


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """measured() with kept: false where the base failed or any rule rejects.

    CASE stops at the first rule that rejects, so a later rule's expression is not evaluated for that row. Null texts
    have no words and fail the base; repeated rows are judged one by one.
    """
    rows = measured(docs)
    kept = F.when(F.col("base_failed"), False)
    for rule in cascade(docs, rules):
        kept = kept.when(rule.rejects(), False)
    return rows.withColumn("kept", kept.otherwise(True))


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the base measures, base_failed and kept of every whole text.

    Null and empty texts have no words and fail the base; a text of any length is measured whole; a text exactly at a
    rule's limit passes it; equal texts are judged alike and repeated rows one by one; extra columns are left out; an
    empty table gives no rows.
    """
    return judged(docs).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with all their columns; nulls, long texts and repeated rows as in quality(). Columns
    named like this operator's own keep their values, and an empty table stays empty.

    Rows pass by an outer explode, as a plain filter would be pushed below the measures and make them twice.
    """
    passed = judged(docs).select(F.explode_outer(F.when(F.col("kept"), F.array("row"))).alias("row"))
    return passed.filter(F.col("row").isNotNull()).select("row.*")


SQL = rf"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (SELECT r, unnest(range(1, len(words) - 1)) AS i, unnest(list_zip(words[1:len(words) - 2], words[2:len(words) - 1], words[3:])) AS gram
      FROM t WHERE len(words) > 2),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
cover AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY r),
m AS (
  SELECT doc_id, text, words, lines, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM t LEFT JOIN cover USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({" OR ".join(f"({r.sql})" for r in RULES)}) AS kept
FROM b
"""
