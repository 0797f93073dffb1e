"""Line-first quality rules, in built-in expressions only.

Each line is judged by itself (punctuation, navigation, boilerplate).  Failing lines are removed; a document that loses
too much of its text that way is rejected, as is one that breaks the base limits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import SPACES, SPACES_PATTERN, words_of

SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›•·"
ENDS = r"[.!?…:;。！？][\"'”’»)\]]*$"
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "click here",
    "subscribe to our", "sign up for our", "enable javascript", "share this", "skip to content", "back to top",
)
WINDOW = 5


@dataclass(frozen=True)
class LineRules:
    """Limits of the rules; percentages are of the line's or the document's own size."""

    min_words: int = 10
    max_repeat_percent: int = 20
    max_separator_percent: int = 25  # separators per word: link lists
    max_symbol_percent: int = 5  # symbols per character of words
    max_shout_percent: int = 20  # doubled exclamation marks per word
    fragment_words: int = 3  # an unended line of at most so many words is a label, not a sentence
    max_lost_percent: int = 50


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _line_fails(line: Column, words: Column, chars: Column, rules: LineRules) -> Column:
    trimmed = F.rtrim(F.translate(line, SPACES, " " * len(SPACES)))
    navigation = 100 * _count(line, SEPARATORS) > rules.max_separator_percent * words
    symbols = 100 * _count(line, SYMBOLS.replace("|", "")) > rules.max_symbol_percent * chars
    shouting = 100 * (F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit("!")))) > rules.max_shout_percent * words
    fragment = (words <= rules.fragment_words) & ~trimmed.rlike(ENDS)
    boilerplate = F.lit(False)
    for phrase in BOILERPLATE:
        boilerplate = boilerplate | F.contains(F.lower(line), F.lit(phrase))
    return navigation | symbols | shouting | fragment | boilerplate


def _repeats(words: Column) -> Column:
    """Words inside windows of five that the text holds twice or more.

    Hashes of all windows are sorted; only a text with equal neighbours looks at positions, which are sorted with their
    hashes, so the cost is n log n for any text.  The words are bound by a lambda: if the optimizer moves this
    expression, they are still computed once for a text, not once for a window.
    """
    def window(w: Column) -> Column:
        n = F.size(w)
        return F.transform(
            F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>")),
            lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))),
        )

    def starts(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def again(p: Column) -> Column:
            def same(a: Column, i: Column, j: Column) -> Column:
                return F.coalesce(F.get(p, i)["h"] == F.get(p, j)["h"], F.lit(False))

            return F.array_sort(F.transform(
                F.filter(p, lambda x, i: same(p, i, i - 1) | same(p, i, i + 1)), lambda x: x["i"]))

        return F.transform(F.array(pairs), again)[0]

    def covered(s: Column) -> Column:
        gaps = F.transform(s, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def count(hashes: Column) -> Column:
        many = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(many, F.transform(F.array(starts(hashes)), covered)[0]).otherwise(F.lit(0))

    return F.transform(F.transform(F.array(words), window), count)[0].cast("long")


def quality(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """Add the base counts, the verdicts and the cleaned text to each row.

    Words are runs of characters other than the space and U+0009 to U+000D.  New columns: ``n_words``, ``word_chars``,
    ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``n_lines_removed``, ``lost_chars`` (word characters of removed
    lines), ``base_failed``, ``kept`` and ``clean_text`` (the lines left, in order; empty for null text).

    Null and empty text has no words, so it fails the base limits.  Rows are judged one by one: repeated rows get equal
    verdicts, an empty table gives an empty one, other columns pass through; an input column with the name of a new one
    is replaced.  Equality of windows is that of their 64-bit hashes.  There is no shuffle.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines_removed", "lost_chars",
            "base_failed", "kept", "clean_text"]
    docs = docs.drop(*(c for c in docs.columns if c in made and c != text))
    lines = F.transform(F.split(body, "\n"), lambda line: F.struct(
        line.alias("line"),
        F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
        _visible(line).alias("chars"),
    ))
    judged = F.transform(lines, lambda x: F.struct(
        x["line"].alias("line"), x["words"].alias("words"), x["chars"].alias("chars"),
        ((x["words"] > 0) & _line_fails(x["line"], x["words"], x["chars"], rules)).alias("fails")))
    named = docs.withColumns({"_words": words_of(F.col(text)), "_lines": judged})
    spoken = F.transform(F.filter("_lines", lambda x: x["words"] > 0), lambda x: x["line"])
    failed = F.filter("_lines", lambda x: x["fails"])
    counted = named.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": _visible(body).cast("long"),
        "n_symbols": _count(body, SYMBOLS).cast("long"),
        "n_dup_lines": F.transform(F.array(spoken), lambda s: F.size(s) - F.size(F.array_distinct(s)))[0].cast("long"),
        "n_repeat_words": _repeats(F.col("_words")),
        "n_lines_removed": F.size(failed).cast("long"),
        "lost_chars": F.aggregate(failed, F.lit(0).cast("long"), lambda a, x: a + x["chars"]),
        "clean_text": F.array_join(F.transform(F.filter("_lines", lambda x: ~x["fails"]), lambda x: x["line"]), "\n"),
    }).drop("_words", "_lines")
    base = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    lost = 100 * F.col("lost_chars") > rules.max_lost_percent * F.col("word_chars")
    return counted.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & ~lost)


def _visible(text: Column) -> Column:
    """Code points that are not white space."""
    return F.length(F.translate(text, SPACES, ""))


def without_rejected(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """The documents kept, with failing lines taken out of their text; all columns stay, ``n_chars`` follows the text."""
    judged = quality(docs.select(*docs.columns, F.struct("*").alias("_row")), rules, text)
    # a row number in the condition keeps it above the rules, which are then evaluated once
    judged = judged.withColumn("_at", F.monotonically_increasing_id()).where(F.col("kept") & (F.col("_at") >= 0))
    back = [F.col("clean_text").alias(text) if c == text
            else F.length("clean_text").cast("long").alias(c) if c == "n_chars" else F.col("_row")[c].alias(c)
            for c in docs.columns]
    return judged.select(*back)


BASE_SQL = rf"""
WITH body AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
word AS (SELECT rid, unnest(w) AS w, generate_subscripts(w, 1) AS pos
         FROM (SELECT rid, regexp_extract_all(text, '[^ \t\n\x0B\x0C\r]+') AS w FROM body)),
words AS (SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars FROM word GROUP BY rid),
windows AS (SELECT rid, pos, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o,
                   lead(w, 4) OVER o) AS k, lead(w, 4) OVER o AS last
            FROM word WINDOW o AS (PARTITION BY rid ORDER BY pos)),
twice AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, k) AS n FROM windows
                                WHERE last IS NOT NULL) WHERE n > 1),
repeats AS (SELECT rid, count(DISTINCT pos + d) AS n_repeat_words FROM twice, range(0, 5) AS r(d) GROUP BY rid),
line AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM body),
sized AS (SELECT rid, line, len(regexp_extract_all(line, '[^ \t\n\x0B\x0C\r]+')) AS words,
                 length(regexp_replace(line, '[ \t\n\x0B\x0C\r]+', '', 'g')) AS chars FROM line),
judged AS (SELECT *,
    100 * (length(line) - length(translate(line, '|»›•·', ''))) > 25 * words
    OR 100 * (length(line) - length(translate(line, '#*$%&<>', ''))) > 5 * chars
    OR 100 * (length(line) - length(replace(line, '!!', '!'))) > 20 * words
    OR (words <= 3 AND NOT regexp_matches(regexp_replace(line, '[ \t\n\x0B\x0C\r]+$', ''), '[.!?…:;。！？]["''”’»)\]]*$'))
    OR regexp_matches(lower(line), '{"|".join(BOILERPLATE)}') AS fails
    FROM sized WHERE words > 0),
lines AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines, sum(fails::INT) AS n_lines_removed,
                 sum(CASE WHEN fails THEN chars ELSE 0 END) AS lost_chars FROM judged GROUP BY rid),
counted AS (SELECT b.doc_id, b.text, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines_removed, 0)::BIGINT AS n_lines_removed, coalesce(lost_chars, 0)::BIGINT AS lost_chars
    FROM body b LEFT JOIN words USING (rid) LEFT JOIN repeats USING (rid) LEFT JOIN lines USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines_removed, lost_chars,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT 100 * lost_chars > 50 * word_chars AS kept
FROM counted"""
