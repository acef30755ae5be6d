"""Quality rules: a table of thresholds compiled into one projection of built-in expressions.

Each rule of ``RULES`` is integer arithmetic over the measures, so that Spark and any SQL engine agree on every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, fresh, whole

#: Frequent function words of the corpus' languages, as they stand in a text after lower-casing.
STOP_WORDS = (
    "the of and to in is that it for with as was on are by this be at or an from have not which but had his "
    "der die das und den mit von für auf ist im ein eine nicht sich auch zu des dem als "
    "de la le les un une des du que qui dans pour par sur est au avec et en à il "
    "el los las y del se con una para es lo como por no"
).split()
SYMBOLS = "#*$%&|<>"
SHINGLE = 5

#: (name, applies from so many words on, "reject if" a * measure {<,>} b * measure). The first two are the base rules.
RULES: tuple[tuple[str, int, int, str, str, int, str], ...] = (
    ("too_short", 0, 1, "n_words", "<", 10, "one"),
    ("repeated_words", 0, 100, "n_repeat_words", ">", 20, "n_words"),
    ("words_too_short", 10, 1, "word_chars", "<", 2, "n_words"),
    ("words_too_long", 10, 1, "word_chars", ">", 12, "n_words"),
    ("symbols", 10, 100, "n_symbols", ">", 10, "n_words"),
    ("few_stop_words", 50, 100, "n_stop_words", "<", 10, "n_words"),
    ("duplicate_lines", 0, 100, "n_dup_lines", ">", 40, "n_lines"),
    ("bullet_lines", 50, 100, "n_bullet_lines", ">", 90, "n_lines"),
    ("ellipsis_lines", 50, 100, "n_ellipsis_lines", ">", 40, "n_lines"),
)
BASE = 2

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_bullet_lines", "n_ellipsis_lines")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``MEASURES`` (long). Working columns have names that ``docs`` has not."""
    own, words, lines, placed, again = (fresh(docs, f"_q_{n}") for n in ("text", "words", "lines", "runs", "twice"))
    stops = [w + tail for w in dict.fromkeys(STOP_WORDS) for tail in ("", ".", ",")]
    df = docs.withColumn(own, whole(text))
    df = df.withColumn(words, F.filter(F.split(own, SPACES), lambda w: w != ""))
    df = df.withColumn(lines, F.filter(F.split(own, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size(words)
    word = lambda i: F.element_at(words, i)
    runs = F.transform(F.sequence(F.lit(1), n - (SHINGLE - 1)), lambda i: F.struct(F.xxhash64(*(word(i + k) for k in range(SHINGLE))).alias("h"), i.alias("i")))
    df = df.withColumn(placed, F.when(n >= SHINGLE, F.array_sort(runs)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    # equal runs of words stand side by side now; get() is null outside of the array
    hash_at = lambda i: F.get(placed, i).getField("h")
    twice = F.filter(placed, lambda x, i: F.coalesce(hash_at(i - 1) == x["h"], F.lit(False)) | F.coalesce(hash_at(i + 1) == x["h"], F.lit(False)))
    df = df.withColumn(again, F.array_sort(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform(again, lambda x, i: F.least(F.lit(SHINGLE), F.coalesce(F.get(again, i + 1) - x, F.lit(SHINGLE)))), F.lit(0), lambda a, x: a + x
    )
    long = lambda c: c.cast("long")
    count = lambda c, f: long(F.size(F.filter(c, f)))
    df = df.withColumns({
        "n_words": long(n),
        "word_chars": long(F.length(F.array_join(words, ""))),
        "n_symbols": long(F.length(own) - F.length(F.translate(own, SYMBOLS, ""))),
        "n_dup_lines": long(F.size(lines) - F.size(F.array_distinct(lines))),
        "n_repeat_words": long(covered),
        "n_lines": long(F.size(lines)),
        "n_stop_words": count(words, lambda w: F.lower(w).isin(stops)),
        "n_bullet_lines": count(lines, lambda x: x.rlike(r"^[\x20\x09]*[-*•]")),
        "n_ellipsis_lines": count(lines, lambda x: x.endswith("...") | x.endswith("…")),
    })
    return df.drop(own, words, lines, placed, again)


def broken(rule: tuple) -> str:
    """The condition under which ``rule`` rejects, as SQL."""
    _, least, a, left, sign, b, right = rule
    rhs = f"{b}" if right == "one" else f"{b} * {right}"
    return f"(n_words >= {least} and {a} * {left} {sign} {rhs})"


def verdict(rules: tuple = RULES) -> tuple[Column, Column]:
    """(base_failed, kept)."""
    return F.expr(" or ".join(map(broken, rules[:BASE]))), F.expr("not (" + " or ".join(map(broken, rules)) + ")")


def quality_rules(docs: DataFrame, text: str = "text", rules: tuple = RULES) -> DataFrame:
    """``docs`` with the measures, base_failed and kept; a row for each row, others' columns untouched.

    A null text is an empty one: it has no words, and fails. Columns of the measures' names are replaced.
    """
    failed, kept = verdict(rules)
    # a filter on kept must not be pushed below, where it would repeat the measures' expressions within each other
    kept = kept & (F.monotonically_increasing_id() >= 0)
    return measured(docs, text).withColumns({"base_failed": failed, "kept": kept})


_LIST = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
#: The same in DuckDB; ``{documents}`` is the table. Rows are told apart by a number, as ids may repeat.
MEASURED_SQL = rf"""
q0 as (select *, row_number() over () as q_row, coalesce(text, '') as q_text from {{documents}}),
q1 as (select *, list_filter(regexp_split_to_array(q_text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as q_words,
  list_filter(string_split(q_text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as q_lines from q0),
q2 as (select q_row, unnest(range(1, len(q_words) - {SHINGLE - 2})) as i, q_words from q1),
q3 as (select q_row, i, count(*) over (partition by q_row, list_slice(q_words, i, i + {SHINGLE - 1})) as n from q2),
q4 as (select q_row, count(distinct i + k) as n_repeat_words from q3, (select unnest(range(0, {SHINGLE})) as k) where n > 1 group by q_row),
q5 as (select q1.*, len(q_words) as n_words, coalesce(list_sum(list_transform(q_words, lambda x: length(x))), 0)::bigint as word_chars,
  (length(q_text) - length(translate(q_text, '{SYMBOLS}', '')))::bigint as n_symbols,
  len(q_lines) - len(list_distinct(q_lines)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, len(q_lines) as n_lines,
  len(list_filter(q_words, lambda x: regexp_replace(lower(x), '[.,]$', '') in ({_LIST}))) as n_stop_words,
  len(list_filter(q_lines, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) as n_bullet_lines,
  len(list_filter(q_lines, lambda x: suffix(x, '...') or suffix(x, '…'))) as n_ellipsis_lines
  from q1 left join q4 using (q_row)),
q6 as (select *, {' or '.join(map(broken, RULES[:BASE]))} as base_failed, not ({' or '.join(map(broken, RULES))}) as kept from q5)
"""
SQL = "with " + MEASURED_SQL.format(documents="documents") + " select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept from q6"
