"""Quality rules: a threshold table compiled into one projection of built-in functions.

Words are maximal runs of characters other than space and U+0009 to U+000D. A rule names a measure, bounds, and the
least number of words from which it applies. Nothing here leaves the JVM; no shuffle is needed.

Defined results: a null text has no words, hence fails the base rules; texts of any length are measured whole;
repeated rows and null ids come back as they are; an empty table gives an empty result; extra columns are kept by
`keep_clean` and ignored by `measure`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 8

# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is it for with that on as was are be by this from or an at "
    "le la les de du des et un une est que qui en dans pour sur au aux par pas "
    "der die das und ist nicht ein eine von mit zu den auf für dem "
    "el los las y es no una por con para se lo del al su"
).split()


@dataclass(frozen=True)
class Rule:
    """measure / per lies within [low, high] in every text of at least `words` words; without a ratio (per is 0) it holds."""

    name: str
    measure: str
    per: str
    low: float | None = None
    high: float | None = None
    words: int = 0


RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.25),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.6, 20),
    Rule("stop_words", "n_stop", "n_words", 0.02, None, 100),
)


def measures(text: str) -> list[tuple[str, Column]]:
    """Named expressions in the order in which they build on one another; each is computed once."""
    array_of_none = F.array().cast("array<struct<h:bigint,p:int>>")
    size = F.size("words")
    windows = F.when(size >= WINDOW, F.transform(F.sequence(F.lit(1), size - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    ordered = F.sort_array(F.transform("windows", lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
    same = lambda s, k: F.coalesce(s["h"] == F.get("ordered", k)["h"], F.lit(False))
    again = F.transform("ordered", lambda s, k: F.when(same(s, k - 1) | same(s, k + 1), s["p"]))
    covered = F.transform("places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("places", k + 1) - p, F.lit(WINDOW))))
    lines = F.filter(F.split(F.col(text), "\n"), lambda line: line.rlike(WORD))
    return [
        ("words", F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))),
        ("windows", windows),
        ("lines", lines),
        ("ordered", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), ordered).otherwise(array_of_none)),
        ("places", F.sort_array(F.filter(again, lambda p: p.isNotNull()))),
        ("n_words", size.cast("long")),
        ("word_chars", F.char_length(F.array_join("words", "")).cast("long")),
        ("n_symbols", F.regexp_count(F.col(text), F.lit("[#*$%&|<>]")).cast("long")),
        ("n_lines", F.size("lines").cast("long")),
        ("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")),
        ("n_repeat_words", F.aggregate(covered, F.lit(0), lambda a, b: a + b).cast("long")),
        ("n_stop", F.size(F.filter("words", lambda w: w.isin(*STOP_WORDS))).cast("long")),
    ]


def verdicts(rules=RULES) -> tuple[Column, Column]:
    """(base_failed, kept) over the measures: the rule table as one expression."""
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    kept = ~base_failed
    for rule in rules:
        value, ok = F.try_divide(rule.measure, rule.per), F.lit(True)
        if rule.low is not None:
            ok = ok & (value >= rule.low)
        if rule.high is not None:
            ok = ok & (value <= rule.high)
        kept = kept & ((F.col("n_words") < rule.words) | F.coalesce(ok, F.lit(True)))
    return base_failed, kept


def judge(docs: DataFrame, rules=RULES, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns (prefixed), all measures, base_failed and kept, one row per row of docs.

    A filter on a verdict must not be pushed below the projection, where every measure would be computed again for
    each use of it; a row number in the verdicts prevents that.
    """
    rows = docs.select(F.coalesce(docs[text].cast("string"), F.lit("")).alias("whole_text"), *[docs[c].alias(f"keep_{i}") for i, c in enumerate(keep)])
    for name, expression in measures("whole_text"):
        rows = rows.withColumn(name, expression)
    base_failed, kept = verdicts(rules)
    numbered = F.monotonically_increasing_id() >= 0  # keeps filters on the verdicts above this projection
    return rows.withColumns({"base_failed": base_failed & numbered, "kept": kept & numbered})


def measure(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    found = judge(docs, rules)
    return found.select(F.col("keep_0").cast("long").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_clean(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of docs that pass all rules, with all their columns."""
    names = docs.columns
    return judge(docs, rules, keep=tuple(names)).where("kept").select(*[F.col(f"keep_{i}").alias(c) for i, c in enumerate(names)])


def _sql() -> str:
    tests = []
    for r in RULES:
        value = f"{r.measure} * 1.0 / nullif({r.per}, 0)"
        bounds = [f"{value} >= {r.low}"] * (r.low is not None) + [f"{value} <= {r.high}"] * (r.high is not None)
        tests.append(f"(n_words < {r.words} OR coalesce({' AND '.join(bounds)}, true))")
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), split AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM base
), grams AS (
  SELECT rid, p, array_to_string(ws[p:p + {WINDOW - 1}], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS p FROM split)
), twice AS (
  SELECT rid, p FROM grams QUALIFY count(*) OVER (PARTITION BY rid, g) > 1
), covered AS (
  SELECT rid, sum(c) AS n FROM (SELECT rid, least({WINDOW}, coalesce(lead(p) OVER (PARTITION BY rid ORDER BY p) - p, {WINDOW})) AS c FROM twice) GROUP BY rid
), measured AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(ls) AS n_lines,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(ws, lambda w: w IN ({stop}))) AS n_stop
  FROM split LEFT JOIN covered c USING (rid)
), based AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND {' AND '.join(tests)}) AS kept FROM based
"""


SQL = _sql()
