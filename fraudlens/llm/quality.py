"""Operator 2, quality rules: a threshold table compiled into one projection.

Only DataFrame functions are used. ``measure`` adds the text statistics,
``compile_rules`` turns the table of ``Rule`` rows into two columns (the
names of the broken rules, and the verdict), and ``apply_rules`` does both.
No step shuffles: every statistic belongs to one text and is computed in its
row.

Edge cases: a null or blank text has no words, so every count is 0 and the
text is rejected by the length rule. A text of any length is read whole.
Repeated rows are judged alike, one output row each; an empty table gives an
empty result. Input columns pass through unchanged; where one has the name of a
statistic, the statistic gets a fresh name, which is returned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudlens.llm.common import WS, WS_CLASS, fresh

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "a an and are as at be by for from had have in is it not of on or that the this to was were with "
    "als auf aus bei das dem den der des die ein eine es für im in ist mit nicht sich und von wie zu "
    "au aux avec ce dans de des du elle en est et il la le les par pas pour que qui sur un une "
    "al con de del el en es la las lo los no para por que se su un una y"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= metric <= high``; a bound of None is open."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: Base rules: too short, or mostly made of repeated three-word windows.
BASE_RULES = (
    Rule("too_short", "n_words", low=50),
    Rule("repetition", "repeat_word_ratio", high=0.5),
)

#: The method's own rules on length, symbol, stop-word and line ratios.
RULES = (
    Rule("word_length", "mean_word_chars", low=2.5, high=12.0),
    Rule("symbols", "symbol_ratio", high=0.1),
    Rule("exclamation", "exclamation_ratio", high=0.3),
    Rule("capitals", "capital_ratio", high=0.3),
    Rule("stop_words", "stop_word_ratio", low=0.05),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
    Rule("ellipsis_lines", "ellipsis_line_ratio", high=0.5),
    Rule("bullet_lines", "bullet_line_ratio", high=0.9),
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _ratio(n: Column, d: Column) -> Column:
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


def _repeat_positions(ranked: Column) -> Column:
    """Sorted positions of the windows that occur twice or more.

    ``ranked`` is the sorted array of (window hash, position); equal
    neighbours are repeats. Their positions, sorted, cover 3 words each,
    less the overlap with the next one."""
    n = F.size(ranked)
    twice = F.filter(ranked, lambda x, i: ((i > 0) & (F.get(ranked, i - 1)["h"] == x["h"]))
                     | ((i + 1 < n) & (F.get(ranked, i + 1)["h"] == x["h"])))
    return F.sort_array(F.transform(twice, lambda x: x["p"]))


def measure(df: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``df`` with one column per statistic; returns it and their names.

    The stages are separate projections of flat columns, each used more than
    once by the next: Catalyst then keeps them apart and computes each array
    (words, window hashes) once per row. (Fields of a struct column would be
    inlined into every use instead.)"""
    w, h, s, p, ln = fresh(df, "w__", "h__", "s__", "p__", "ln__")
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    body = F.btrim(t, F.lit(WS))
    words = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, WS_CLASS + "+"))
    d = df.withColumns({
        w: words,
        ln: F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WS)) != ""),
    })
    n = F.size(w)
    # xxhash64 of three consecutive words stands for the window
    d = d.withColumn(h, F.when(n < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))),
                    lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))))
    # only texts that hold a repeated window sort their windows
    d = d.withColumn(s, F.when(F.size(F.array_distinct(h)) < F.size(h),
                               F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))))
                     .otherwise(F.array().cast("array<struct<h:bigint,p:int>>")))
    d = d.withColumn(p, _repeat_positions(F.col(s)))
    repeat = F.when(F.size(p) == 0, F.lit(0).cast("long")).otherwise(
        F.aggregate(  # least() skips the null after the last position
            F.sequence(F.lit(0), F.size(p) - 1), F.lit(0).cast("long"),
            lambda acc, i: acc + F.least(F.lit(3), F.get(p, i + 1) - F.get(p, i))))
    lines = F.size(ln)
    stats = {
        "n_words": n,
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")),
        "n_dup_lines": lines - F.size(F.array_distinct(ln)),
        "n_repeat_words": repeat,
        "n_lines": lines,
        "n_exclamations": F.regexp_count(t, F.lit("!")),
        "n_capitals": F.regexp_count(t, F.lit("[A-Z]")),
        "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))),
        "n_ellipsis": F.size(F.filter(ln, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))),
        "n_bullets": F.size(F.filter(ln, lambda x: F.ltrim(x).substr(1, 1).isin("-", "*", "•"))),
    }
    names = dict(zip(stats, fresh(d, *stats)))
    # inline() of one struct keeps a later filter on a statistic from being
    # pushed below, where each use would repeat the work of the arrays
    row = F.array(F.struct(*[c.cast("long").alias(names[k]) for k, c in stats.items()]))
    return d.select(*[F.col(f"`{c}`") for c in df.columns], F.inline(row)), names


def metrics(names: dict[str, str]) -> dict[str, Column]:
    """The ratios that rules speak of, from the statistics columns."""
    c = {k: F.col(v) for k, v in names.items()}
    return {
        "n_words": c["n_words"],
        "repeat_word_ratio": _ratio(c["n_repeat_words"], c["n_words"]),
        "mean_word_chars": _ratio(c["word_chars"], c["n_words"]),
        "symbol_ratio": _ratio(c["n_symbols"], c["n_words"]),
        "exclamation_ratio": _ratio(c["n_exclamations"], c["n_words"]),
        "capital_ratio": _ratio(c["n_capitals"], c["word_chars"]),
        "stop_word_ratio": _ratio(c["n_stop_words"], c["n_words"]),
        "dup_line_ratio": _ratio(c["n_dup_lines"], c["n_lines"]),
        "ellipsis_line_ratio": _ratio(c["n_ellipsis"], c["n_lines"]),
        "bullet_line_ratio": _ratio(c["n_bullets"], c["n_lines"]),
    }


def compile_rules(rules, names: dict[str, str]) -> Column:
    """Names of the broken rules, as one array expression."""
    known = metrics(names)
    broken = []
    for r in rules:
        x = known[r.metric]
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (x < F.lit(r.low))
        if r.high is not None:
            bad = bad | (x > F.lit(r.high))
        broken.append(F.when(bad, F.lit(r.name)))
    return F.array_compact(F.array(*broken))


def apply_rules(df: DataFrame, text: str = "text", base=BASE_RULES, rules=RULES) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with the statistics, the broken rules' names (``base_broken``,
    ``broken``), ``base_failed`` and ``kept``. Returns it and the columns'
    names, which are made fresh where ``df`` has such columns already."""
    d, names = measure(df, text)
    names |= dict(zip(("base_broken", "broken"), fresh(d, "base_broken", "broken")))
    d = d.withColumns({names["base_broken"]: compile_rules(base, names), names["broken"]: compile_rules(rules, names)})
    names |= dict(zip(("base_failed", "kept"), fresh(d, "base_failed", "kept")))
    return d.withColumns({
        names["base_failed"]: F.size(names["base_broken"]) > 0,
        names["kept"]: (F.size(names["base_broken"]) == 0) & (F.size(names["broken"]) == 0),
    }), names


def quality_query(docs: DataFrame) -> DataFrame:
    """Contract of ``op2``: counts, base verdict and verdict per document."""
    d, _ = apply_rules(docs.select("doc_id", "text"))
    return d.select("doc_id", *COUNTS, "base_failed", "kept")


def _sql_rule(r: Rule) -> str:
    parts = [f"{r.metric} < {r.low}" if r.low is not None else "", f"{r.metric} > {r.high}" if r.high is not None else ""]
    return " OR ".join(p for p in parts if p)


def oracle_sql(base=BASE_RULES, rules=RULES) -> str:
    """The same result as one DuckDB query, from the same threshold table."""
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    space = r"[\x20\x09-\x0D]"
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS tx FROM documents),
w AS (SELECT rid, doc_id, tx, regexp_extract_all(tx, '{space.replace("[", "[^")}+') AS ws,
             list_filter(string_split(tx, chr(10)), lambda x: regexp_matches(x, '{space.replace("[", "[^")}')) AS ln FROM t),
tri AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM tri) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + j) AS n FROM dup, (VALUES (0), (1), (2)) v(j) GROUP BY rid),
c AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(tx, '{space}', '', 'g')) AS word_chars,
             length(tx) - length(regexp_replace(tx, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ln) - len(list_distinct(ln)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
             len(ln) AS n_lines, length(tx) - length(replace(tx, '!', '')) AS n_exclamations,
             length(tx) - length(regexp_replace(tx, '[A-Z]', '', 'g')) AS n_capitals,
             len(list_filter(ws, lambda x: lower(x) IN ({stop}))) AS n_stop_words,
             len(list_filter(ln, lambda x: rtrim(x) LIKE '%...' OR rtrim(x) LIKE '%…')) AS n_ellipsis,
             len(list_filter(ln, lambda x: ltrim(x)[1] IN ('-', '*', '•'))) AS n_bullets
      FROM w LEFT JOIN cov USING (rid)),
m AS (SELECT *, coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeat_word_ratio,
             coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars,
             coalesce(n_symbols / nullif(n_words, 0), 0) AS symbol_ratio,
             coalesce(n_exclamations / nullif(n_words, 0), 0) AS exclamation_ratio,
             coalesce(n_capitals / nullif(word_chars, 0), 0) AS capital_ratio,
             coalesce(n_stop_words / nullif(n_words, 0), 0) AS stop_word_ratio,
             coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio,
             coalesce(n_ellipsis / nullif(n_lines, 0), 0) AS ellipsis_line_ratio,
             coalesce(n_bullets / nullif(n_lines, 0), 0) AS bullet_line_ratio FROM c),
v AS (SELECT *, ({" OR ".join(map(_sql_rule, base))}) AS base_failed, ({" OR ".join(map(_sql_rule, rules))}) AS broken FROM m)
SELECT doc_id, {", ".join(f"{k}::BIGINT AS {k}" for k in COUNTS)}, base_failed, NOT (base_failed OR broken) AS kept FROM v
"""
