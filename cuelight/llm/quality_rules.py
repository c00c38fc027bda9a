"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

Each rule rejects a document on measures of its whole text. On a sample of documents, chosen by hash, each rule's
rejection rate and its cost, that of its measures included, are estimated, and the cascade tries the rules by rejection
per cost, so that later rules see only what the earlier ones let through. The verdict is the conjunction of all rules,
whatever their order. quality_documents() computes a measure only for documents that reach a rule which needs it;
quality_rules() returns all measures and so computes them for all documents.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelight.llm.common import WORD, free_name, written

#: Documents, about, on which costs and selectivities are estimated; the verdicts always cover all documents.
SAMPLE_ROWS = 2000
#: Runs of each rule over the sample; the shortest counts, as other work only adds to a run.
RUNS = 2
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """`rejects` is true for a document to reject. It may use columns of base_measures() and the text."""

    name: str
    rejects: Column


def repeated_words(words: Column) -> Column:
    """Words of a text that lie in a window of WINDOW words found twice or more in it, the first one included.

    Windows are compared by a 64-bit hash of their words. Sorting (hash, place) puts equal windows side by side;
    the places of windows with an equal neighbour, sorted again, give the covered words as a sum of steps.
    """
    n = F.size(words)
    places = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    keyed = F.transform(places, lambda i: F.struct(F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]).alias("h"), i.alias("i")))

    def twin_places(sorted_windows: Column) -> Column:
        h = lambda k: F.get(sorted_windows, k)["h"]
        twins = F.filter(sorted_windows, lambda x, k: (x["h"] == h(k - 1)) | (x["h"] == h(k + 1)))
        return F.sort_array(F.transform(twins, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("sum"))
        step = lambda acc, i: F.struct(i.alias("last"), (acc["sum"] + F.least(F.lit(WINDOW), i - acc["last"])).cast("long").alias("sum"))
        return F.aggregate(at, zero, step, lambda acc: acc["sum"])

    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    return once(once(F.sort_array(keyed), twin_places), covered)


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0)
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def base_measures(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every whole text.

    A null text counts as empty and has 0 of everything. Columns of docs with one of these names are replaced; others
    stay, whatever their names.
    """
    text, words = free_name(docs, "_text"), free_name(docs, "_words")
    out = docs.withColumn(text, F.coalesce(F.col("text"), F.lit(""))).withColumn(words, F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    out = out.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": duplicate_lines(F.col(text)),
        "n_repeat_words": repeated_words(F.col(words)),
    })
    return out.drop(text, words)


def base_failed() -> Column:
    """The contract's base rule on measured documents."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def default_rules() -> list[Rule]:
    """Rules beyond the base one; each leaves ordinary prose, lists and quoted code alone."""
    text = F.coalesce(F.col("text"), F.lit(""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return [
        Rule("few_words", F.col("n_words") < 10),
        Rule("repeats", 100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        Rule("symbols", 10 * F.col("n_symbols") > F.col("n_words") * 3),
        Rule("word_length", (F.col("word_chars") > 15 * F.col("n_words")) | (2 * F.col("word_chars") < 5 * F.col("n_words"))),
        Rule("dup_lines", (F.col("n_dup_lines") > 2) & (10 * F.col("n_dup_lines") > 3 * F.size(F.split(text, "\n")))),
        Rule("shouting", 2 * F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")) > letters),
        Rule("few_letters", 2 * letters < F.col("word_chars")),
    ]


def hashed_sample(docs: DataFrame, rows: int) -> DataFrame:
    """Texts of about `rows` documents, chosen by hash of their ids and texts, as a table in the shared folder."""
    n = docs.count()
    key = F.xxhash64("doc_id", "text") if "doc_id" in docs.columns else F.xxhash64("text")
    chosen = docs if n <= rows else docs.filter(F.pmod(key, F.lit(1 << 30)) < int(rows / n * (1 << 30)))
    return written(chosen.select(F.col("text").cast("string").alias("text")), "rule-sample")


def order_rules(sample: DataFrame, rules: list[Rule]) -> list[Rule]:
    """Rules by rejection per cost, both estimated on a bounded sample(text); ties keep the given order.

    Cost is the time of an aggregate over the sample with the rule, which computes the measures it needs and no
    others, less that of one without. The order only decides how much work is done, so a noisy estimate can't change a
    verdict.
    """
    measured = base_measures(sample)
    n = max(1, sample.count())

    def timed(*columns: Column) -> tuple[float, int]:
        began = time.perf_counter()
        row = measured.agg(F.count(F.col("text")), *columns).first()
        return time.perf_counter() - began, row[-1]

    timed()
    floor = min(timed()[0] for _ in range(RUNS))
    worth = []
    for k, r in enumerate(rules):
        runs = [timed(F.count_if(F.coalesce(r.rejects, F.lit(False)))) for _ in range(RUNS)]
        worth.append((-(runs[0][1] / n) / max(1e-4, min(t for t, _ in runs) - floor), k))
    return [rules[k] for _, k in sorted(worth)]


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule in this order that rejects, else null; CASE stops at that rule."""
    if not rules:
        return F.lit(None).cast("string")
    out = F.when(F.coalesce(rules[0].rejects, F.lit(False)), rules[0].name)
    for r in rules[1:]:
        out = out.when(F.coalesce(r.rejects, F.lit(False)), r.name)
    return out


def quality_rules(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs(doc_id, text) with the base measures, base_failed and kept.

    Null, empty and blank texts have no words, so that they fail. Repeated rows and rows that share a doc_id are
    judged one by one. Other columns of docs stay, but for names that the result uses. An empty table stays so.
    """
    rules = default_rules() if rules is None else rules
    ordered = order_rules(hashed_sample(docs, sample_rows), rules)
    measured = base_measures(docs)
    return measured.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.isnull(cascade(ordered)))


def quality_documents(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs(text) that no rule rejects, with their columns as they are; see quality_rules() for the cases.

    The rules stand in the filter itself, so that a document's later measures aren't computed once a rule rejects it.
    """
    rules = default_rules() if rules is None else rules
    ordered = order_rules(hashed_sample(docs, sample_rows), rules)
    row = free_name(docs, "_row")
    nested = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row), F.col("text"))
    return base_measures(nested).filter(F.isnull(cascade(ordered))).select(f"{row}.*")


#: DuckDB: the measures and all default rules.
ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i + 1 : i + 5], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(greatest(len(ws) - 4, 0))) AS i FROM w)),
h AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
n AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, len(string_split(t, chr(10))) AS n_lines, coalesce(n.n, 0) AS n_repeat_words,
      length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS letters, length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS upper FROM w LEFT JOIN n ON w.doc_id = n.doc_id),
b AS (SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (10 * n_symbols > 3 * n_words) AND NOT (word_chars > 15 * n_words OR 2 * word_chars < 5 * n_words)
AND NOT (n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines) AND NOT (2 * upper > letters) AND NOT (2 * letters < word_chars) AS kept FROM b
"""
