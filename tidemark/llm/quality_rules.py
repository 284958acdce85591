"""Quality rules: a threshold table compiled into one projection of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import boxed, unboxed

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Frequent function words of the four languages, in lower case.
STOP_WORDS = (
    "the of and to in is that for it on was with be as by this are at from a an or not "
    "de la le les des et en un une du que qui dans est par pour sur pas au ou il elle on ce "
    "der die das und ist nicht von mit den dem ein eine zu im auf für als sich des es auch "
    "el los las del y se por con para una no su lo al como más o"
).split()

#: (rule, measure, least, most): a document passes when every measure lies within its limits.
RULES = (
    ("enough_words", "n_words", 50.0, None),
    ("repeated_windows", "repeat_ratio", None, 0.5),
    ("word_length", "mean_word_chars", 2.5, 14.0),
    ("symbols", "symbol_ratio", None, 0.25),
    ("exclamations", "exclaim_ratio", None, 0.25),
    ("stop_words", "stop_ratio", 0.02, None),
    ("duplicate_lines", "dup_line_ratio", None, 0.5),
)


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates `value` once per row and names it in `body`."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeat_words(words: str) -> str:
    """SQL: words that lie in 3-word windows found at least twice in the text.

    Windows are compared by 64-bit hash; texts without a repeated hash stop
    after one sort of longs, the others sort (hash, position).
    """
    hashes = "transform(slice(w, 1, size(w) - 2), (x, i) -> xxhash64(x, w[i + 1], w[i + 2]))"
    twice = "exists(sequence(1, size(s) - 1), i -> s[i] = s[i - 1])"
    covered = (
        "aggregate(sort_array(transform(filter(p, (x, i) -> (i > 0 and p[i - 1].h = x.h) or (i < size(p) - 1 and p[i + 1].h = x.h)), x -> x.i)),"
        " named_struct('n', 0L, 'at', -3), (a, x) -> named_struct('n', a.n + least(3, x - a.at), 'at', x), a -> a.n)"
    )
    slow = _let("sort_array(transform(h, (x, i) -> named_struct('h', x, 'i', i)))", "p", covered)
    body = _let("sort_array(h)", "s", f"case when {twice} then {slow} else 0L end")
    return f"case when size({words}) < 4 then 0L else " + _let(words, "w", _let(hashes, "h", body)) + " end"


def measures(text: Column) -> dict[str, Column]:
    """Base counts of a text as Spark expressions; null counts as empty."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    inner = F.trim(t, F.lit(BLANKS))
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != "")
    return {
        "_words": words,
        "_lines": lines,
        "word_chars": F.length(F.translate(t, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_exclaims": (F.length(t) - F.length(F.translate(t, "!", ""))).cast("long"),
    }


def scored(docs: DataFrame, text_col: str = "text", rules=RULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, the base counts, each rule's verdict, `base_failed` and `kept`.

    Null and empty texts have zero words and fail `enough_words`.  Repeated rows
    are judged one by one.  A measure whose divisor is zero counts as 0.
    Columns of `docs` outside `keep` are ignored, whatever their names.  A kept
    column that has the name of one of the operator's own comes out as `input_` and
    its name.
    """
    m = measures(F.col(text_col))
    base = docs.select(*[F.col(c).alias(f"k_{c}") for c in keep], *[c.alias(n) for n, c in m.items()])
    stops = sorted({w for s in STOP_WORDS for w in (s, s.capitalize())})
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    base = base.select(
        *[f"k_{c}" for c in keep], "word_chars", "n_symbols", "n_exclaims",
        F.size("_words").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(_repeat_words("_words")).cast("long").alias("n_repeat_words"),
        F.size(F.filter("_words", lambda w: w.isin(stops))).cast("long").alias("n_stop_words"),
    )
    base = base.withColumns(
        {"mean_word_chars": ratio("word_chars", "n_words"), "symbol_ratio": ratio("n_symbols", "n_words"), "exclaim_ratio": ratio("n_exclaims", "n_words"), "stop_ratio": ratio("n_stop_words", "n_words"), "dup_line_ratio": ratio("n_dup_lines", "n_lines"), "repeat_ratio": ratio("n_repeat_words", "n_words")}
    )
    base = base.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    passed = {}
    for name, measure, least, most in rules:
        ok = F.lit(True)
        if least is not None:
            ok = ok & (F.col(measure) >= least)
        if most is not None:
            ok = ok & (F.col(measure) <= most)
        passed[f"passed_{name}"] = ok
    base = base.withColumns(passed)
    verdict = ~F.col("base_failed")
    for column in passed:
        verdict = verdict & F.col(column)
    base = base.withColumn("kept", verdict)
    return base.withColumnsRenamed({f"k_{c}": f"input_{c}" if c in base.columns else c for c in keep})


def kept_rows(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows of `docs` that pass every rule, with its own columns; a filter in one projection, nothing is shuffled.

    Null, empty and wordless texts go, as they fail `enough_words`; repeated rows
    stay or go together; column names may be any.
    """
    rows = boxed(docs).select("box", F.col("box").getField(text_col).alias("text"))
    return unboxed(scored(rows, rules=rules, keep=("box",)).where("kept"), docs.columns)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Contract query over the whole documents table."""
    out = scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOP_SQL = ", ".join(f"'{w}'" for w in sorted({w for s in STOP_WORDS for w in (s, s.capitalize())}))

ORACLE_OP1 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (length(t) - length(replace(t, '!', '')))::BIGINT AS n_ex,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: x IN ({_STOP_SQL})))::BIGINT AS n_stop
      FROM d LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2.5 AND 14 AND n_symbols / n_words <= 0.25 AND n_ex / n_words <= 0.25
       AND n_stop / n_words >= 0.02 AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AS kept
FROM f
"""
