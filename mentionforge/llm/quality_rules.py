"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionforge.llm.common import SPACE, table, words_of
from mentionforge.session import spread

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a", "about", "als", "am", "an", "and", "are", "as", "at", "au", "auf", "aus", "avec", "be", "been", "bei", "but", "by",
    "ce", "como", "con", "dans", "das", "de", "del", "dem", "den", "der", "des", "die", "du", "ein", "eine", "el", "en", "es",
    "est", "et", "for", "from", "had", "has", "have", "he", "her", "his", "ich", "il", "im", "in", "is", "ist", "it", "la", "las",
    "le", "les", "lo", "los", "mit", "nicht", "no", "not", "of", "on", "or", "ou", "para", "pas", "por", "pour", "que", "qui",
    "se", "she", "sich", "sie", "so", "son", "su", "sur", "that", "the", "they", "this", "to", "un", "una", "und", "une", "von",
    "was", "we", "were", "with", "y", "you", "zu",
)


@dataclass(frozen=True)
class Threshold:
    """Rejects a text whose measure lies under `least` or over `most`."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: Measures are SQL over the counts that `counts` makes; a text without words never gets here with a zero divisor.
THRESHOLDS = (
    Threshold("length", "n_words", least=20),
    Threshold("word_length", "word_chars / n_words", least=2.0, most=14.0),
    Threshold("symbols", "n_symbols / n_words", most=0.2),
    Threshold("letters", "n_letter_words / n_words", least=0.7),
    Threshold("stop_words", "n_stop_words / n_words", least=0.01),
    Threshold("duplicate_lines", "n_dup_lines / n_lines", most=0.5),
    Threshold("long_line", "n_words / n_lines", most=20000),
)


def _repeat_words(words: Column, width: int = 8) -> Column:
    """Words inside windows of `width` words that occur twice or more in the text.

    Texts whose window hashes all differ end there. The others sort (hash, start); windows that share their hash with a neighbour
    are written out and sorted as (window text, start), so that only equal texts count; and the union of those windows is
    added up: n log n, exact, and no more text than the repeated windows hold."""
    n = F.size(words)
    starts = F.sequence(F.lit(1), n - width + 1)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.element_at(words, (i + k).cast("int")) for k in range(width)]))
    let = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)  # noqa: E731  binds a value once

    def repeated(o: Column) -> Column:
        """Starts i, in order of o, of a sorted array of (w, i) whose w is a neighbour's too."""
        size = F.size(o)
        same = lambda k, d: F.element_at(o, k + d)["w"] == F.element_at(o, k)["w"]
        kept = F.filter(F.sequence(F.lit(1), size), lambda k: F.when(k > 1, same(k, -1)).otherwise(F.lit(False)) | F.when(k < size, same(k, 1)).otherwise(F.lit(False)))
        return F.transform(F.when(size > 0, kept).otherwise(F.array().cast("array<int>")), lambda k: F.element_at(o, k)["i"])

    def union(s: Column) -> Column:
        m = F.size(s)
        total = F.aggregate(
            F.sequence(F.lit(1), m),
            F.lit(0).cast("long"),
            lambda acc, k: acc + F.when(k < m, F.least(F.lit(width), F.element_at(s, k + 1) - F.element_at(s, k))).otherwise(F.lit(width)),
        )
        return F.when(m > 0, total).otherwise(F.lit(0).cast("long"))

    written = lambda s: F.array_sort(F.transform(s, lambda i: F.struct(F.array_join(F.slice(words, i, width), " ").alias("w"), i.alias("i"))))
    by_hash = lambda h: F.array_sort(F.transform(h, lambda x, k: F.struct(x.alias("w"), (k + 1).alias("i"))))
    slow = lambda h: let(by_hash(h), lambda o: let(repeated(o), lambda c: let(written(c), lambda p: let(F.array_sort(repeated(p)), union))))
    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(slow(h)))
    return F.when(n < width + 1, F.lit(0).cast("long")).otherwise(some)


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts that the thresholds use: one projection, no shuffle, no user function."""
    t = F.coalesce(F.col(text), F.lit(""))
    plain = "|".join(STOP_WORDS)
    w, lines = (next(x for x in (name + "_" * k for k in range(len(docs.columns) + 1)) if x not in docs.columns) for name in ("_w", "_l"))
    step = docs.withColumn(w, words_of(F.col(text))).withColumn(lines, F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    joined = F.array_join(w, " ")
    step = step.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_letter_words": F.regexp_count(joined, F.lit(r"(?<![^ ])[^ ]*?\p{L}[^ ]*+")).cast("long"),
        "n_stop_words": F.regexp_count(joined, F.lit(rf"(?i)(?<![^ ])(?:{plain})[.,;:!?]*+(?![^ ])")).cast("long"),
        "n_repeat_words": _repeat_words(F.col(w)),
    })
    return step.drop(w, lines)


def quality_rules(docs: DataFrame, thresholds: tuple[Threshold, ...] = THRESHOLDS, text: str = "text", most_repeat_percent: int = 30, least_words: int = 20) -> DataFrame:
    """docs with the counts, base_failed, kept, and the names of the thresholds that failed.

    Null text counts as a text without words: it fails. Empty tables give empty tables; repeated rows are judged one
    by one; columns of docs that share a name with a count are replaced."""
    failed = [F.when(F.expr(f"n_words > 0 and ({' or '.join(part)})"), F.lit(r.name)) for r in thresholds if (part := [f"{r.measure} {op} {v}D" for op, v in (("<", r.least), (">", r.most)) if v is not None])]
    out = counts(docs, text).withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words")))
    out = out.withColumn("failed_rules", F.array_compact(F.array(*failed)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOPS = "|".join(STOP_WORDS)
OP2_SQL = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) ls
  FROM documents
), g AS (
  SELECT *, CASE WHEN len(ws) < 9 THEN []::VARCHAR[] ELSE list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' ')) END gs FROM w
), u AS (SELECT doc_id, unnest(gs) g, unnest(range(1, len(gs) + 1)) i FROM g),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) c FROM u),
s AS (SELECT doc_id, sum(least(8, coalesce(nx - i, 8))) n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) nx FROM r WHERE c > 1) GROUP BY doc_id),
k AS (
  SELECT g.doc_id, len(ws)::BIGINT n_words, length(array_to_string(ws, ''))::BIGINT word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT n_symbols, len(ls)::BIGINT n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT n_dup_lines, coalesce(n, 0)::BIGINT n_repeat_words,
    len(list_filter(ws, lambda x: regexp_matches(x, '\\pL')))::BIGINT n_letter_words,
    len(list_filter(ws, lambda x: regexp_full_match(x, '(?i:{_STOPS})[.,;:!?]*')))::BIGINT n_stop_words
  FROM g LEFT JOIN s USING (doc_id)
), b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words base_failed FROM k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_words > 0 AND (word_chars / n_words < 2 OR word_chars / n_words > 14 OR n_symbols / n_words > 0.2
    OR n_letter_words / n_words < 0.7 OR n_stop_words / n_words < 0.01 OR n_dup_lines / n_lines > 0.5 OR n_words / n_lines > 20000)) kept
FROM b
"""
