"""Quality rules from cross-document line frequency, in DataFrame functions only.

Lines are normalised (lower case, white space collapsed, digits made equal) and hashed. A line that
stands in more than ``max_docs`` documents of one host is boilerplate there and is removed; a
document that loses more than ``max_lost`` of its line words is depleted and rejected.

A copy group would make every line of its text frequent although the host repeats one document and
not one line. So a line must also stand in more than ``min_distinct`` distinct documents, where documents
count once that differ in nothing but long lines (12 words or more) which the host repeats, as they are
or with up to about a quarter changed. Copies and near copies with edits in long lines count as one;
a short line of its own makes a page distinct, however much boilerplate stands around it. Deciding
between copies stays the business of deduplication.

Edge cases: null text counts as empty; null hosts form one host of their own; a document without
words has all counts 0 and fails the base rule; rows that repeat a doc_id are judged together for
depletion and measured each by itself; a null doc_id is a key like any other; an empty table gives an
empty result. ``apply_rules`` changes no column but text and n_chars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnowline.llm.common import cut, let, set_aside, word_array

SYMBOLS = "[#*$%&|<>]"


def repeated_window_words(words: Column, width: int = 3) -> Column:
    """Words that lie in a ``width``-word window which occurs at least twice in the text."""

    def windows(w: Column) -> Column:
        n = F.greatest(F.size(w) - (width - 1), F.lit(0))
        zipped = F.arrays_zip(*[F.slice(w, k + 1, n) for k in range(width)])
        return F.sort_array(F.transform(zipped, lambda x, i: F.struct(F.xxhash64(x).alias("h"), i.alias("p"))))

    def covered(s: Column) -> Column:
        n = F.greatest(F.size(s) - 1, F.lit(0))
        pairs = F.arrays_zip(F.slice(s, 1, n).alias("a"), F.slice(s, 2, n).alias("b"))
        equal = F.filter(pairs, lambda x: x["a"]["h"] == x["b"]["h"])
        spots = F.transform(equal, lambda x: F.array(*[x[k]["p"] + d for k in ("a", "b") for d in range(width)]))
        return F.size(F.array_distinct(F.flatten(spots)))

    return F.when(F.size(words) < width, F.lit(0)).otherwise(let(windows(words), covered)).cast("long")


def base_measures(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``key``, those of ``keep``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.select(F.col(key), *keep, word_array(F.col(text)).alias("__words"), lines.alias("__lines"), F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    d = d.select(
        key,
        *keep,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("__words")).alias("n_repeat_words"),
    )
    return d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"\d", "0"), r"[\x20\x09-\x0D]+", " "))


def loose_keys(line: Column, host: Column, least: int = 12) -> Column:
    """Four hashes of a line of ``least`` words or more, each without another quarter; none for a shorter line.

    Quarters are counted from both ends, so a word put in or taken out leaves the other three as they were.
    """

    def keys(w: Column) -> Column:
        q = F.floor((F.size(w) + 1) / 4).cast("int")
        return F.array(*[F.xxhash64(host, F.lit(k), F.slice(w, 1, q * k), F.slice(w, F.size(w) - q * (3 - k) + 1, q * (3 - k))) for k in range(4)])

    return F.when(F.regexp_count(line, F.lit(" ")) >= least - 1, let(F.split(line, " "), keys)).otherwise(F.array().cast("array<bigint>"))


def row_hash(key: str, text: str, host: str) -> Column:
    return F.xxhash64(key, host, text)


def document_lines(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """One row for each distinct normalised line of a document: key, row, same, total, line, words, loose.

    ``row`` is a hash of key, host and text; ``line`` and ``loose`` are hashed with the host. ``same`` is equal for documents of one host with the
    same lines, ``total`` counts the words of all lines.
    """
    lines = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), normal_line), lambda x: x != ""))
    item = F.transform(lines, lambda x: F.struct(F.xxhash64(F.col(host), x).alias("line"), (F.regexp_count(x, F.lit(" ")) + 1).cast("long").alias("words"), loose_keys(x, F.col(host)).alias("loose")))
    d = docs.select(F.col(key).alias("key"), row_hash(key, text, host).alias("row"), item.alias("lines"))
    d = d.select("key", "row", F.xxhash64(F.sort_array("lines.line")).alias("same"), F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("total"), F.explode("lines").alias("l"))
    return d.select("key", "row", "same", "total", "l.line", "l.words", "l.loose")


def frequent_lines(lines: DataFrame, max_docs: int, min_distinct: int) -> DataFrame:
    """Lines above the limits; counts are summed before each shuffle, so a hot line is a few rows."""
    by_text = lines.groupBy("line", "same").agg(F.count("*").alias("c")).groupBy("line").agg(F.sum("c").alias("docs"), F.count("*").alias("texts"))
    often = cut(by_text.where((F.col("docs") > max_docs) & (F.col("texts") > min_distinct)).select("line", F.lit(True).alias("often")))
    item = F.struct("line", "loose")
    texts = lines.join(often, "line", "left").groupBy("same").agg(F.collect_set(F.when(F.col("often"), item)).alias("often"), F.collect_set(F.when(F.isnull("often"), item)).alias("own"))
    texts = cut(texts.where(F.size("often") > 0))
    # Loose keys of lines that stand in many texts, as they are or with a quarter of each changed.
    varied = texts.select(F.explode(F.array_distinct(F.flatten("own.loose"))).alias("loose")).groupBy("loose").agg(F.count("*").alias("n")).where(F.col("n") > min_distinct).select("loose")
    varied = cut(varied.union(texts.select(F.explode(F.flatten("often.loose")).alias("loose"))).distinct())
    variants = texts.select("same", F.explode("own").alias("o")).select("same", "o.line", F.explode("o.loose").alias("loose")).join(varied, "loose", "left_semi").groupBy("same").agg(F.collect_set("line").alias("variants"))
    short = F.transform(F.filter("often", lambda x: F.size(x["loose"]) == 0), lambda x: x["line"])
    rest = F.array_except("own.line", F.coalesce("variants", F.array().cast("array<bigint>")))
    labels = texts.join(variants, "same", "left").select(F.explode("often.line").alias("line"), F.xxhash64(F.sort_array(F.concat(short, rest))).alias("rest"))
    return labels.distinct().groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") > min_distinct).select("line")


def lines_to_remove(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = 20, min_distinct: int = 10) -> DataFrame:
    """The distinct lines of documents that are frequent on their host: key, row, line, words, total."""
    lines = cut(document_lines(docs, key, text, host))
    frequent = frequent_lines(lines, max_docs, min_distinct)
    return cut(lines.join(frequent, "line", "left_semi").select("key", "row", "line", "words", "total"))


def depleted(found: DataFrame, max_lost: float) -> DataFrame:
    lost = found.groupBy("key").agg(F.sum("words").alias("lost"), F.max("total").alias("total"))
    return cut(lost.where(F.col("lost") > max_lost * F.col("total")).select(F.col("key").alias("__depleted")))


def depleted_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", max_lost: float = 0.7, **limits) -> DataFrame:
    """Keys of documents that lose more than ``max_lost`` of their line words to frequent lines."""
    return depleted(lines_to_remove(docs, key, text, host, **limits), max_lost)


def remove_lines(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", length: str = "n_chars") -> DataFrame:
    """``docs`` without the lines that ``found`` (of lines_to_remove) has for them; the others keep their order and form.

    Only documents that lose a line are taken apart. Where there is a column ``length``, theirs is counted anew.
    """
    gone = found.groupBy("row").agg(F.collect_set("line").alias("__gone")).withColumnRenamed("row", "__row")
    d = docs.withColumn("__row", row_hash(key, text, host)).join(gone.hint("merge"), "__row", "left")  # grows with the documents: never broadcast
    left = F.filter(F.split(F.col(text), "\n"), lambda x: ~F.array_contains("__gone", F.xxhash64(F.col(host), normal_line(x))))
    d = d.withColumn(text, F.when(F.isnull("__gone"), F.col(text)).otherwise(F.array_join(left, "\n")))
    if length in docs.columns:
        d = d.withColumn(length, F.when(F.isnull("__gone"), F.col(length)).otherwise(F.length(text)).cast(docs.schema[length].dataType))
    return d.select(*docs.columns)


def quality_verdicts(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", **limits) -> DataFrame:
    """Every document's measures, base_failed and kept."""
    measures = base_measures(docs, key, text)
    gone = depleted_documents(docs, key, text, host, **limits)
    d = measures.join(gone, F.col(key).eqNullSafe(F.col("__depleted")), "left")
    return d.withColumn("kept", ~F.col("base_failed") & F.isnull("__depleted")).drop("__depleted")


def apply_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", max_lost: float = 0.7, **limits) -> DataFrame:
    """The documents that the rules keep, judged by the text as it came, without their host's frequent lines."""
    docs, named = set_aside(docs, key, text, host, "n_chars")
    found = lines_to_remove(docs, key, text, host, **limits)
    gone = depleted(found, max_lost)
    words = word_array(F.col(text))
    n, repeated = F.size(words), repeated_window_words(words)
    ok = docs.where((n >= 50) & (100 * repeated <= 50 * n))
    return named(remove_lines(ok.join(gone, ok[key].eqNullSafe(gone["__depleted"]), "left_anti"), found, key, text, host))


#: The rows of quality_verdicts over ``documents``, from the definitions: lines as text, not as hashes.
SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda y: y <> '') AS w, list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS l FROM d),
tri AS (SELECT r, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
spots AS (SELECT r, count(DISTINCT s) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS s FROM (SELECT r, i FROM tri QUALIFY count(*) OVER (PARTITION BY r, g) > 1)) GROUP BY r),
m AS (SELECT w.r, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN spots USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
x AS (SELECT r, doc_id, source, list_sort(list_distinct(list_filter(list_transform(string_split(t, chr(10)), lambda y: trim(regexp_replace(regexp_replace(lower(y), '\d', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'))), lambda y: y <> ''))) AS s FROM d),
tx AS (SELECT row_number() OVER () AS k, source, s, docs FROM (SELECT source, s, count(*) AS docs FROM x WHERE len(s) > 0 GROUP BY ALL)),
ln AS (SELECT k, source, docs, unnest(s) AS line FROM tx),
often AS (SELECT source, line FROM ln GROUP BY ALL HAVING sum(docs) > 20 AND count(*) > 10),
lo AS (SELECT ln.k, ln.source, ln.line, o.line IS NOT NULL AS often, string_split(ln.line, ' ') AS w FROM ln LEFT JOIN often o ON ln.source IS NOT DISTINCT FROM o.source AND ln.line = o.line),
lines AS (SELECT k, source, line, often, CASE WHEN len(w) >= 12 THEN list_transform([0, 1, 2, 3], lambda j: j || '|' || array_to_string(w[1:((len(w) + 1) // 4) * j], ' ') || '|' || array_to_string(w[len(w) - ((len(w) + 1) // 4) * (3 - j) + 1:], ' ')) ELSE [] END AS loose FROM lo WHERE k IN (SELECT k FROM lo WHERE often)),
varied AS (SELECT source, key FROM (SELECT DISTINCT k, source, unnest(loose) AS key FROM lines WHERE NOT often) GROUP BY ALL HAVING count(*) > 10 UNION SELECT source, unnest(loose) AS key FROM lines WHERE often),
variant AS (SELECT DISTINCT k, line FROM (SELECT k, source, line, unnest(loose) AS key FROM lines WHERE NOT often) n JOIN varied v ON n.key = v.key AND n.source IS NOT DISTINCT FROM v.source),
rest AS (SELECT k, coalesce(list_sort(list(line) FILTER (len(loose) = 0 OR (NOT often AND known IS NULL))), []) AS rest FROM (SELECT lines.*, variant.line AS known FROM lines LEFT JOIN variant ON lines.k = variant.k AND lines.line = variant.line) GROUP BY k),
frequent AS (SELECT source, line FROM lines JOIN rest USING (k) WHERE often GROUP BY ALL HAVING count(DISTINCT rest) > 10),
xl AS (SELECT r, doc_id, source, unnest(s) AS line, list_sum(list_transform(s, lambda y: len(string_split(y, ' ')))) AS total FROM x),
gone AS (SELECT doc_id, true AS gone FROM xl JOIN frequent f ON xl.source IS NOT DISTINCT FROM f.source AND xl.line = f.line GROUP BY doc_id HAVING sum(len(string_split(xl.line, ' '))) > 0.7 * max(total))
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND gone IS NULL AS kept FROM b LEFT JOIN gone ON b.doc_id IS NOT DISTINCT FROM gone.doc_id"""
