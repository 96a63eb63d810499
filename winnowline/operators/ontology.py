"""Term tables: coercion of noisy names, deduplication, weights, broader terms, graphs, differences of versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


WORD = r"[\p{L}\p{N}+#]+"


def normal_term(c: Column) -> Column:
    """Lower-cased words of letters, digits, + and #, single blanks between them."""
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), 0), " ")


def coerce(c: Column, aliases: dict[str, str], default: str) -> Column:
    """A noisy enumeration value by alias; what is neither a value nor an alias becomes the default."""
    key = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[\s_-]+", "_")
    table = {v: v for v in aliases.values()} | aliases
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default))


def dedupe_terms(terms: DataFrame) -> DataFrame:
    """One row for each (kind, canonical): accepted before proposed, with evidence before without, then by weight and polarity.

    A term counts as accepted only with evidence; if two polarities of a term are accepted, the better row keeps it.
    """
    t = terms.withColumn("canonical", normal_term(F.col("canonical"))).where("canonical <> ''")
    t = t.withColumn("accepted", F.col("accepted") & (F.size("evidence") > 0))
    values = [c for c in t.columns if c not in ("kind", "canonical")]
    best = t.groupBy("kind", "canonical").agg(F.max(F.struct("accepted", (F.size("evidence") > 0).alias("shown"), "weight", "polarity", F.struct(*values).alias("v"))).alias("b"))
    return best.select("kind", "canonical", "b.v.*")


def dedupe_relations(relations: DataFrame) -> DataFrame:
    """One row for each (subject, predicate, object): the greatest confidence; loose ends go."""
    r = relations.withColumns({"subject": normal_term(F.col("subject")), "object": normal_term(F.col("object"))})
    return r.where("subject <> '' AND object <> ''").groupBy("subject", "predicate", "object").agg(F.max("confidence").alias("confidence"))


def term_statistics(terms: DataFrame) -> DataFrame:
    """score, counts and weights by polarity, keyness and the weight from 1 to 5 that accepted keywords have."""
    score = F.round(F.col("weight") * F.col("confidence"), 4)
    side = lambda *p: F.col("polarity").isin(*p)
    cols = [F.when(side(*p), F.col("support")).otherwise(0).alias(f"{n}_count") for n, p in SIDES.items()] + [F.when(side(*p), score).otherwise(0.0).alias(f"{n}_weight") for n, p in SIDES.items()]
    keyword = F.when(F.col("accepted"), F.greatest(F.lit(1), F.least(F.lit(5), F.bround(F.col("weight") * 5).cast("int"))))
    return terms.select("kind", "canonical", "polarity", *cols, (F.col("support") - F.col("contrast")).alias("keyness"), score.alias("score"), keyword.alias("keyword_weight"))


SIDES = {"positive": ("positive",), "negative": ("negative",), "contextual": ("neutral", "contextual")}


def broader_terms(candidates: DataFrame, accepted: DataFrame) -> DataFrame:
    """Candidates that say less than an accepted term: single words, or a proper part of its words.

    A candidate meets only accepted terms that hold its longest word, so common words don't join everything.
    """
    words = lambda c: F.array_distinct(F.split(normal_term(F.col(c)), " "))
    rarest = lambda w: F.array_max(F.transform(w, lambda x: F.struct(F.length(x).alias("n"), x.alias("w"))))["w"]
    c = candidates.select("term", words("term").alias("w"))
    a = accepted.select(words("term").alias("aw")).withColumn("word", F.explode("aw"))
    part = c.where(F.size("w") >= 2).withColumn("word", rarest(F.col("w"))).join(a, "word").where((F.size(F.array_except("w", "aw")) == 0) & (F.size("w") < F.size("aw"))).select("term").distinct()
    single = c.where(F.size("w") < 2).select("term").distinct()
    return single.unionByName(part)


def node_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def graph(terms: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): ids are hashes of what they stand for; edges to unknown terms get nodes of kind "term"."""
    known = terms.select("kind", "canonical").distinct()
    ends = relations.select(F.col("subject").alias("canonical")).union(relations.select("object")).distinct().join(known, "canonical", "left_anti").select(F.lit("term").alias("kind"), "canonical")
    nodes = known.unionByName(ends).select(node_id(F.col("kind"), F.col("canonical")).alias("node_id"), "kind", "canonical")
    one = nodes.groupBy("canonical").agg(F.min("node_id").alias("id"))
    e = relations.join(one.select(F.col("canonical").alias("subject"), F.col("id").alias("from_id")), "subject").join(one.select(F.col("canonical").alias("object"), F.col("id").alias("to_id")), "object")
    return nodes, e.select(node_id(F.col("from_id"), F.col("predicate"), F.col("to_id")).alias("edge_id"), "from_id", "predicate", "to_id", "confidence")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str = "path", value: str = "value") -> DataFrame:
    """Paths whose value was added, removed or changed between two versions of (path, value) rows."""
    b, a = before.select(key, F.col(value).alias("before")), after.select(key, F.col(value).alias("after"))
    return a.join(b, key, "full").where(~F.col("before").eqNullSafe(F.col("after"))).select(key, "before", "after")


def json_leaves(df: DataFrame, key: str, json: str, depth: int = 3) -> DataFrame:
    """(key, path, value) of a JSON object's leaves as /a/b pointers, objects up to ``depth`` deep; arrays stay whole."""
    level = df.select(key, F.lit("").alias("path"), F.col(json).alias("value"))
    out = None
    for k in range(depth):
        opened = level.select(key, "path", F.explode(F.from_json("value", "map<string,string>")).alias("k", "v"))
        opened = opened.select(key, F.concat_ws("/", "path", "k").alias("path"), F.col("v").alias("value"))
        is_object = F.coalesce(F.trim("value").startswith("{"), F.lit(False)) if k < depth - 1 else F.lit(False)
        leaves = opened.where(~is_object)
        out = leaves if out is None else out.unionByName(leaves)
        level = opened.where(is_object)
    return out


def affected_items(items: DataFrame, changes: DataFrame, previous: str) -> DataFrame:
    """Items made under the previous version, each with the changed terms it holds (maybe none: it is replayed all the same)."""
    t = changes.select(F.explode(F.array("before", "after")).alias("term")).where("term IS NOT NULL AND term <> '' AND NOT term LIKE '{%' AND NOT term LIKE '[%'").select(F.lower("term").alias("term")).distinct()
    old = items.where(F.col("version") == previous)
    hits = old.select("item", F.explode(F.array_distinct(F.transform("terms", F.lower))).alias("term")).join(t, "term").groupBy("item").agg(F.array_sort(F.collect_set("term")).alias("matched"))
    return old.select("item").join(hits, "item", "left").select("item", F.coalesce("matched", F.array().cast("array<string>")).alias("matched"))


#: Terms that a task may hold whole.
HELD = 200_000


def enrich(texts: DataFrame, key: str, text: str, dictionary: DataFrame, held: int = HELD) -> DataFrame:
    """Dictionary terms of one or two words that a text holds as whole words, with their kind and how often.

    A text's words stay where they are if the dictionary has ``held`` terms at most: each word, and each with
    the next one, is looked up there. Only with a larger dictionary are words shuffled to its terms, each text's
    distinct ones with their number.
    """
    words = F.split(normal_term(F.col("term")), " ")
    terms = dictionary.select(words.alias("w"), "kind").where("w[0] <> '' AND size(w) <= 2").groupBy("w").agg(F.collect_set("kind").alias("kinds"))
    small = terms.limit(held + 1).count() <= held
    w = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), 0)
    found = texts.select(key, w.alias("w")).select(key, F.inline(F.arrays_zip(F.col("w").alias("first"), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))).alias("second"))))
    if small:
        one, two = (F.broadcast(terms.where(F.size("w") == n).select(*[F.col("w")[i].alias(c) for i, c in enumerate(("first", "second")[:n])], F.col("kinds").alias(f"kinds{n}"))) for n in (1, 2))
        hits = found.join(one, "first", "left").join(two, ["first", "second"], "left").where("kinds1 IS NOT NULL OR kinds2 IS NOT NULL")
        sides = [F.struct(F.col("first").alias("term"), F.col("kinds1").alias("kinds")), F.struct(F.concat_ws(" ", "first", "second").alias("term"), F.col("kinds2").alias("kinds"))]
        hits = hits.select(key, F.explode(F.array(*sides)).alias("h")).where("h.kinds IS NOT NULL").select(key, "h.term", "h.kinds").groupBy(key, "term", "kinds").agg(F.count("*").alias("n"))
    else:
        grams = found.select(key, F.explode(F.array(F.col("first"), F.when(F.col("second").isNotNull(), F.concat_ws(" ", "first", "second")))).alias("term")).where("term IS NOT NULL")
        hits = grams.groupBy(key, "term").agg(F.count("*").alias("n")).join(terms.select(F.array_join("w", " ").alias("term"), "kinds"), "term")
    return hits.select(key, F.explode("kinds").alias("kind"), "term", "n")
