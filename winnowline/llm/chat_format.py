"""Preference formatting: a shared prompt once, then paired masked completions. DataFrame functions only.

Input are two turn tables, of chosen and of rejected conversations, that name their pair. The longest
common prefix of turns (equal role and text, position by position) becomes the prompt and is rendered
once; what follows on either side is that side's completion. A mask tells trainable segments (the
assistant turns of a completion) from the rest. Both sides meet in one grouping by pair: a group holds
the turns of two conversations, no more than the row that it returns.

Edge cases: a null role or text equals null only and renders as empty; turns that repeat a position
are ordered by role and text; a pair of equal conversations has all turns in the prompt and two empty
completions; a pair with turns on one side only has an empty prompt and one empty completion; turns of
a null pair are ignored; an empty table gives an empty result. Further input columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def render_turn(role: Column, text: Column) -> Column:
    """One turn in the chat template."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n<|end|>\n"))


def format_preferences(chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id", turn: str = "turn", role: str = "role", text: str = "text", trained_role: str = "assistant") -> DataFrame:
    """One row for each pair: pair, n_prompt_turns, prompt, and of each side the completion, its mask and its trained characters.

    A mask has one character for each completion turn, 1 where the loss counts.
    """

    def turns(side: DataFrame, n: int) -> DataFrame:
        message = F.struct(F.col(role).alias("role"), F.col(text).alias("text")).alias("message")
        return side.where(F.col(pair).isNotNull()).select(F.col(pair).alias("pair"), F.struct(F.lit(n).alias("side"), F.col(turn).alias("turn"), message).alias("t"))

    grouped = turns(chosen, 0).unionByName(turns(rejected, 1)).groupBy("pair").agg(F.sort_array(F.collect_list("t")).alias("t"))

    def messages(n: int) -> Column:
        return F.transform(F.filter("t", lambda x: x["side"] == n), lambda x: x["message"])

    both = grouped.select("pair", messages(0).alias("a"), messages(1).alias("b"))
    # A side that has ended gives null, which no turn equals.
    first_unlike = F.array_position(F.transform(F.arrays_zip("a", "b"), lambda x: x["a"].eqNullSafe(x["b"])), F.lit(False))
    both = both.withColumn("prefix", F.when(first_unlike > 0, first_unlike - 1).otherwise(F.size("a")).cast("long"))

    def text_of(part: Column) -> Column:
        return F.array_join(F.transform(part, lambda m: render_turn(m["role"], m["text"])), "")

    def completion(side: str, name: str) -> list[Column]:
        part = F.slice(F.col(side), F.col("prefix").cast("int") + 1, F.size(side))
        trains = lambda m: F.coalesce(m["role"] == trained_role, F.lit(False))
        mask = F.transform(part, lambda m: F.when(trains(m), "1").otherwise("0"))
        trained = F.aggregate(part, F.lit(0).cast("long"), lambda n, m: n + F.when(trains(m), F.length(render_turn(m["role"], m["text"]))).otherwise(0))
        return [text_of(part).alias(name), F.array_join(mask, "").alias(f"{name}_mask"), trained.alias(f"{name}_trained_chars")]

    prompt = text_of(F.slice(F.col("a"), F.lit(1), F.col("prefix").cast("int")))
    return both.select(F.col("pair").alias(pair), F.col("prefix").alias("n_prompt_turns"), prompt.alias("prompt"), *completion("a", "chosen"), *completion("b", "rejected"))


def contrasted_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected conversations from plain ones (conv_id, turn, role, text).

    Chosen is each conversation up to its last assistant turn. Where others open with the same turn,
    rejected is one of those: the smallest conversation id, for that conversation itself the largest.
    Else rejected is the same conversation with one of its answers (which, goes by the id) replaced by
    the neighbour's last answer (conversations 2k and 2k + 1), or emptied if the neighbour has none. So
    pairs part at the first turn, at any answer and at the last one. A conversation without an
    assistant turn makes no pair.
    """
    t = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", "role", "text")
    answers = F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text"))))
    c = t.groupBy("conv_id").agg(F.min(F.struct("turn", "role", "text")).alias("opener"), answers.alias("answers")).where(F.size("answers") > 0)
    c = c.select("conv_id", F.struct("opener.role", "opener.text").alias("opener"), F.element_at("answers", -1).alias("last"), F.element_at("answers", (F.pmod(F.shiftright("conv_id", 1), F.size("answers")) + 1).cast("int"))["turn"].alias("swap_at"))
    same = c.groupBy("opener").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high")).where("low < high")
    # A very common opener meets its conversations in 32 places.
    same = same.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
    c = c.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(32)).cast("int")).join(same, ["opener", "salt"], "left").withColumn("partner", F.when(F.col("conv_id") == F.col("low"), F.col("high")).otherwise(F.col("low")))
    other = c.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("last.text").alias("other"))
    c = c.join(other, "conv_id", "left").select("conv_id", F.col("last.turn").alias("at"), "swap_at", "other", "partner")
    kept = t.join(c, "conv_id").where(F.col("turn") <= F.col("at"))
    columns = ["pair_id", "turn", "role", "text"]
    chosen = kept.withColumnRenamed("conv_id", "pair_id")
    swapped = chosen.where("partner IS NULL").withColumn("text", F.when((F.col("turn") == F.col("swap_at")) & (F.col("role") == "assistant"), F.coalesce("other", F.lit(""))).otherwise(F.col("text")))
    asked = c.where("partner IS NOT NULL").select(F.col("conv_id").alias("pair_id"), "partner")
    others = kept.select(F.col("conv_id").alias("partner"), "turn", "role", "text").join(asked, "partner")
    return chosen.select(*columns), swapped.select(*columns).unionByName(others.select(*columns))


#: The rows of contrasted_conversations, formatted.
SQL = r"""WITH t AS (SELECT conv_id AS c, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
a AS (SELECT c, list(struct_pack(turn := turn, text := text) ORDER BY turn, text) AS answers FROM t WHERE role = 'assistant' GROUP BY c),
o AS (SELECT c, answers, min(struct_pack(turn := turn, role := role, text := text)) AS f FROM t JOIN a USING (c) GROUP BY ALL),
g AS (SELECT c, answers[-1].turn AS ending, answers[-1].text AS last, answers[((c >> 1) % len(answers)) + 1].turn AS swap_at, min(c) OVER w AS low, max(c) OVER w AS high FROM o WINDOW w AS (PARTITION BY f.role, f.text)),
p AS (SELECT g.c, g.ending, g.swap_at, h.last AS other, CASE WHEN g.low = g.high THEN NULL WHEN g.c = g.low THEN g.high ELSE g.low END AS partner FROM g LEFT JOIN g h ON h.c = xor(g.c, 1)),
k AS (SELECT c, turn, role, text, partner, swap_at, other FROM t JOIN p USING (c) WHERE turn <= ending),
r AS (SELECT c, turn, role, CASE WHEN turn = swap_at AND role = 'assistant' THEN coalesce(other, '') ELSE text END AS text FROM k WHERE partner IS NULL
UNION ALL SELECT p.c, k.turn, k.role, k.text FROM p JOIN k ON k.c = p.partner),
x AS (SELECT c, list(struct_pack(role := role, text := text) ORDER BY turn, role, text) AS a FROM k GROUP BY c), y AS (SELECT c, list(struct_pack(role := role, text := text) ORDER BY turn, role, text) AS b FROM r GROUP BY c),
z AS (SELECT c, a, b, coalesce(list_min(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] IS DISTINCT FROM b[i])) - 1, len(a)) AS n FROM x JOIN y USING (c)),
q AS (SELECT c, n, a[1:n] AS s, a[n + 1:] AS a, b[n + 1:] AS b FROM z)
SELECT c AS pair_id, n AS n_prompt_turns, PROMPT AS prompt, SIDES FROM q"""


def _rendered(column: str) -> str:
    return f"coalesce(array_to_string(list_transform({column}, lambda m: {TURN_SQL}), ''), '')"


TURN_SQL = r"concat('<|', m.role, '|>', chr(10), m.text, chr(10), '<|end|>', chr(10))"
SIDE_SQL = ", ".join(
    f"{_rendered(c)} AS {name}, coalesce(array_to_string(list_transform({c}, lambda m: CASE WHEN m.role = 'assistant' THEN '1' ELSE '0' END), ''), '') AS {name}_mask, coalesce(list_sum(list_transform({c}, lambda m: CASE WHEN m.role = 'assistant' THEN length({TURN_SQL}) ELSE 0 END)), 0)::BIGINT AS {name}_trained_chars"
    for c, name in (("a", "chosen"), ("b", "rejected"))
)
SQL = SQL.replace("PROMPT", _rendered("s")).replace("SIDES", SIDE_SQL)
