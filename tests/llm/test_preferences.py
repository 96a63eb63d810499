"""Preference formatting against a plain version and against its SQL."""

import random
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from winnowline.llm import chat_format
from winnowline.llm.queries import op2_format_preferences

SCHEMA = "pair_id long, turn long, role string, text string"


def render(role, text):
    return f"<|{role or ''}|>\n{text or ''}\n<|end|>\n"


def plain(chosen, rejected):
    out = {}
    key = lambda t: tuple((x is not None, x or 0 if not isinstance(x, str) else x) for x in t)
    sides = [defaultdict(list), defaultdict(list)]
    for side, rows in zip(sides, (chosen, rejected)):
        for p, turn, role, text in rows:
            if p is not None:
                side[p].append((turn, role, text))
    for p in sides[0].keys() | sides[1].keys():
        a, b = ([x[1:] for x in sorted(s[p], key=key)] for s in sides)
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        row = [p, n, "".join(render(*x) for x in a[:n])]
        for s in (a[n:], b[n:]):
            row += ["".join(render(*x) for x in s), "".join("1" if x[0] == "assistant" else "0" for x in s), sum(len(render(*x)) for x in s if x[0] == "assistant")]
        out[p] = tuple(row)
    return out


def test_random_pairs(spark):
    r = random.Random(5)
    turn = lambda: (r.choice(["user", "assistant", "system", None]), r.choice(["a", "b", "", None, "long " * 5000, "é\n😀"]))
    chosen, rejected = [], []
    for p in [*range(120), None]:
        common = [turn() for _ in range(r.randrange(4))]
        for rows in (chosen, rejected):
            rows += [(p, k if r.random() < 0.95 else 0, *t) for k, t in enumerate([*common, *(turn() for _ in range(r.randrange(4)))])]
    a, b = (spark.createDataFrame(x, SCHEMA) for x in (chosen, rejected))
    extra = a.withColumn("prefix", F.lit(1)).withColumn("side", F.lit("x")).withColumn("t", F.lit(None).cast("int"))
    got = chat_format.format_preferences(extra.repartition(3), b).collect()
    assert {x[0]: tuple(x) for x in got} == plain(chosen, rejected) and len(got) == len({x[0] for x in got})
    assert chat_format.format_preferences(a.limit(0), b.limit(0)).count() == 0


def test_contrasted_conversations_follow_their_sql(spark, tmp_path):
    r, rows = random.Random(6), []
    for c in range(200):
        opener = r.choice([f"own {c}", "a common opener", "hello"])
        roles = ["system"] * r.randrange(2) + ["user", "assistant"] * r.randrange(4) + ["user"] * r.randrange(2)
        rows += [(c, k, x, opener if k == 0 else f"{x} {r.randrange(1000)}") for k, x in enumerate(roles)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    d.coalesce(1).write.parquet(f"file://{tmp_path}/conversations.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    for where in (tmp_path, "/root/testdata/sf0.001"):
        if where != tmp_path:
            duck.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{where}/conversations.parquet'")
        got = op2_format_preferences(spark, f"file://{where}")
        cursor = duck.execute(chat_format.SQL)
        assert [x[0] for x in cursor.description] == got.columns
        found = got.collect()
        assert Counter(map(tuple, found)) == Counter(cursor.fetchall())
        if where == tmp_path:
            # Pairs part at the first turn, in the middle and at the last.
            completions = {len(x["chosen_mask"]) for x in found}
            assert len(completions) >= 4 and any(x["n_prompt_turns"] == 1 for x in found)
            answered = {c for c, _, role, _ in rows if role == "assistant"}
            assert {x["pair_id"] for x in found} == answered
