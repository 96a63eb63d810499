"""Normal forms against unicodedata; digests against a plain split."""

import re
import unicodedata

from pyspark.sql import functions as F

from winnowline.functions import segments as S
from winnowline.functions import unicode as U

TEXTS = ["plain ascii", None, "", "Café", "e​́", "﻿Ｆｕｌｌ　ｗｉｄｔｈ １２３", "ﬁne ½ ² ™ …", "a\x00b\x07é", "漢字 ｶﾀｶﾅ", "  many   blanks \n\n\t lines \n é  ", "x" * 19_990 + " é" * 30, "É" * 20_005]


def clean(text):
    t = re.sub("[\x00-\x08\x0b-\x1f\x7f]", "", re.sub("[﻿​]", "", text or ""))
    lines = [re.sub("[ \t]+", " ", x).strip(" ") for x in unicodedata.normalize("NFKC", t).split("\n")]
    t = "\n".join(x for x in lines if x)
    head = t[:20_000]
    return t if len(t) <= 20_000 else (head[: head.rindex(" ")] if " " in head else head)


def test_normal_form(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").withColumn("n", U.normal_form(F.col("t"))).withColumn("c", U.sanitize_unicode(F.col("t")))
    rows = sorted(d.withColumn("again", U.sanitize_unicode(F.col("c"))).collect())
    for r in rows:
        want = None if r["t"] is None else unicodedata.normalize("NFKC", re.sub("[\x00-\x08\x0b-\x1f\x7f]", "", re.sub("[﻿​]", "", r["t"])))
        assert r["n"] == want and r["c"] == clean(r["t"]) and r["again"] == r["c"]
    assert [r["c"] for r in rows[3:6]] == ["Café", "é", "Full width 123"]


DIGESTS = ["We are hiring:\n- Data engineer vacancy\n  with more\n2) vacancy two \n* third", "- vacancy one\nno bullet\n-not a bullet vacancy", "Vacancy A\n• x\n• y", "", None, "\n- vacancy\n\n\n- vacancy\n- \n", "one vacancy\r\n1. other vacancy"]


def test_segments(spark):
    d = spark.createDataFrame([(i, t, ["", " given ", "two"] if i == 2 else None) for i, t in enumerate(DIGESTS)], "id long, t string, own array<string>")
    hint = r"(?i)\bvacanc(y|ies)\b"
    got = {}
    rows = S.explode_segments(d, "id", "t", hint).collect()
    for r in sorted(rows, key=lambda r: (r["id"], r["ordinal"])):
        got.setdefault(r["id"], []).append(r["segment"])
    for i, t in enumerate(DIGESTS):
        if t is None:
            assert i not in got
            continue
        parts = [p.strip() for p in re.split(r"\n[ \t]*(?=(?:[0-9]+[.)]|[-*•])[ \t])", t) if p.strip()]
        want = parts if sum(bool(re.search(hint, p)) for p in parts) >= 2 else [t]
        assert got[i] == want, t
    assert len({r["segment_id"] for r in rows}) == len(rows)
    again = {r["segment_id"] for r in S.explode_segments(d.repartition(5), "id", "t", hint).collect()}
    assert again == {r["segment_id"] for r in rows}
    declared = [(r["segment"], r["evidence"]) for r in S.explode_segments(d.where("id = 2"), "id", "t", hint, "own").collect()]
    assert declared == [("given", "source_declared_segment"), ("two", "source_declared_segment")]
