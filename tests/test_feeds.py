"""Landed feeds and boards: what is set apart, what is seen, and going on after a failure."""

import pytest
from pyspark.sql import functions as F

from winnowline.sources import feeds


def rss(*items):
    return "<rss><channel>" + "".join(f"<item><guid>{g}</guid><link>{u}</link><title>t</title>{f'<pubDate>{p}</pubDate>' if p else ''}</item>" for g, u, p in items) + "</channel></rss>"


def land(tmp_path, source, name, text):
    folder = tmp_path / "in" / f"source={source}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)


def run(spark, tmp_path, items=None, cutoff="2024-01-10", most=10_000, after_write=None):
    files = feeds.landed(spark, f"file://{tmp_path}/in")
    rows = feeds.unseen(feeds.entries(files, items if items is not None else feeds.feed_items(F.col("value")), cutoff), most)
    good, apart = feeds.poll(rows, f"file://{tmp_path}/out", f"file://{tmp_path}/cursor", after_write)
    return sorted((r["source"], r["id"], r["link"]) for r in good.collect()), sorted((r["source"], r["id"], r["reason"]) for r in apart.select("source", F.coalesce("id", F.lit("-")).alias("id"), "reason").collect())


DAY = "Mon, 15 Jan 2024 10:00:00 +0000"


def test_quarantine_resume_and_seen_ids(spark, tmp_path):
    land(tmp_path, "a", "1.xml", rss(("1", "http://x/1", DAY), ("2", "http://x/2", None), ("3", "http://x/3", "1 Jan 2024 10:00:00 +0000"), ("", "http://x/4?a=1&amp;b", DAY), ("", "", DAY)))
    land(tmp_path, "b", "1.xml", "<<< no feed")
    calls = []

    def fail(number):
        calls.append(number)
        raise RuntimeError("the batch was written, but not in full")

    with pytest.raises(Exception):
        run(spark, tmp_path, after_write=fail)
    assert calls == [0]
    # The cursor did not move: the batch is read again, and what the first attempt left is overwritten.
    good, apart = run(spark, tmp_path)
    assert good == [("a", "1", "http://x/1"), ("a", "http://x/4?a=1&b", "http://x/4?a=1&b")]
    assert apart == [("a", "-", "no_identity"), ("a", "2", "undated"), ("a", "3", "old"), ("b", "-", "invalid_file")]
    # Another edition: what was seen is left out, also for one source only.
    land(tmp_path, "a", "2.xml", rss(("1", "http://x/1", DAY), ("5", "http://x/5", DAY), ("5", "http://x/5", DAY)))
    land(tmp_path, "b", "2.xml", rss(("1", "http://y/1", "2024-01-15T10:00:00Z")))
    good, _ = run(spark, tmp_path)
    assert good == [("a", "1", "http://x/1"), ("a", "5", "http://x/5"), ("a", "http://x/4?a=1&b", "http://x/4?a=1&b"), ("b", "1", "http://y/1")]
    assert run(spark, tmp_path)[0] == good


def test_only_so_many_ids_are_remembered(spark, tmp_path):
    for n, ids in enumerate((["1", "2", "3"], ["1", "3"])):
        land(tmp_path, "a", f"{n}.xml", rss(*[(i, f"http://x/{i}", DAY) for i in ids]))
        good, _ = run(spark, tmp_path, most=2)
    assert [i for _, i, _ in good] == ["1", "1", "2", "3"]  # 1 had been forgotten


def test_boards(spark, tmp_path):
    land(tmp_path, "a", "1.json", '{"jobs": [{"id": 7, "at": "2024-01-15T00:00:00Z", "url": "http://x/7"}, {"id": null}]}')
    land(tmp_path, "b", "1.json", "{broken")
    items = feeds.board_items(F.col("value"), "jobs[*]", {"guid": "id", "link": "url", "published": "at"})
    good, apart = run(spark, tmp_path, items)
    assert good == [("a", "7", "http://x/7")] and apart == [("a", "-", "no_identity"), ("b", "-", "invalid_file")]


def test_many_ids_are_remembered(spark, tmp_path):
    ids = [str(i) for i in range(10_500)]
    for n in range(2):
        land(tmp_path, "a", f"{n}.xml", rss(*[(i, f"http://x/{i}", DAY) for i in ids], ("u", "http://x/u", None)))
        files = feeds.landed(spark, f"file://{tmp_path}/in")
        good, apart = feeds.poll(feeds.unseen(feeds.entries(files, feeds.feed_items(F.col("value")), "2024-01-10")), f"file://{tmp_path}/out", f"file://{tmp_path}/cursor")
    assert sorted(r["id"] for r in good.collect()) == sorted(ids)
    assert [(r["id"], r["reason"]) for r in apart.collect()] == [("u", "undated")] * 2
