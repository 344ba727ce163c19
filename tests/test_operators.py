"""Folds against plain loops, readers' round trips, streaming twins, and the registry against DuckDB."""

import json
import random

import pytest
from pyspark.sql import functions as F

from airwave.functions import text
from airwave.operators import filters, windows
from airwave.sources import files
from airwave.streaming import jobs


@pytest.mark.parametrize("piece,size,floor,gap", [(1 << 18, 7, 3, 300), (20, 7, 3, 300), (3, 7, 3, 300), (1, 1, 1, 300), (9, 50, 4, 100_000), (4, 3, 3, 61)])
def test_greedy_windows_equals_loop(spark, monkeypatch, piece, size, floor, gap):
    """One task a stream, and streams cut into pieces that are smaller or larger than a window."""
    monkeypatch.setattr(windows, "PIECE", piece)
    rnd = random.Random(1)
    rows = []
    for stream in range(6):
        us = 0
        for i in range(rnd.randint(0, 120)):
            us += rnd.choice([0, 1, 30, 61, 400]) * 1_000_000
            rows.append((stream, str(i), us))
    want = {}
    for stream in range(6):
        mine = sorted((us, int(i)) for s, i, us in rows if s == stream)
        groups, start = [], None
        for us, i in mine:
            if start is None or us - start >= gap * 1_000_000 or len(groups[-1]) == size:
                groups.append([])
                start = us
            groups[-1].append(i)
        for k, g in enumerate(x for x in groups if len(x) >= floor):
            want |= {(stream, str(i)): k for i in g}
    got = windows.greedy_windows(spark.createDataFrame(rows, "stream_id long, message_id string, us long"), size, gap / 60, floor).collect()
    assert {(r["stream_id"], r["message_id"]): r["window_index"] for r in got} == want
    with pytest.raises(ValueError):
        windows.greedy_windows(spark.createDataFrame(rows, "stream_id long, message_id string, us long"), 0)


def test_a_hot_stream_is_shared_by_tasks(spark, monkeypatch):
    """Half of all messages are of one stream, and no task reads more than a few pieces of it."""
    monkeypatch.setattr(windows, "PIECE", 1000)
    rows = spark.range(20_000).selectExpr("case when id % 2 = 0 then 7 else id end as stream_id", "cast(id as string) as message_id", "id * 1000000 as us")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    made = windows.greedy_windows(rows, 50, 60, 5)
    sizes = [r["n"] for r in made.where("stream_id = 7").groupBy("stream_id", "window_index").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 200 and set(sizes) == {50}
    tasks = made.where("stream_id = 7").groupBy(F.spark_partition_id()).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) > 1 and max(r["count"] for r in tasks) < 10_000


def test_merge_short_spans_equals_loop(spark):
    rnd = random.Random(2)
    rows, want = [], []
    for video in range(40):
        cuts = sorted(rnd.sample(range(0, 1000), rnd.randint(2, 12)))
        spans = list(zip(cuts, cuts[1:]))
        rows += [(video, a, b) for a, b in spans]
        out = []
        for a, b in spans:
            if out and (b - a < 90 or out[-1][1] - out[-1][0] < 90):
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
        want += [(video, a, b) for a, b in out]
    got = windows.merge_short_spans(spark.createDataFrame(rows, "video_id long, start_ms long, end_ms long"), 90).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_merge_short_spans_keeps_no_programme_in_one_row(spark):
    spans = spark.range(60_000).selectExpr("id % 7 div 6 AS video_id", "id * 10 AS start_ms", "id * 10 + 70 AS end_ms")
    merged = windows.merge_short_spans(spans, 80)
    plan = merged._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "aggregate(" not in plan
    ends = spans.groupBy("video_id").agg({"end_ms": "max"}).collect()
    assert max(r["end_ms"] for r in merged.collect()) == max(r[1] for r in ends)


def test_detect_boundaries_equals_loop(spark):
    from airwave.operators import segment

    rnd = random.Random(4)
    blocks, sims, topics, want = [], [], [], {}
    for video in range(30):
        n = rnd.choice([1, 2, 3, 8, 25])
        sim = [0.0] + [rnd.randint(0, 9) / 10 for _ in range(n - 1)]
        usable = [rnd.random() < 0.9 for _ in range(n)]
        quiet = [rnd.choice([0, 0, 0, 0, 5000]) for _ in range(n)]
        topic = [(i // 4) % 2 if rnd.random() < 0.9 else 7 for i in range(n)]
        blocks += [(video, i, quiet[i], usable[i]) for i in range(n)]
        sims += [(video, i, sim[i]) for i in range(1, n)]
        topics += [(video, i, topic[i]) for i in range(n) if usable[i]]
        at = [i for i in range(n) if usable[i]]
        label = [topic[i] for i in at]
        smooth = label[:]
        for i in range(1, len(label) - 1):
            if label[i - 1] == label[i + 1] != label[i]:
                smooth[i] = label[i - 1]
        changes = {at[i] for i in range(1, len(smooth) - 1) if smooth[i - 1] != smooth[i] == smooth[i + 1]}
        dips = {r["gap"] for r in windows.depth_cutoff(windows.depth_scores(spark.createDataFrame(sims[-n + 1 :], "video_id long, gap long, similarity double"))).collect()} if n > 2 else set()
        middle = sorted(sim[i] for i in range(1, n) if usable[i])
        middle = middle[len(middle) // 2] if middle else 0.0
        for i in range(1, n) if n > 2 else ():
            why = sorted(name for name, hit in (("lexical-cohesion", i in dips), ("topic-change", i in changes), ("music-break", quiet[i] >= 4000)) if hit)
            if why and not (why == ["topic-change"] and sim[i] > middle):
                want[video, i] = (i * 30_000, why, min(1.0, 0.34 * len(why)))
    got = segment.detect_boundaries(
        spark.createDataFrame(blocks, "video_id long, block long, non_speech_ms long, usable boolean"),
        spark.createDataFrame(sims, "video_id long, gap long, similarity double"),
        spark.createDataFrame(topics, "video_id long, block long, topic int"),
    ).collect()
    assert {(r["video_id"], r["block"]): (r["at_ms"], r["reasons"], r["confidence"]) for r in got} == want
    assert any(x[1] == ["topic-change"] for x in want.values())


def test_chat_snapshot_reader(spark, tmp_path):
    lines = [json.dumps({"_stream": {"video_id": "abc"}}), json.dumps({"message_id": "1", "author": "u", "text": "hi", "published_at": "2026-01-01T00:00:00Z"}), "not json", json.dumps({"message_id": "2", "text": "  "})]
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    (tmp_path / "y.jsonl").write_text(json.dumps({"message_id": "3", "text": "yo", "published_at": "bad"}))
    got = {(r["video_id"], r["message_id"]) for r in files.read_chat_snapshots(spark, str(tmp_path)).collect()}
    assert got == {("abc", "1"), ("y", "3")}


def test_lenient_snapshot_fields(spark, tmp_path):
    """Floating, missing and textual offsets, any ISO time, white space, records that are no object, and late headers."""
    lines = [
        {"message_id": "a", "text": "\t hi\n", "published_at": "2024-01-02", "offset_ms": 12.7}, {"message_id": "b", "text": "x", "published_at": "2024-01-02T03:04:05+07", "offset_ms": -3.2},
        {"message_id": "c", "text": "\n\t"}, {"message_id": "d", "text": "y", "published_at": "2024-01-02T03:04:05.5", "offset_ms": "9"}, {"message_id": "e", "text": 7, "offset_ms": None, "published_at": "2024-01-02 03:04"}, {"_stream": {"video_id": "v" * 40}},
        [1, 2], "text", {"message_id": "f", "text": "z", "offset_ms": True, "published_at": "2024-01-02T03:04:05+0530"},
    ]
    (tmp_path / "s.jsonl").write_text("\n".join([*map(json.dumps, lines), "", "{broken", "null"]))
    got = {r["message_id"]: (r["video_id"], r["text"], r["offset_ms"], r["published_at"].isoformat()) for r in files.read_chat_snapshots(spark, str(tmp_path)).collect()}
    v = "v" * 32
    assert got == {"a": (v, "hi", 12, "2024-01-02T00:00:00"), "b": (v, "x", -3, "2024-01-01T20:04:05"), "d": (v, "y", None, "2024-01-02T03:04:05.500000"), "e": (v, "7", None, "2024-01-02T03:04:00"), "f": (v, "z", 1, "2024-01-01T21:34:05")}


def test_snapshot_refuses_to_shrink(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([("v", "T", None, str(i), "a", f"t{i}", 1_700_000_000 + i, i) for i in range(5)], "video_id string, title string, channel string, message_id string, author string, text string, s long, offset_ms long")
    rows = rows.selectExpr("* except (s)", "timestamp_seconds(s) AS published_at")
    files.write_chat_snapshots(rows, path)
    with pytest.raises(ValueError):
        files.write_chat_snapshots(rows.limit(2), path)
    assert [r["message_id"] for r in files.read_chat_snapshots(spark, path, 3).orderBy("message_id").collect()] == ["0", "1", "2"]
    head = files.snapshot_inventory(spark, path).first()
    assert (head["video_id"], head["title"], head["channel"], head["message_count"]) == ("v", "T", None, 5)
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "w.jsonl").write_text("{not json\n")
    assert files.snapshot_inventory(spark, str(tmp_path / "broken")).first()["title"] is None


def test_captions(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"events": [{"tStartMs": 10, "dDurationMs": 5, "segs": [{"utf8": "b"}]}, {"tStartMs": 0, "segs": [{"utf8": "a "}, {"utf8": "\n"}]}, {"tStartMs": 3, "segs": [{"utf8": "\n"}]}]}))
    got = [(r["cue_idx"], r["start_ms"], r["text"]) for r in files.read_captions(spark, str(tmp_path)).orderBy("cue_idx").collect()]
    assert got == [(0, 0, "a"), (1, 10, "b")]


def test_text_columns(spark):
    d = spark.createDataFrame([("<b>heyyyyy</b> &amp; see http://x.y/z @me !!!",), ("",), (None,)], "t string")
    from pyspark.sql import functions as F

    assert [r[0] for r in d.select(text.clean_text(F.col("t"))).collect()] == ["hey see !", "", None]
    ids = spark.createDataFrame([("https://e.org/watch?v=abcdefghijk&t=1",), ("abcdefghijk",), ("https://e.org/page",)], "t string")
    assert [r[0] for r in ids.select(text.video_id_from(F.col("t"))).collect()] == ["abcdefghijk", "abcdefghijk", None]
    with pytest.raises(ValueError):
        filters.explore(d, sort="size")


def test_streaming_twins(spark, tmp_path):
    rows = [{"stream_id": 1, "message_id": str(i % 40), "author": "a", "text": "t", "ts": f"2026-01-0{1 + i % 3}T00:00:{i % 60:02d}Z", "offset_ms": i, "sentiment": "positive", "is_spam": False} for i in range(50)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    segments = spark.createDataFrame([(7, 1, 0, 25)], "segment_id long, stream_id long, start_ms long, end_ms long")
    for name, make, n in (("d", jobs.stream_dedupe, 40), ("r", lambda s: jobs.stream_on_air(s, segments), 25)):
        jobs.drain(make(jobs.stream_messages(spark, str(tmp_path / "in"))), str(tmp_path / name), str(tmp_path / f"c{name}"))
        assert spark.read.parquet(str(tmp_path / name)).count() == n


def test_registry_against_duckdb(spark):
    import duckdb

    from airwave.plans import catalog

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("events", "documents", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    sql = catalog.oracle_sql()
    for name in ("greedy_windows", "reaction_overview", "build_blocks", "depth_scores", "blend", "pseudonymise", "trend_weekly", "tfidf_keywords"):
        df = catalog.queries()[name](spark, sf)
        r = con.execute(sql[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == sorted(df.columns), name
        tidy = lambda x: round(float(x), 5) if isinstance(x, float) else x
        assert sorted(repr([tidy(row[c]) for c in sorted(names)]) for row in df.collect()) == sorted(repr([tidy(dict(zip(names, row))[c]) for c in sorted(names)]) for row in r.fetchall()), name
