"""Numbering, components, incremental tables, stores, files, quotes, streams."""

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from glyphmill.operators import changes, incremental, quotes
from glyphmill.operators.components import connected_components
from glyphmill.operators.numbering import number_rows, value_ranks
from glyphmill.sources import files
from glyphmill.sources.tables import Store
from glyphmill.streaming import streams


def test_number_rows_over_buckets(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    out = number_rows(df, ["k"], F.floor(F.col("v") / 64), [F.col("v")], "n").collect()
    assert all(r["n"] == r["v"] // 2 + 1 for r in out)


def test_value_ranks_of_hot_groups(spark):
    rows = [(k, float(v % 400)) for k in ("a", "b", None) for v in range(800 if k == "a" else 5)] + [("a", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    plain = {(r["k"], r["v"]): r["r"] for r in value_ranks(df, ["k"], "v", "r").where("v < 1e9").collect()}
    split = {(r["k"], r["v"]): r["r"] for r in value_ranks(df, ["k"], "v", "r", hot=50).where("v < 1e9").collect()}
    assert plain == split and plain["a", 3.0] == 7 and plain[None, 4.0] == 5
    assert value_ranks(df, ["k"], "v", "r").where("v IS NULL OR isnan(v)").where("r IS NULL").count() == 2


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7), (None, 3), (101, 100)]
    out = connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    groups = defaultdict(set)
    for r in out:
        groups[r["component"]].add(r["node"])
    assert dict(groups) == {1: set(range(1, 41)), 100: {100, 101}}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_files_to_process(spark):
    docs = spark.createDataFrame(
        [("s", "same", "x", "2025-01-02T00:00:00", 1), ("s", "same", "x", "2025-01-02T00:00:00", 1), ("s", "new version", "x", "2025-01-01T00:00:00", 1),
         ("s", "went back", "x", "2025-01-01T00:00:00", 1), ("s", "went back", "y", "2025-01-03 00:00:00", 1), ("s", "unfinished", "x", "", 1),
         ("s", "unfinished", "x", None, 1), ("s", "only in docs", "x", "2025-01-01T00:00:00", 1), ("s", "null there", None, "2025-01-01T00:00:00", 1)],
        "source_id string, rel_path string, sha1 string, indexed_at string, extra int",
    )
    seen = spark.createDataFrame(
        [("s", "same", "old", "2025-02-01"), ("s", "same", "x", "2025-02-02"), ("s", "new version", "z", "2025-02-01"), ("s", "went back", "x", "2025-02-01"),
         ("s", "unfinished", "x", "2025-02-01"), ("s", "brand new", None, "2025-02-01"), ("s", "null there", "x", "2025-02-01"), (None, "same", "x", None)],
        "source_id string, rel_path string, sha1 string, seen_at string",
    )
    out = sorted((r[0] or "", r[1]) for r in incremental.files_to_process(docs, seen).collect())
    assert out == [("", "same"), ("s", "brand new"), ("s", "new version"), ("s", "null there"), ("s", "unfinished"), ("s", "went back")]
    assert incremental.files_to_process(docs, seen.where("false")).count() == 0
    assert incremental.files_to_process(docs.where("false"), seen).count() == 7


def test_incremental_table_survives_a_break(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").cast("string").alias("k"), (F.col("id") * 2).alias("v"))
    table = incremental.IncrementalTable(spark, str(tmp_path / "t"), ["k"], ["v"], buckets=8)
    derive = lambda df: df.select("k", (F.col("v") + 1).alias("w"), "bucket")
    assert table.run(rows, derive) == 8 and table.run(rows, derive) == 0
    changed = rows.withColumn("v", F.when(F.col("k") == "7", F.lit(-1)).otherwise(F.col("v"))).where("k <> '9'")

    def broken(df):
        raise RuntimeError("lost")

    try:
        table.run(changed, broken)
    except RuntimeError:
        pass
    assert 1 <= table.run(changed, derive) <= 2
    got = {r["k"]: r["w"] for r in table.read().collect()}
    assert len(got) == 199 and got["7"] == 0 and got["8"] == 17 and "9" not in got
    assert table.run(changed.where("false"), derive) == 8 and table.read().count() == 0


def test_emptied_buckets_keep_no_rows(spark, tmp_path):
    table = incremental.IncrementalTable(spark, str(tmp_path / "t"), ["k"], ["v"], buckets=4)
    rows = spark.createDataFrame([(None, "live"), ("b", "live"), ("c", None), ("b", "live")], "k string, v string")
    live = lambda df: df.where("v = 'live'").select("bucket", "k")
    table.run(rows, live)
    assert sorted(r["k"] or "" for r in table.read().collect()) == ["", "b", "b"]
    assert table.run(rows.withColumn("v", F.lit("dead")), live) >= 2 and table.read().count() == 0
    assert table.run(rows.withColumn("v", F.lit("dead")), live) == 0


def test_rows_that_come_during_a_run_are_not_lost(spark, tmp_path):
    table = incremental.IncrementalTable(spark, str(tmp_path / "t"), ["k"], ["v"], buckets=4)
    where = str(tmp_path / "rows")
    spark.createDataFrame([(1, 1)], "k long, v long").write.parquet(where)

    def late(df):
        spark.createDataFrame([(2, 2)], "k long, v long").write.mode("append").parquet(where)
        return df.select("bucket", "k")

    table.run(spark.read.parquet(where), late)
    assert table.run(spark.read.parquet(where), lambda df: df.select("bucket", "k")) >= 1
    assert sorted(r["k"] for r in table.read().collect()) == [1, 2]


def test_first_run_that_broke_off_leaves_nothing(spark, tmp_path):
    where = tmp_path / "t"
    spark.createDataFrame([("old", True, None, None, 3)], "k string, __live boolean, __rows long, __hash string, bucket int").write.partitionBy("bucket").parquet(str(where))
    table = incremental.IncrementalTable(spark, str(where), ["k"], ["k"], buckets=4)
    table.run(spark.createDataFrame([("new",)], "k string"), lambda df: df.select("bucket", "k"))
    assert [r["k"] for r in table.read().collect()] == ["new"]


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.upsert("docs", spark.createDataFrame([(1, "a", "h1"), (2, "b", "h2")], "doc_id long, t string, head string"), ["doc_id"])
    store.upsert("docs", spark.createDataFrame([(2, "c", "h9"), (3, "d", "h3")], "doc_id long, t string, head string"), ["doc_id"], keep=["head"])
    assert sorted(map(tuple, store.read("docs").collect())) == [(1, "a", "h1"), (2, "c", "h2"), (3, "d", "h3")]
    store.update("docs", spark.createDataFrame([(1, "z")], "doc_id long, t string"), ["doc_id"])
    store.append("chunks", spark.createDataFrame([(10, 1), (20, 2)], "chunk_id long, doc_id long"))
    store.append("embeddings", spark.createDataFrame([(10,), (20,)], "chunk_id long"))
    store.delete_documents(spark.createDataFrame([(1,)], "doc_id long"))
    assert [r["doc_id"] for r in store.read("docs").orderBy("doc_id").collect()] == [2, 3]
    assert store.read("chunks").count() == 1 and store.read("embeddings").count() == 1


def test_files_and_stream(spark, tmp_path):
    root = tmp_path / "lib"
    for name, data in {"a/talk-1.md": "文" * 50, "b.txt": "x", ".git/c.md": "y", "node_modules/d.md": "z", "talk-2.md": "字" * 400}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data.encode())
    listed = files.list_files(spark, str(root), ["**/talk-*.md"], ["**/none/**"], content=True)
    rows = {r["rel_path"]: r for r in listed.withColumn("h", files.digest(F.col("content"))).collect()}
    assert sorted(rows) == ["a/talk-1.md", "talk-2.md"]
    assert rows["a/talk-1.md"]["h"] == hashlib.sha1(("文" * 50).encode()).hexdigest()
    seen = {}

    def sink(docs, chunks, number):
        seen[number] = (docs.count(), chunks.count())

    for expected in (1, 0):
        query = streams.ingest_stream(files_stream(spark, root), sink, str(tmp_path / "ckpt"))
        query.awaitTermination()
        assert len(seen) == 1, expected
    assert seen[0] == (2, 3)


def files_stream(spark, root):
    return streams.file_stream(spark, str(root), "s", "talk-*.md")


def test_unique_events(spark, tmp_path):
    events = spark.createDataFrame([(1, "2025-01-01 00:00:00", "a"), (2, "2025-01-20 00:00:00", "a"), (2, "2025-01-20 00:00:00", "a")], "event_id long, ts string, event_type string")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    query = streams.unique_events(stream, "event_id")
    run = query.writeStream.format("memory").queryName("once").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    run.awaitTermination()
    assert spark.table("once").count() == 2
    assert streams.event_counts(events, "7 days").agg(F.sum("n")).first()[0] == 3


def test_quote_ladder(spark):
    body = "第一句。他去了那个地方，买了三斤苹果和两只鸡。然后回家睡觉，一夜无话，天亮才醒。"
    docs = spark.createDataFrame([(1, body, "头部文字也在这里写着\n" + body), (2, "别的文章里也有这样一句独一无二的话语。", None), (3, None, None)], "doc_id long, body string, body_raw string")
    cases = {
        1: ("他去了那个地方，买了三斤苹果", None, "verbatim"),
        2: ("他去了 那个地方，买了\n三斤苹果", None, "whitespace"),
        3: ("他去了那个地方买了三斤苹果！和两只鸡", None, "loose"),
        4: ("他去了那个地方（其实没去），买了三斤苹果", None, "annotated"),
        5: ("他去了那个地方，买了五斤苹果和两只鸡", 1, "modified"),
        6: ("这样一句独一无二的话语", 1, "other_doc"),
        7: ("头部文字也在这里写着", 1, "not_in_body"),
        8: ("火星上的居民每天只吃石头", None, "not_found"),
        9: ("嗯", None, "error"),
        10: ("他去了那个地方……一夜无话，天亮才醒", None, "verbatim"),
        11: (None, None, "error"),
    }
    rows = spark.createDataFrame([(k, q, d) for k, (q, d, _) in cases.items()], "quote_id long, quote string, declared long")
    got = {r["quote_id"]: r for r in quotes.verify_quotes(rows, docs).collect()}
    assert {k: got[k]["status"] for k in cases} == {k: s for k, (_, _, s) in cases.items()}
    assert got[10]["fragments"] == 2 and got[10]["ok"] and not got[5]["ok"]
    assert quotes.differences("买五斤", "买三斤") == (["五"], ["三"])
    summary = quotes.summary(quotes.verify_quotes(rows, docs)).first()
    assert summary["total"] == 11 and summary["verbatim"] == 2 and summary["other_doc"] == 1


def test_articles(spark):
    text = "出处 BV1234567890\n> 他说「一二三四五」还有『六七八九』\n普通「不算的一句」\nBVabcdefghij\n> “甲乙丙丁戊”"
    rows = quotes.extract_quotes(spark.createDataFrame([(1, text)], "article_id long, text string")).orderBy("line", "quote").collect()
    assert [(r["line"], r["quote"], r["ext_id"]) for r in rows] == [(2, "一二三四五", "BV1234567890"), (2, "六七八九", "BV1234567890"), (5, "甲乙丙丁戊", "BVabcdefghij")]


def test_reaped_jobs(spark):
    jobs = spark.createDataFrame(
        [("a", "running", "", "2025-01-01T11:46:00", 5), ("b", "running", "", "2025-01-01T11:44:00", 5), ("c", "running", "", "2025-01-01T11:59:00", 6),
         ("d", "running", "2025-01-01T11:31:00", "", 0), ("e", "running", "bad", "", 0), ("f", "done", "", "", 0)],
        "id string, status string, started_at string, updated_at string, pid long",
    )
    alive = spark.createDataFrame([(5,)], "pid long")
    got = {r["id"]: r["reason"] for r in changes.reap_jobs(jobs, F.to_timestamp(F.lit("2025-01-01 12:00:00")), alive).collect()}
    assert got == {"b": "silent", "c": "process gone", "e": "lost"}
