"""Index runs over a folder that changes."""

import os

import pytest

from glyphmill.config import Settings, as_bool, as_int, as_mode, merged
from glyphmill.operators.vectors import HashingEmbedder
from glyphmill.plans.maintenance import Index
from glyphmill.plans.search import search


def test_index_follows_the_folder(spark, tmp_path):
    lib = tmp_path / "lib"
    lib.mkdir()
    (lib / "talk-A.md").write_text("---\ntitle: 水泥\ndate: 2025-01-02\n---\n" + "光水泥就花了三千条，那个记者不说话。" * 30, "utf-8")
    (lib / "talk-B.md").write_text("短", "utf-8")
    (lib / "talk-C.md").write_text("Bad Gateway", "utf-8")
    settings = Settings(merged(Settings().values, {"sources": [{"id": "s", "root": str(lib), "include": ["talk-*.md"], "exclude": [], "clean": True}]}))
    index = Index(spark, str(tmp_path / "store"), settings, HashingEmbedder(16))
    first = index.reindex()[0]
    assert first.counts["processed"] == 3 and first.counts["dead"] == 1 and first.counts["empty"] == 1 and first.counts["vectors"] == first.counts["chunks"] > 0
    assert index.jobs.recent().first()["status"] == "done"
    os.utime(lib / "talk-A.md", (1, 1))
    (lib / "talk-B.md").write_text("现在有了足够长的正文，可以被切成一块了，所以它会进入索引里面去。", "utf-8")
    (lib / "talk-C.md").unlink()
    second = index.run(settings["sources"][0])
    assert {k: second.counts[k] for k in ("removed", "touched", "processed", "new")} == {"removed": 1, "touched": 1, "processed": 1, "new": 0}
    assert index.pending(settings["sources"][0]).isEmpty()
    docs, chunks = index.store.read("docs"), index.store.read("chunks")
    assert docs.count() == 2 and chunks.count() == index.store.read("embeddings").count()
    found = search(docs, chunks, "光水泥就花了", index.store.read("embeddings"), index.embedder)
    top = found.rows.first()
    assert found.mode == "hybrid" and top["title"] == "水泥" and top["rank"] == 1
    assert search(docs, chunks, "，。").mode == "empty" and "unknown source 'x'" in search(docs, chunks, "光水泥就花了", source="x").notes
    assert {r["name"]: r["bad"] for r in index.health().collect()} == dict.fromkeys(("chunks_not_indexed", "indexed_without_chunk", "postings_without_chunk", "indexed_text_differs"), 0)
    own = index.search("光水泥就花了")
    assert [tuple(r) for r in own.rows.collect()] == [tuple(r) for r in found.rows.collect()] and own.arms["both"] > 0
    assert search(docs, chunks, "光水泥就花了", mode="vector").mode == "vector(no-hit)"
    assert search(docs, chunks, "没有这样的话呀", index.store.read("embeddings"), index.embedder, mode="fts").mode == "fts(no-hit)"
    from glyphmill import __main__ as command
    from glyphmill.operators import catalog

    settings.save(str(tmp_path / "c.json"))
    run = lambda *words: command.rows_of(index, command.parser().parse_args([str(tmp_path), *words]))
    assert run("search", "光水泥就花了", "--mode", "odd", "--top-k", "1")[0].count() == 1 and run("search", "光水泥就花了")[1]["mode"] == "hybrid"
    assert run("list", "--limit", "x")[0].count() == 2 and run("stats")[0].count() == 1 and run("health")[0].count() == 4
    chunk = chunks.orderBy("seq", ascending=False).first()
    window = catalog.fetch(docs, chunks, chunk_id=chunk["chunk_id"], max_chars=90).first()
    assert window["doc_id"] == chunk["doc_id"] and chunk["text"][:40] in window["text"]
    assert catalog.fetch(docs, path="talk-A.md").first()["offset"] == 0 and catalog.fetch(docs, doc_id=-1).count() == 0
    with pytest.raises(ValueError):
        catalog.fetch(docs)
    other = Index(spark, str(tmp_path / "store"), settings, HashingEmbedder(32))
    notes = []
    assert other.fill_vectors(notes) == 0 and "rebuild" in notes[0]
    settings.values["scan"]["auto_index"] = False
    assert index.run(settings["sources"][0]).locked and index.run(settings["sources"][0], full=True).locked and index.ensure_fresh() == []
    with pytest.raises(ValueError):
        index.reindex(source="nope")


def test_settings(tmp_path):
    path = tmp_path / "c.json"
    Settings({"chunk": {"size": 10}, "_x": 1, "sources": [{"id": "a"}]}).save(str(path))
    loaded = Settings.load(str(path))
    assert loaded["chunk"] == {"size": 10, "overlap": 80} and loaded["sources"][0]["read_only"] is True and "_x" not in loaded.values
    assert as_bool("YES") and not as_bool(None) and as_int("7", 1, 0, 5) == 5 and as_int("x", 3, 0, 5) == 3
    assert as_mode("FTS") == ("fts", None) and as_mode("odd")[0] == "hybrid"
    assert [as_bool(v, True) for v in ("", "y", "n", 2, 0.0, "maybe", None)] == [False, True, False, True, False, True, True]
    assert as_int(float("inf"), 3, 0, 5) == 3


def test_a_run_that_breaks_off_is_made_again(spark, tmp_path, monkeypatch):
    lib = tmp_path / "lib"
    lib.mkdir()
    for name in "AB":
        (lib / f"{name}.md").write_text(f"第{name}篇。" + "光水泥就花了三千条，那个记者不说话。" * 30, "utf-8")
    settings = Settings(merged(Settings().values, {"sources": [{"id": "s", "root": str(lib), "include": ["*.md"], "exclude": [], "clean": True}]}))
    index = Index(spark, str(tmp_path / "store"), settings)
    upsert = index.store.upsert

    def lost(name, *args, **more):
        raise OSError("lost")

    monkeypatch.setattr(index.store, "upsert", lost)
    with pytest.raises(OSError):
        index.run(settings["sources"][0])
    monkeypatch.setattr(index.store, "upsert", upsert)
    assert index.run(settings["sources"][0], most=1).counts["processed"] == 1
    assert index.run(settings["sources"][0]).counts["processed"] == 1
    chunks = index.store.read("chunks")
    assert chunks.count() == chunks.select("chunk_id").distinct().count() and chunks.select("doc_id").distinct().count() == 2
    assert all(r["bad"] == 0 for r in index.health().collect())


def test_phrases_by_the_stored_index(spark):
    from glyphmill.operators.fulltext import TextIndex, bm25_scan, indexed_rows, placed_postings

    rows = [(1, 1, "那个记者认为aaaa水泥"), (2, 1, "记者那个，那个记 者认为"), (3, 2, "AAAAAA harbour Harbour"), (4, 2, None), (5, 2, "ab"), (6, 3, ""), (7, 3, "harb our 那个记者")]
    chunks = spark.createDataFrame(rows, "chunk_id long, doc_id long, text string")
    index = TextIndex.of(placed_postings(chunks), indexed_rows(chunks))
    for query in ("那个记者", "那个记者认为", "aaaa", "harbour aaa", "水泥", "没有的词语"):
        scan = {r["chunk_id"]: round(r["bm25"], 9) for r in bm25_scan(chunks, query).collect()}
        assert {r["chunk_id"]: round(r["bm25"], 9) for r in index.bm25(query).collect()} == scan
    empty = chunks.where("false")
    assert TextIndex.of(placed_postings(empty), indexed_rows(empty)).bm25("那个记者").count() == 0
