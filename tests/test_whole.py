"""Queries over whole tables, compared with brute force on small tables."""

import re

from glyphmill import queries as core
from glyphmill.operators.chunking import chunk_spans

BLANKS = ["全角　空格、和 「引号」", "﻿開頭​中間", "カナ  é\r\n\r\n末", "　　", "plain  text", "长" * 80 + "　尾"]


def test_snippets_of_all_chunks(spark, tmp_path):
    rows = [*enumerate(BLANKS), (99, None)]
    spark.createDataFrame(rows, "id long, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    got = {r["chunk_id"]: r["snippet"] for r in core.queries()["snippets_all"](spark, str(tmp_path)).collect()}
    folded = {i: re.sub(r"\s+", " ", t).strip() for i, t in enumerate(BLANKS)}
    assert got == {i: t if len(t) <= 60 else t[:60] + "…" for i, t in folded.items()}


def test_chunks_of_all_documents(spark, tmp_path):
    rows = [*enumerate([*BLANKS, "", "　首" + "一二三四五 六七\r\n" * 90 + "​"]), (99, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_chunks"], r["chars"]) for r in core.queries()["chunk_documents_all"](spark, str(tmp_path)).collect()}
    want = {}
    for i, text in rows:
        body = (text or "").replace("\r\n", "\n").replace("\r", "\n").strip()
        if cut := chunk_spans(body, 350, 80, 20):
            want[i] = (len(cut), sum(map(len, cut)))
    assert got == want


def test_blocks_are_those_of_difflib():
    import difflib
    import random

    from glyphmill.operators import quotes

    draw = random.Random(5)
    for _ in range(150):
        text = "".join(draw.choice("甲乙丙丁 戊") for _ in range(draw.randint(0, 200)))
        needles = ["".join(draw.choice("甲乙丙丁己") for _ in range(draw.randint(3, 90))) for _ in range(6)]
        near, hay = quotes.Nearness(needles), quotes.Hay(text)
        blocks = {i: (a, b) for i, a, b in near.near(hay.view(False).text, near.least(0.0))}
        likely = {i for i, _, _ in near.near(hay.view(False).text, near.least(0.6))}
        for i, needle in enumerate(needles):
            want = difflib.SequenceMatcher(None, needle, hay.view(False).text, autojunk=False).find_longest_match()
            assert blocks.get(i) == ((want.a, want.b) if want.size >= 3 else None)
            assert i in likely or quotes.similarity(needle, hay)[0] < 0.6


def test_edits_in_every_seed(spark):
    from glyphmill.operators import quotes

    text = "那年冬天河面结冰很早，渡口的船工把木船拖上岸来，又用麻绳一圈圈捆在老柳树下等开春再用"
    edited = "".join("某" if k % 7 == 4 else c for k, c in enumerate(text))
    docs = spark.createDataFrame([(1, "开头。" + text + "。结尾。", None), (2, "另一篇没有关系的文章。", None)], "doc_id long, body string, body_raw string")
    rows = spark.createDataFrame([(1, edited, None), (2, "（，）。x！", None)], "quote_id long, quote string, declared long")
    got = {r["quote_id"]: r for r in quotes.verify_quotes(rows, docs).collect()}
    assert (got[1]["status"], got[1]["doc_id"]) == ("modified", 1)


def test_model_agreement(spark, tmp_path, monkeypatch):
    import numpy as np

    from glyphmill.operators import vectors

    monkeypatch.setattr(vectors, "AGREEMENT_BLOCK", 16)
    draw = np.random.default_rng(3)
    a, c = draw.normal(size=(40, 8)), draw.normal(size=(40, 6))
    b = a + 0.4 * draw.normal(size=a.shape)
    rows = [(i, m, x.shape[1], x[i].tolist()) for m, x in (("a", a), ("b", b), ("c", c)) for i in range(40) if (m, i) != ("c", 7)]
    spark.createDataFrame(rows, "chunk_id long, model string, dim int, vec array<double>").write.parquet(f"{tmp_path}/chunk_embeddings.parquet")
    got = {(r["model_a"], r["model_b"]): r for r in core.queries()["model_agreement"](spark, str(tmp_path)).collect()}

    def near(x):
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        score = u @ u.T - 9 * np.eye(len(u))
        return np.argsort(-score, axis=1)[:, :5]

    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    for pair, (x, y) in {("a", "b"): (a, b), ("a", "c"): (np.delete(a, 7, 0), np.delete(c, 7, 0))}.items():
        p, q = near(x), near(y)
        assert got[pair]["common"] == len(x)
        assert abs(got[pair]["top1_agreement"] - (p[:, 0] == q[:, 0]).mean()) < 1e-9
        assert abs(got[pair]["top5_overlap"] - np.mean([len({*s} & {*t}) / 5 for s, t in zip(p, q, strict=True)])) < 1e-9
    cosine = (a * b).sum(1) / np.linalg.norm(a, axis=1) / np.linalg.norm(b, axis=1)
    ab = got["a", "b"]
    assert np.allclose([ab["mean_cosine"], ab["min_cosine"], ab["p1_cosine"]], [cosine.mean(), cosine.min(), np.percentile(cosine, 1)])
    assert got["a", "c"]["mean_cosine"] is None


def test_order_of_the_ladder(spark):
    from glyphmill.operators import quotes

    line = "他去了那个地方，买了三斤苹果和两只鸡"
    docs = spark.createDataFrame(
        [(1, "开头。" + line.replace("三", "五") + "。", "开头"), (2, "别处。" + line + "。" + line, None), (3, "正文没有。", "来源：档案馆抄本第七页\n正文没有。")],
        "doc_id long, body string, body_raw string",
    )
    cases = [(1, line, 1), (2, line, None), (3, "来源：档案馆抄本第七页", 3), (4, "他去了（据说是走路）那个地方，买了三斤苹果", None), (5, "，。", None), (6, "完全没有写过的一句话在这里", 2)]
    rows = spark.createDataFrame(cases, "quote_id long, quote string, declared long")
    got = {r["quote_id"]: r for r in quotes.verify_quotes(rows, docs).collect()}
    assert {i: (r["status"], r["doc_id"]) for i, r in got.items() if i < 5} == {1: ("other_doc", 2), 2: ("verbatim", 2), 3: ("not_in_body", 3), 4: ("annotated", 2)}
    assert got[4]["annotations"] == ["（据说是走路）"] and got[4]["extra"] == [] and got[2]["occurrences"] == 2 and got[2]["context"].startswith("别处。")
    assert got[5]["status"] == "error" and got[6]["status"] == "not_found"
    one = quotes.summary(quotes.verify_quotes(rows, docs)).first()
    assert (one["total"], one["failed"], one["failed_quotes"], one["ok"]) == (6, 3, [3, 5, 6], False)


def test_details_of_verdicts(spark):
    from glyphmill.operators import quotes

    body = "第一句。他去了那个地方，买了三斤苹果和两只鸡。" + "".join(f"第{k}天回家睡觉，" for k in range(100, 160))
    docs = spark.createDataFrame([(1, body, None)], "doc_id long, body string, body_raw string")
    cases = [(1, "他去了那个地方，买了五斤苹果和两只鸡"), (2, "他去了那个地方买了三斤苹果"), (3, "买了三斤苹果然而星辰大海无边无际"), (4, body[200:460])]
    rows = spark.createDataFrame([(i, q, None) for i, q in cases], "quote_id long, quote string, declared long")
    got = {r["quote_id"]: r for r in quotes.verify_quotes(rows, docs).collect()}
    assert (got[1]["status"], got[1]["extra"], got[1]["missing"]) == ("modified", ["五"], ["三"])
    assert got[1]["matched"] == "他去了那个地方，买了三斤苹果和两只鸡"
    assert (got[2]["status"], got[2]["matched"], got[2]["extra"], got[2]["in_chunk"]) == ("loose", "他去了那个地方，买了三斤苹果", [], False)
    assert (got[3]["status"], got[3]["matched"]) == ("not_found", None)
    assert got[3]["suggestion"].startswith("买了三斤苹果") and 0.3 <= got[3]["ratio"] < 0.6
    assert got[4]["status"] == "verbatim" and not got[4]["in_chunk"]
