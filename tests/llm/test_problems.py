"""Operators for training data on small fixtures: brute force, round trips, odd rows."""

import math
import os
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("glyphmill.llm.queries")

from glyphmill.llm import fusion, leaks, lookalikes, mojibake, neardup, neighbours, packing, recurring, sentences, splitting  # noqa: E402

DATA = "/root/testdata/sf0.001"
ZH = "那个记者认为水泥太地下，光水泥就花了三千条。"


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="甲乙。，\n ab.é́‍😀", max_size=700))
def test_pieces_restore_the_text(text):
    spans = splitting.cut_points(text, 100, 20)
    rebuilt, at = "", 0
    for a, b in spans:
        assert 0 <= b - a <= 100 and a <= at <= b
        rebuilt, at = rebuilt + text[at:b], b
    assert rebuilt == text and (len(text) <= 100) == (len(spans) == 1)


def test_pieces_end_at_pauses_and_overlap():
    text = ZH * 60
    spans = splitting.cut_points(text, 350, 80)
    assert all(text[b - 1] in "。，" for _, b in spans)
    assert all(80 <= spans[i][1] - spans[i + 1][0] <= 100 for i in range(len(spans) - 1))
    hard = splitting.cut_points("字" * 1000, 350, 80)
    assert [b - a for a, b in hard][:2] == [350, 350] and hard[1][0] == 270


def test_new_order(spark):
    rows = [(1, 9, 0, "短"), (1, 9, 0, "短"), (2, 9, 1, "字" * 800), (3, 9, 5000, "尾"), (4, 9, 6000, None), (5, None, None, ""), (6, 8, 2, "x")]
    df = spark.createDataFrame(rows, "id long, doc_id long, seq int, text string")
    out = splitting.resequence(df).orderBy("doc_id", "seq").collect()
    assert [(r["chunk_id"], r["seq"]) for r in out if r["doc_id"] == 9] == [(1, 0), (2, 1), (2, 2), (2, 3), (3, 4)]
    assert all(r["n_chars"] == len(r["text"]) <= 350 for r in out)
    assert splitting.resequence(df.where("false")).count() == 0


def test_fusion_against_plain_python(spark):
    rng = np.random.default_rng(1)
    rows = []
    for q in range(3):
        for c in range(40):
            v = [None if rng.random() < 0.15 else float(rng.integers(0, 30)) for _ in range(4)]
            rows.append((q, c, *v, "x"))
    rows += rows[:5] + [(7, 1, None, None, None, None, "x"), (8, 1, float("nan"), float("inf"), None, 1.0, "x")]
    df = spark.createDataFrame(rows, "query_id long, chunk_id long, bm25 double, cosine double, like_hits double, age_days double, rank string")
    expected = {}
    for q in range(3):
        own = {r[1]: r[2:6] for r in rows if r[0] == q}
        terms = defaultdict(list)
        for i, higher in enumerate(fusion.SEARCH_ARMS.values()):
            worth = {c: (-v[i] if higher else v[i]) for c, v in own.items() if v[i] is not None}
            for c, w in worth.items():
                terms[c].append(1 / (61 + sum(x < w for x in worth.values())))
        total = {c: round(sum(sorted(t)) + (sum(sorted(t)) / len(t) if len(t) < 4 else 0), 12) for c, t in terms.items()}
        expected[q] = sorted(total, key=lambda c: (-total[c], c))
    for top, hot in ((10, 10**6), (None, 10**6), (None, 10)):
        got = fusion.fuse_ranks(df, ["query_id"], "chunk_id", fusion.SEARCH_ARMS, top=top, hot=hot).collect()
        for q in range(3):
            order = [r["chunk_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
            assert order == expected[q][:top]
        assert not [r for r in got if r["query_id"] == 7] and len([r for r in got if r["query_id"] == 8]) == 1
    assert fusion.fuse_ranks(df.where("false"), ["query_id"], "chunk_id", fusion.SEARCH_ARMS).count() == 0


def test_garbled_text(spark):
    good = ZH * 30 + "Der Müller prüfte „die Straße“. SÃO MARÉ, Señal, café."
    cases = [
        ("utf-8", "cp1251", "Die Straße und die Mühle"), ("utf-8", "latin-1", ZH), ("utf-8", "gb18030", ZH), ("gbk", "latin-1", ZH),
        ("gbk", "big5", "那个记者认为水泥太地下"), ("utf-8", "cp437", "Die Mühle"), ("utf-8", "koi8-r", ZH),
    ]
    rows = [("t", 100 + i, good) for i in range(20)] + [("t", 1, None), ("t", 2, ""), ("t", 3, "НАТО и СССР, café, SÃO MARÉ"), ("t", 4, "价格��")]
    for i, (wrote, read, text) in enumerate(cases):
        rows.append(("t", 10 + i, "开头很好。" + text.encode(wrote).decode(read, "replace") + "\n结尾"))
    df = spark.createDataFrame(rows, "rec string, rec_id long, text string").withColumnRenamed("spans", "spans")
    got = {r["rec_id"]: r for r in mojibake.repair(df).collect()}
    assert set(got) == {4} | {10 + i for i in range(len(cases))}
    for i, (_, _, text) in enumerate(cases):
        if not got[10 + i]["lost"]:
            assert text in got[10 + i]["restored"] and got[10 + i]["restored"].startswith("开头很好。")
    assert mojibake.repair(df.where("false")).count() == 0


def test_look_alikes(spark):
    same = ["café GPS 工厂 12", "café GPS 工厂 12", "саfé GPЅ ⼯⼚ １２", "ca​fé　GPS 工厂 12⁠"]
    other = ["cafe GPS 工厂 12", "café GPS 工厂 12!", "café GPS 工厂 12！", "👨‍👩‍👧", "👨👩👧"]
    rows = [(i, t) for i, t in enumerate(same + other)] + [(0, same[0]), (50, same[0]), (60, None), (61, ""), (62, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {tuple(r) for r in lookalikes.same_look_pairs(df).collect()}
    first = [0, 1, 2, 3, 50]
    assert got == {(a, b) for a in first for b in first if a < b and (a, b) != (0, 50)}
    forms = lookalikes.with_form(df).collect()
    assert len({r["form"] for r in forms if r["id"] in first}) == 1
    assert [r["form"] for r in forms if r["id"] in (60, 61)] == [None, ""]
    assert lookalikes.same_look_pairs(df.where("false")).count() == 0


def test_plain_texts_follow_their_class():
    # a letter of another alphabet is the most frequent of its class
    table = lookalikes.representatives({"Е": 9, "E": 3})
    assert table["E"] == "Е"
    forms = lookalikes.rewriter(table)(["É E", "E\u0301 Е", None, "", "水泥"])
    assert forms[0] == forms[1] and forms[2:] == [None, "", "水泥"]


def test_near_duplicates(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(chr(int(c)) for c in rng.integers(0x4E00, 0x5E00, 6))
    base = ["，".join(word() for _ in range(30)) for _ in range(30)]
    rows, truth = [], set()
    for g, text in enumerate(base):
        parts = text.split("，")
        rows += [("chunks", 10 * g, text), ("chunks", 10 * g + 1, "，".join(parts[:5] + [word()] + parts[6:20] + [word()] + parts[21:])), ("chunks", 10 * g + 2, "，".join(parts[15:] + parts[:15]))]
        truth |= {("chunks", 10 * g + a, 10 * g + b) for a, b in ((0, 1), (0, 2), (1, 2))}
    rows += [("docs", 0, base[0]), ("docs", 1, base[0]), ("docs", 2, None), ("docs", 3, ""), ("docs", 4, " "), ("docs", 1, base[0])]
    df = spark.createDataFrame(rows, "rec string, id long, text string")
    got = {tuple(r) for r in neardup.duplicate_pairs(neardup.near_duplicates(df)).collect()}
    assert got == truth | {("docs", 0, 1)}
    assert neardup.near_duplicates(df.where("false")).count() == 0


def test_crowded_table_entries(spark, monkeypatch):
    rng = np.random.default_rng(4)
    text = "".join(chr(int(c)) for c in rng.integers(0x4E00, 0x5E00, 300))
    rows = [("chunks", i, text[: 5 * i] + "变" + text[5 * i :]) for i in range(40)]
    df = spark.createDataFrame(rows, "rec string, id long, text string")
    monkeypatch.setattr(neardup, "SMALL", 5)
    assert {r["component"] for r in neardup.near_duplicates(df).collect()}.__len__() == 1


def test_neighbours_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 32))
    x = np.repeat(centres, 6, axis=0) + 0.15 * rng.normal(size=(360, 32))
    x = np.concatenate([x, rng.normal(size=(240, 32)), np.repeat(centres[:1], 12, axis=0)]).astype(np.float32)
    rows = [(i, 32, v.tolist(), "m") for i, v in enumerate(x)]
    rows += [rows[0], (700, 32, [0.0] * 32, "m"), (701, 32, None, "m"), (702, 32, [float("nan")] * 32, "m"), (703, 32, [1.0], "m"), (704, 32, x[0].tolist(), "other"), (705, None, None, None)]
    df = spark.createDataFrame(rows, "chunk_id long, dim int, vec array<float>, model string")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit.astype(np.float64) @ unit.T.astype(np.float64)
    np.fill_diagonal(s, -2)
    best = {i: [j for j in sorted(range(len(x)), key=lambda j: (-round(s[i, j], 6), j))[:5]] for i in range(len(x))}
    truth = {(i, j) for i, js in best.items() for j in js if s[i, j] >= 0.8}
    got = {(r["chunk_id"], r["neighbour"]) for r in neighbours.similar_pairs(df, list_size=100).collect()}
    pairs = lambda p: {(min(a, b), max(a, b)) for a, b in p}
    assert len(pairs(truth) & pairs(got)) >= 0.9 * len(pairs(truth)) and len(pairs(got) - pairs(truth)) <= 0.03 * len(truth)
    monkeypatch.setattr(neighbours, "MAX_GROUP", 40)
    parts = neighbours.similar_pairs(df.repartition(12), list_size=300).collect()
    assert len(pairs(truth) & pairs((r["chunk_id"], r["neighbour"]) for r in parts)) >= 0.9 * len(pairs(truth))
    near = neighbours.nearest(df, every=10).collect()
    hits = sum(r["neighbour"] in best[r["chunk_id"]] for r in near if r["model"] == "m")
    assert hits >= 0.9 * 5 * len({r["chunk_id"] for r in near if r["model"] == "m"})
    assert neighbours.similar_pairs(df.where("false")).count() == 0 and neighbours.nearest(df.where("false")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30))
def test_packing_patterns(histogram):
    patterns = packing.shortest_pack_first(histogram, 64)
    placed = Counter()
    for p, n in patterns:
        assert sum(p) <= 64
        for length in p:
            placed[length] += n
    assert placed == Counter(histogram)


def test_packed_documents(spark):
    rng = np.random.default_rng(5)
    sizes = [(i, int(n), "x") for i, n in enumerate(rng.integers(0, 300, 500))] + [(900, 1000, "x"), (901, 64, "x"), (902, None, "x")]
    df = spark.createDataFrame(sizes, "doc_id long, tokens long, sequence string")
    out = packing.pack(df, 64).collect()
    per_doc, per_seq = Counter(), Counter()
    for r in out:
        per_doc[r["doc_id"]] += r["tokens"]
        per_seq[r["sequence"]] += r["tokens"]
    assert all(per_doc[d] == (n or 0) for d, n, _ in sizes) and len(per_doc) == len(sizes)
    per_seq.pop(-1, None)
    assert max(per_seq.values()) <= 64 and sorted(per_seq) == list(range(len(per_seq)))
    assert len(per_seq) <= 1.05 * math.ceil(sum(n or 0 for _, n, _ in sizes) / 64)
    assert {r["doc_id"] for r in out if r["part"] > 0} <= {d for d, n, _ in sizes if (n or 0) > 64}
    assert packing.pack(df.where("false"), 64).count() == 0


def test_tokens_of_whole_texts():
    long = "很长的一行" * 9000
    counts = packing.token_counts([None, "", "水泥", long])
    assert counts[:2] == [0, 0] and counts[2] > 0 and counts[3] > 9000


def test_leaks(spark):
    rng = np.random.default_rng(6)
    text = lambda n: "".join(chr(int(c)) for c in rng.integers(0x4E00, 0x5E00, n))
    passages = [text(120) for _ in range(6)]
    stock = "请阅读下面的材料，然后回答问题。"
    items = [(i, stock + p + "吗？") for i, p in enumerate(passages)] + [(90, None), (91, ""), (92, "短")]
    filler = lambda: "。".join(text(30) for _ in range(20))
    docs = [
        (1, filler() + passages[0] + filler()), (2, filler() + passages[1][:60] + "，改了" + passages[1][62:] + filler()), (3, filler() + stock + filler()),
        (4, passages[2][:30] + filler()), (5, passages[3][:60] + text(10) + passages[3][60:]), (6, None), (7, ""), (1, "x"),
        (8, passages[4][60:] + filler() * 3 + passages[4][:20]), (9, "　".join(passages[5])),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaked_items(d, q).collect()}
    assert got == {(1, 0), (2, 1), (5, 3), (8, 4), (9, 5)}
    assert leaks.leaked_items(d.where("false"), q).count() == 0 and leaks.leaked_items(d, q.where("false")).count() == 0


def test_rolling_hash_is_that_of_the_window():
    seq = np.array([5, 9, 3, 7, 8, 2, 1, 4] * 2, dtype=np.uint32)
    for size in (1, 2, 5, 8):
        h = leaks.rolling(seq, size)
        assert len(h) == 17 - size and all((h[i] == h[j]) == (list(seq[i : i + size]) == list(seq[j : j + size])) for i in range(len(h)) for j in range(len(h)))


SENTENCES = [
    ("他说：「甲。乙！」丙在丁。", ["他说：「甲。乙！」", "丙在丁。"]),
    ("“走吧。”他说道。然后（真的。）走了！", ["“走吧。”他说道。", "然后（真的。）走了！"]),
    ("看《为什么？》这本书，价格3.5元。好……", ["看《为什么？》这本书，价格3.5元。", "好……"]),
    ("# 标题\n- 一项。还有\n主持人：你好。\n没有句号的一行", ["# 标题", "- 一项。还有", "主持人：你好。", "没有句号的一行"]),
    ("Mr. A. B. Smith came at 6 a.m. The dog slept (see No. 5) ... and left.", ["Mr. A. B. Smith came at 6 a.m.", "The dog slept (see No. 5) ... and left."]),
    ("“Who?” asked Tom.\nIt was wrapped\nhere.", ["“Who?” asked Tom.", "It was wrapped\nhere."]),
    ("「行った。」と彼は言った。次だ！", ["「行った。」と彼は言った。", "次だ！"]),
    ("แมวกินปลา หมานอนหลับ", ["แมวกินปลา", "หมานอนหลับ"]),
    ("---\ntitle: x\n---\n\n正文。", ["正文。"]),
    ("﻿好。\r\n", ["好。"]),
    ("<html><body>502</body></html>", []), ('{"error":{"code":1}}', []), ("Request Entity Too Large (12)", []), ("", []), (" \n", []), (None, []),
]


LESSONS = [
    "The old clerk sold it. Mr. Smith saw no. 5 at 6 a.m. The dog slept. J. B. Hill left.\n\nIt ended. Then Martin saw Ann. He met Wilson. She saw Bob. They came. ",
    "“Where?” asked the clerk. The porter wrapped\nit here. (See vol. 3.) He left ... and came. Stop! Now? Yes.",
    "“走了。”他说。钟声停了！谁知道？没有人……后来呢？有……有人说：“好！”天亮了。\n主持人：你好。我来了。\n没有句号的一行\n又是一行",
    "甲看《怎么办？》很久。（完。）乙走了。价格3.5元，涨了2.1倍。后来（是的。）他来了！天晴（不是。）还冷。（完了。）",
    "「行く。」と彼は言った。雨だ！次は何？分からない。\n「来た！」次の日だ。",
    "แมวกินปลา หมานอน นกบินไป ฝนตกหนัก",
]


@pytest.fixture(scope="module")
def boundary_model():
    rows, labels = [], []
    for text in LESSONS * 40:
        own, marks = sentences.training_rows(text)
        rows += own
        labels += marks
    return sentences.BoundaryModel().fit(rows, labels)


@pytest.mark.parametrize("text,expected", SENTENCES)
def test_sentences(text, expected, boundary_model):
    assert [text[a:b] for a, b in sentences.sentence_spans(text, boundary_model)] == expected


def test_every_candidate_is_judged_by_the_model():
    class Never(sentences.BoundaryModel):
        def ends(self, shown):
            return False

    for text, _ in SENTENCES:
        # only where nothing follows does a sentence end without the model
        assert len({b for _, b in sentences.sentence_spans(text, Never())}) <= 1 or "#" in text or "\n主持" in text


def test_sentence_rows(spark):
    rows = [(1, "甲。乙。"), (2, None), (3, ""), (4, "One here. Two there.")] + [(10 + i, t) for i, t in enumerate(LESSONS * 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, sentences.split_sentences(df).collect()))
    assert got[:2] == [(1, 0, 2), (1, 2, 4)] and {r[0] for r in got if r[0] < 10} == {1, 4}
    assert sentences.split_sentences(df.where("false")).count() == 0


def test_boundary_model_on_held_out_text():
    train = "The tram clerk sold it. Dr. Hill saw vol. 5, p. 7 there. Am 3. Mai kam er. He left at 7 p.m. The end came. " * 30
    rows, labels = sentences.training_rows(train + "\n\n" + train)
    model = sentences.BoundaryModel().fit(rows, labels)
    held, truth = sentences.training_rows("The wool porter hid it. Prof. Moor read vol. 8, p. 9 here. Am 9. Juni ging er. She came at 5 a.m. The bell rang.")
    assert sum((model.score(f) > 0) == bool(y) for f, y in zip(held, truth, strict=True)) >= 0.9 * len(truth)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p2_ranking", "p6_found", "p8_audit_2048"])
def test_query_matches_sql(spark, name):
    import glob

    import duckdb

    from glyphmill.llm import queries as q

    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{path}'")
    df = q.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    result = con.execute(q.oracle_sql()[name])
    names = [x[0] for x in result.description]
    assert sorted(tuple(r[names.index(c)] for c in columns) for r in result.fetchall()) == sorted(map(tuple, df.select(*columns).collect()))


def test_common_grams_on_both_sides_of_a_line():
    wide = "".join(chr(0x4E00 + 7 * i) for i in range(90))
    mixed = "".join(chr(0x4E00 + 11 * i) for i in range(36)) + "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.-"[:63]
    for a, b in ((wide[:79], wide[:82]), (mixed[:99], mixed[:99] + "vwxyz"), ("词" * 34 + mixed[36:], mixed[36:] + "词" * 30)):
        sizes = set(neardup.gram_sizes(a)) & set(neardup.gram_sizes(b))
        assert sizes
    x, y = (neardup.fingerprints([t], [4])[0] for t in (wide[:79], wide[:82]))
    assert (x == y).sum() > 36


def test_crowded_entries_of_unlike_texts(spark, monkeypatch):
    rng = np.random.default_rng(8)
    text = lambda n: "".join(chr(int(c)) for c in rng.integers(0x4E00, 0x5E00, n))
    # a common head puts all into the same entries; of each thirty two are copies with an edit
    head = text(130)
    rows = [("chunks", i, head + text(300)) for i in range(300)]
    rows += [("chunks", 1000 + i, t[:200] + "改" + t[201:]) for _, i, t in rows[::30]]
    df = spark.createDataFrame(rows, "rec string, id long, text string")
    monkeypatch.setattr(neardup, "SMALL", 8)
    seen = []
    links = neardup._Judge.links
    monkeypatch.setattr(neardup._Judge, "links", lambda self, pairs: seen.append(pairs.count()) or links(self, pairs))
    got = {tuple(r)[1:] for r in neardup.duplicate_pairs(neardup.near_duplicates(df)).collect()}
    assert got == {(i, 1000 + i) for i in range(0, 300, 30)}
    assert sum(seen) < 300 * 300 / 4


def test_short_items_and_stock_over_all_blocks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    text = lambda n: "".join(chr(int(c)) for c in rng.integers(0x4E00, 0x5E00, n))
    short, stock = text(7), "请阅读下面的材料，然后回答问题。"
    items = [(i, stock + text(60)) for i in range(40)] + [(90, short), (91, "the quick brown fox"), (92, "yes")]
    docs = [(1, text(200) + short + text(200)), (2, "It was the QUICK, brown fox of old. " * 3), (3, stock + text(300)), (4, "yes yes"), (5, items[7][1])]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(1, 90), (2, 91), (5, 7)}
    assert {(r["doc_id"], r["item_id"]) for r in leaks.leaked_items(d, q).collect()} == want
    monkeypatch.setattr(leaks, "ITEM_BLOCK", 4)
    assert {(r["doc_id"], r["item_id"]) for r in leaks.leaked_items(d, q).collect()} == want


def test_shorter_matches_are_searched_where_seeds_come_close(spark):
    rng = np.random.default_rng(12)
    passage = [chr(int(c)) for c in rng.integers(0x4E00, 0x5E00, 90)]
    # nine of ten tokens are unchanged, but only the first third in runs of a seed's length
    edited = passage[:24] + [c if i % 7 else "改" for i, c in enumerate(passage[24:])]
    d = spark.createDataFrame([(1, "开头。" + "".join(edited) + "。结尾")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "".join(passage))], "item_id long, text string")
    row = leaks.leaked_items(d, q).first()
    assert row and row["share"] > 0.8


def test_tokens_are_those_of_the_whole_text():
    import importlib

    text = "abcdefghij " * 4000
    encoding = packing._encoding(packing.tokenizer_path(packing.TOKENIZER), importlib.import_module("public_tokenizers").PATTERN)
    assert packing.token_counts([text]) == [len(encoding.encode_ordinary(text))]


def test_garbled_pictures_and_further_scripts(spark):
    korean, russian = "안녕하세요 반갑습니다 오늘은", "вчера поезд опоздал на мосту"
    good = [ZH * 20, korean * 20, russian * 20, "コンピュータのキーボード" * 20]
    cases = ["好的" + "😀".encode().decode("cp1252", "replace"), "水😀泥".encode().decode("latin-1"), korean.encode("euc_kr").decode("latin-1"), russian.encode("cp1251").decode("latin-1")]
    rows = [("t", 100 + i, good[i % 4]) for i in range(80)] + [("t", i, c) for i, c in enumerate(cases)] + [("t", 50, "好的😀"), ("t", 51, "Ça été là, señor; Ärger über Öl")]
    got = {r["rec_id"]: r["restored"] for r in mojibake.repair(spark.createDataFrame(rows, "rec string, rec_id long, text string")).collect()}
    assert got == {0: "好的😀", 1: "水😀泥", 2: korean, 3: russian}


def _linked(texts, minimum=0.6):
    """Pairs within the components of a brute-force comparison of all texts."""
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            x, y = (a, b) if len(a) >= len(b) else (b, a)
            if neardup.shared_share(x, y) > minimum or len(x) == len(y) and neardup.shared_share(y, x) > minimum:
                root[find(i)] = find(j)
    return {(j, i) for i in range(len(texts)) for j in range(i) if find(i) == find(j)}


def test_scattered_edits_and_odd_lengths_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(21)
    letters, signs = "abcdefghijklmnopqrstuvwxyz ", [chr(int(c)) for c in rng.integers(0x4E00, 0x9E00, 3000)]
    edited = lambda t, every: "".join(c if (i + 1) % every else "#" for i, c in enumerate(t))
    texts = []
    for alphabet, n, every in ((letters, 400, 17), (signs, 350, 7), (signs, 350, 9), (letters, 70, 6), (signs, 40, 5), (letters, 90, 14)):
        for _ in range(4):
            t = "".join(rng.choice(list(alphabet), n))
            # a change in every few code points leaves no whole gram; then a part, and a short text repeated
            texts += [t, edited(t, every), t[: int(0.63 * n)], t[:4], t[:4] * 30]
    texts = list(dict.fromkeys(texts))
    want = _linked(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").selectExpr("'chunks' AS rec", "id", "text")
    for most in (neardup.LEAST_BLOCK, 1500):
        monkeypatch.setattr(neardup, "LEAST_BLOCK", most)
        got = {tuple(r)[1:] for r in neardup.duplicate_pairs(neardup.near_duplicates(df)).collect()}
        assert len(want) > 90 and want == got


def test_stock_wording_is_told_apart_without_whole_comparisons(monkeypatch):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n)) for n in rng.integers(3, 9, 400)]
    phrases = [" ".join(rng.choice(words, 4)) for _ in range(300)]
    texts = [" ".join(" ".join([*rng.choice(phrases, 1), *rng.choice(words, 2)]) for _ in range(10)) for _ in range(400)]
    # a change in every 17 letters, and a part
    texts += ["".join(c if (i + 1) % 17 else "#" for i, c in enumerate(texts[3])), texts[4][: int(0.7 * len(texts[4]))]]
    texts.sort(key=len)
    blocks = [recurring.Texts(np.arange(len(t)) + 1000 * k, t, np.full(len(t), 13), neardup.gram_hashes) for k, t in enumerate((texts[:201], texts[201:]))]
    counts = np.zeros(1 << recurring.SAMPLE_BITS, dtype=np.uint32)
    for block in blocks:
        recurring.count_windows(block, 13, counts)
    for block in blocks:
        block.probes, block.free, block.need = recurring.telling(block, {13: recurring.levels(counts)}, 0.6)
    compared, shares = [], recurring._shares
    monkeypatch.setattr(recurring, "_shares", lambda *x: compared.append(len(x[3])) or shares(*x))
    found = set()
    for longer, other in ((blocks[0], blocks[0]), (blocks[1], blocks[1]), (blocks[1], blocks[0]), (blocks[0], blocks[1])):
        recurring.pairs(longer, other, 0.6, found)
    name = lambda g: texts[g if g < 1000 else g - 1000 + 201]
    got = {tuple(sorted((name(x), name(y)))) for x, y in found}
    assert got == {tuple(sorted((a, b))) for i, b in enumerate(texts) for a in texts[:i] if neardup.shared_share(b, a) > 0.6 or len(a) == len(b) and neardup.shared_share(a, b) > 0.6}
    assert len(got) >= 2 and sum(compared) < 10
