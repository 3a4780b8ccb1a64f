"""Verification of quotations against document texts."""

from __future__ import annotations

import difflib
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.operators.chunking import chunk_spans
from glyphmill.runtime import stage

# Statuses by severity, limits, and the marks around quotations.
SEVERITY = ["verbatim", "whitespace", "annotated", "loose", "modified", "other_doc", "not_in_body", "not_found", "error"]
GOOD = ("verbatim", "whitespace", "loose", "annotated")
#: Order of the search: the text of the document (of any where none is declared), what lies beside its text, other
#: documents, and only then what is merely similar.
RANK = {s: k for k, s in enumerate(["verbatim", "whitespace", "annotated", "loose", "not_in_body", "other_doc", "modified", "not_found"])}
MIN_CHARS, SEED, MODIFIED_RATIO, SUGGEST_RATIO, CONTEXT = 4, 8, 0.6, 0.3, 90
ELLIPSIS = r"…+|\.{3,}|【\s*…+\s*】|\[\s*…+\s*\]|<\s*…+\s*>"
EDGES = " \t\r\n　「」『』“”\"'‘’`（）()[]【】《》<>·*—"
ASIDE = r"[（(][^（()）]{1,40}[)）]"
EXTERNAL_ID = r"BV[0-9A-Za-z]{10}"
#: Quotes that one pass over the documents looks for; their seeds are broadcast, so this bounds the broadcast.
QUOTE_BLOCK = 10_000


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: its form without width, whether it is white space, and whether punctuation, separator or control."""
    fold = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    blank, mark = np.zeros(len(fold), dtype=bool), np.zeros(len(fold), dtype=bool)
    for c in range(len(fold)):
        if 0xD800 <= c < 0xE000:
            continue
        form = unicodedata.normalize("NFKC", chr(c))
        form = form if len(form) == 1 else chr(c)
        fold[c], blank[c], mark[c] = ord(form), form.isspace(), unicodedata.category(form)[0] in "PZC"
    return fold, blank, mark


@dataclass
class View:
    """A text without some of its characters, and the place of each one kept."""

    text: str
    places: np.ndarray

    @classmethod
    def of(cls, text: str, loose: bool) -> View:
        """Without white space; if ``loose``, also without punctuation, separators and controls."""
        fold, blank, mark = _tables()
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        places = np.flatnonzero(~(blank[points] | mark[points]) if loose else ~blank[points])
        return cls(fold[points[places]].tobytes().decode("utf-32-le", "surrogatepass"), places)


class Hay:
    """A text with its views, each made when first asked for."""

    def __init__(self, text: str) -> None:
        self.text, self._views = text, {}

    def view(self, loose: bool) -> View:
        """The tight or the loose view."""
        if loose not in self._views:
            self._views[loose] = View.of(self.text, loose)
        return self._views[loose]


def locate(quote: str, hay: Hay) -> tuple[str, int, int, int] | None:
    """(tier, start, end, occurrences) of ``quote``: exact, without white space, without punctuation."""
    at = hay.text.find(quote) if quote else -1
    if at >= 0:
        return "verbatim", at, at + len(quote), hay.text.count(quote)
    for tier, loose in (("whitespace", False), ("loose", True)):
        needle, view = View.of(quote, loose).text, hay.view(loose)
        at = view.text.find(needle) if len(needle) >= MIN_CHARS else -1
        if at >= 0:
            return tier, int(view.places[at]), int(view.places[at + len(needle) - 1]) + 1, view.text.count(needle)
    return None


def similarity(quote: str, hay: Hay, block: tuple[int, int] | None = None) -> tuple[float, int, int]:
    """(ratio, start, end) of the window around the longest common block with ``quote``, whose places may be given."""
    needle, view = View.of(quote, False).text, hay.view(False)
    if block is None:
        longest = difflib.SequenceMatcher(None, needle, view.text, autojunk=False).find_longest_match()
        if longest.size < 3:
            return 0.0, 0, 0
        block = longest.a, longest.b
    first = max(0, block[1] - block[0] - 12)
    window = view.text[first : first + len(needle) + 24]
    match = difflib.SequenceMatcher(None, window, needle, autojunk=False)
    blocks = [b for b in match.get_matching_blocks() if b.size >= 3]
    if not blocks:
        return 0.0, 0, 0
    a, b = first + blocks[0].a, first + blocks[-1].a + blocks[-1].size
    ratio = difflib.SequenceMatcher(None, view.text[a:b], needle, autojunk=False).ratio()
    return round(ratio, 3), int(view.places[a]), int(view.places[b - 1]) + 1


def differences(quote: str, actual: str, most: int = 6) -> tuple[list[str], list[str]]:
    """(extra, missing): what the quote has beyond the source and what it lacks, on texts without white space; punctuation does not count."""
    q, s = View.of(quote, False).text, View.of(actual, False).text
    extra, missing = [], []
    for op, a, b, c, d in difflib.SequenceMatcher(None, q, s, autojunk=False).get_opcodes():
        if op in ("replace", "delete") and View.of(q[a:b], True).text:
            extra.append(q[a:b])
        if op in ("replace", "insert") and View.of(s[c:d], True).text:
            missing.append(s[c:d])
    return extra[:most], missing[:most]


def in_chunk(quote: str, body: str) -> bool:
    """Whether one chunk of the body holds the quote, white space aside."""
    needle = View.of(quote, False).text
    return any(needle in View.of(c, False).text for c in chunk_spans(body, 350, 80, 20))


def judge(quote: str, body: Hay, raw: Hay | None, fuzzy: bool = True) -> tuple[str, int, int, float, int]:
    """(status, start, end, ratio, occurrences) of a quote within one document."""
    hit = locate(quote, body)
    if hit:
        return hit[0], hit[1], hit[2], 1.0, hit[3]
    plain = re.sub(ASIDE, "", quote)
    if plain != quote and (hit := locate(plain, body)):
        return "annotated", hit[1], hit[2], 1.0, hit[3]
    if raw and (hit := locate(quote, raw)):
        return "not_in_body", hit[1], hit[2], 1.0, hit[3]
    ratio, a, b = similarity(quote, body) if fuzzy else (0.0, 0, 0)
    return ("modified" if ratio >= MODIFIED_RATIO else "not_found"), a, b, ratio, 0


def literal_hits(quotes: DataFrame, docs: DataFrame, seed: int = 12) -> DataFrame:
    """(quote_id, doc_id) of the documents (doc_id, text) that hold a quotation (quote_id, quote) literally.

    Quotes are taken in blocks of QUOTE_BLOCK, each broadcast for one pass over the
    documents; a quote is looked for only where its first ``seed`` characters occur.
    Null and empty quotes hit nothing.
    """
    rows = quotes.select("quote_id", "quote").where(F.length("quote") > 0)
    blocks, found = max(1, -(-rows.count() // QUOTE_BLOCK)), None
    for k in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("quote_id"), F.lit(blocks)) == k).distinct().collect()
        shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in own])

        def look(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            by_seed: dict[int, dict[str, list]] = {}
            for q, quote in shared.value:
                by_seed.setdefault(min(seed, len(quote)), {}).setdefault(quote[:seed], []).append((q, quote))
            for batch in batches:
                out = []
                for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    for size, table in by_seed.items():
                        near = {text[i : i + size] for i in range(len(text) - size + 1)} & table.keys()
                        out += [(q, doc) for s in near for q, quote in table[s] if quote in text]
                yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in out], pa.int64()), pa.array([d for _, d in out], pa.int64())], ["quote_id", "doc_id"])

        texts = docs.select(F.col("doc_id").cast("long"), "text").where(F.col("text").isNotNull())
        hits = texts.mapInArrow(look, "quote_id long, doc_id long")
        found = hits if found is None else found.union(hits)
    return found.distinct()


def tidy(quote: Column) -> Column:
    """Without paired Markdown emphasis and without quotation marks, brackets and blanks at the ends."""
    plain = F.regexp_replace(quote, r"(\*\*|__|\*|`)(.+?)\1", "$2")
    return F.regexp_replace(plain, f"^[{re.escape(EDGES)}]+|[{re.escape(EDGES)}]+$", "")


def fragments(quotes: DataFrame) -> DataFrame:
    """(quote_id, part, quote, declared): quotes cut at ellipses; an ellipsis alone leaves the whole."""
    cut = F.filter(F.transform(F.split("quote", ELLIPSIS), lambda p: tidy(p)), lambda p: p != "")
    parts = F.when(F.size(cut) > 0, cut).otherwise(F.array(F.coalesce(tidy(F.col("quote")), F.lit(""))))
    return quotes.select("quote_id", F.posexplode(parts).alias("part", "quote"), "declared")


def _seeds(quote: str) -> set[str]:
    loose = View.of(quote, True).text
    size = min(SEED, len(loose))
    step = max(1, len(loose) // 4)
    return {loose[i : i + size] for i in range(0, max(1, len(loose) - size + 1), step)} if len(loose) >= MIN_CHARS else set()


class Nearness:
    """Bounds of the similarity of many quotes with a text, from their common trigrams and characters."""

    def __init__(self, quotes: list[str]) -> None:
        self.needles = [View.of(q, False).text for q in quotes]
        alphabet = sorted(set("".join(self.needles)))
        self.ids = np.zeros(sys.maxunicode + 1, dtype=np.int64)
        self.ids[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.base = len(alphabet) + 1
        self.member = np.zeros((len(quotes), self.base), dtype=bool)
        self.sizes = np.array([len(n) for n in self.needles], dtype=np.int64)
        self.counts = [Counter(n) for n in self.needles]
        rows: list[tuple[int, int, int]] = []
        for i, n in enumerate(self.needles):
            own = self.ids[[ord(c) for c in n]]
            self.member[i, own] = True
            rows += [(int(k), i, a) for a, k in enumerate(self._grams(own))]
        self.keys, self.quote, self.place = np.array(sorted(rows), dtype=np.int64).reshape(-1, 3).T.copy()

    def _grams(self, own: np.ndarray) -> np.ndarray:
        return (own[:-2] * self.base + own[1:-1]) * self.base + own[2:]

    def least(self, ratio: float) -> np.ndarray:
        """Equal characters that each quote needs for a rounded ratio: 2 m / (w + n) with w >= m."""
        exact = ratio - 0.0005
        return exact * self.sizes / (2 - exact) - 1e-9

    def near(self, text: str, least: np.ndarray) -> list[tuple[int, int, int]]:
        """(quote, place in it, place in the text) of the longest common blocks of those quotes that can have ``least`` equal characters.

        The blocks are difflib's: runs of trigrams on one diagonal, the earliest of the
        longest; shorter blocks than three have no similarity. The window around a block
        has at most as many equal characters as the quote and the window share.
        """
        own = self.ids[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        if len(own) < 3 or not len(self.keys):
            return []
        grams = self._grams(own)
        at = np.flatnonzero((own[:-2] > 0) & (own[1:-1] > 0) & (own[2:] > 0))
        low = np.searchsorted(self.keys, grams[at], "left")
        many = np.searchsorted(self.keys, grams[at], "right") - low
        if not many.sum():
            return []
        b = np.repeat(at, many)
        entry = np.repeat(low - np.cumsum(many) + many, many) + np.arange(len(b))
        q, a = self.quote[entry], self.place[entry]
        order = np.lexsort((b, b - a, q))
        q, a, b = q[order], a[order], b[order]
        new = np.r_[True, (q[1:] != q[:-1]) | ((b - a)[1:] != (b - a)[:-1]) | (b[1:] != b[:-1] + 1)]
        starts = np.flatnonzero(new)
        length = np.diff(np.r_[starts, len(q)])
        q, a, b = q[starts], a[starts], b[starts]
        order = np.lexsort((b, a, -length, q))
        q, a, b = q[order], a[order], b[order]
        one = np.r_[True, q[1:] != q[:-1]]
        q, a, b = q[one], a[one], b[one]
        first = np.maximum(0, b - a - 12)
        out = []
        # quotes of like length share a matrix of windows
        for part in (np.flatnonzero(self.sizes[q].astype(np.int64) >> 6 == g) for g in np.unique(self.sizes[q] >> 6)):
            places = first[part, None] + np.arange(int(self.sizes[q[part]].max()) + 24)
            inside = places < np.minimum(len(own), first[part] + self.sizes[q[part]] + 24)[:, None]
            shared = (self.member[q[part, None], own[np.minimum(places, len(own) - 1)]] & inside).sum(1)
            for k in part[shared >= least[q[part]]]:
                window, left, same = text[first[k] : first[k] + self.sizes[q[k]] + 24], self.counts[q[k]], 0
                for c, n in Counter(window).items():
                    same += min(n, left[c])
                if same >= least[q[k]]:
                    out.append((int(q[k]), int(a[k]), int(b[k])))
        return out


_FOUND = "quote_id long, part int, doc_id long, status string, severity int, start_pos int, end_pos int, ratio double, occurrences int, matched string, extra array<string>, missing array<string>, in_chunk boolean, context string, annotations array<string>"


def _batch(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) if out else [[]] * 15
    types = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_(), pa.string(), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in _FOUND.split(", ")])


def _best(found: DataFrame) -> DataFrame:
    return found.groupBy("quote_id", "part").agg(
        F.min_by(F.struct("doc_id", "status", "severity", "start_pos", "end_pos", "ratio", "occurrences", "matched", "extra", "missing", "in_chunk", "context", "annotations"), F.struct("severity", -F.col("ratio"), "doc_id")).alias("b")
    )


def _located(rows: DataFrame, blocks: int, docs: DataFrame) -> DataFrame:
    """The documents that hold a fragment, by locate()."""
    found = None
    for k in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("quote_id", "part"), F.lit(blocks)) == k).collect()
        shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in own])

        def look(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            quotes = shared.value
            by_seed: dict[int, dict[str, list[int]]] = {}
            declared: dict[int, list[int]] = {}
            anywhere = []
            for i, (_, _, quote, doc) in enumerate(quotes):
                own_seeds = _seeds(quote) | _seeds(re.sub(ASIDE, "", quote))
                for seed in own_seeds:
                    by_seed.setdefault(len(seed), {}).setdefault(seed, []).append(i)
                # quotes of little but punctuation have no seed
                if not own_seeds and len(View.of(quote, False).text) >= MIN_CHARS:
                    anywhere.append(i)
                if doc is not None:
                    declared.setdefault(doc, []).append(i)
            for batch in batches:
                out = []
                for doc, body, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    hay = Hay(body or "")
                    whole = Hay(raw) if raw else None
                    near = dict.fromkeys([*declared.get(doc, ()), *anywhere])
                    # a passage of the body may run across lines that only the whole text has
                    for loose in {h.view(True).text for h in (hay, whole) if h}:
                        for size, table in by_seed.items():
                            for s in {loose[at : at + size] for at in range(len(loose) - size + 1)} & table.keys():
                                near.update(dict.fromkeys(table[s]))
                    for i in near:
                        q, part, quote, own_doc = quotes[i]
                        status, a, b, ratio, times = judge(quote, hay, whole, False)
                        if status == "not_found" or own_doc is not None and own_doc != doc and status not in GOOD:
                            continue
                        source = whole if status == "not_in_body" else hay
                        stripped = status == "annotated"
                        asides = [] if status == "not_in_body" else [x for x in re.findall(ASIDE, quote) if stripped or x not in source.text[a:b]]
                        if asides and status in GOOD:
                            status = "annotated"
                        judged = status
                        if own_doc is not None and own_doc != doc:
                            status = "other_doc"
                        actual = source.text[a:b]
                        plain = re.sub(ASIDE, "", quote) if stripped else quote
                        extra, missing = ([], []) if judged == "verbatim" else differences(plain, actual)
                        context = source.text[max(0, a - CONTEXT) : b + CONTEXT]
                        out.append((q, part, doc, status, RANK[status], a, b, ratio, times, actual, extra, missing, in_chunk(plain, hay.text), context, asides))
                yield _batch(out)

        hits = docs.select(F.col("doc_id").cast("long"), "body", "body_raw").mapInArrow(look, _FOUND)
        found = hits if found is None else found.union(hits)
    return found


def _similar(rows: DataFrame, blocks: int, docs: DataFrame, floor: float) -> DataFrame | None:
    """The documents most like a fragment, from a ratio of ``floor``; a declared fragment is compared with its document only.

    A document is skipped only if it cannot reach ``floor``, or the ratio that the task
    has seen for the fragment.
    """
    found = None
    for k in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("quote_id", "part"), F.lit(blocks)) == k).collect()
        if not own:
            continue
        shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in own])

        def look(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            quotes = shared.value
            nearness = Nearness([r[2] for r in quotes])
            least = nearness.least(floor)
            seen = np.full(len(quotes), floor)
            for batch in batches:
                out = []
                for doc, body, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    hay = Hay(body or "")
                    whole = Hay(raw) if raw else None
                    for i, a, b in nearness.near(hay.view(False).text, least):
                        q, part, quote, own_doc = quotes[i]
                        if own_doc is not None and own_doc != doc:
                            continue
                        ratio, start, end = similarity(quote, hay, (a, b))
                        if ratio < seen[i] or whole and locate(quote, whole):
                            continue
                        if ratio > seen[i]:
                            seen[i] = ratio
                            least[i] = nearness.least(ratio)[i]
                        actual = hay.text[start:end]
                        status = "modified" if ratio >= MODIFIED_RATIO else "not_found"
                        context = hay.text[max(0, start - CONTEXT) : end + CONTEXT]
                        out.append((q, part, doc, status, RANK[status], start, end, ratio, 0, actual, *differences(quote, actual), in_chunk(actual, hay.text), context, []))
                yield _batch(out)

        hits = docs.select(F.col("doc_id").cast("long"), "body", "body_raw").mapInArrow(look, _FOUND)
        found = hits if found is None else found.union(hits)
    return found


def verify_fragments(parts: DataFrame, docs: DataFrame, fuzzy: bool = True) -> DataFrame:
    """The verdict on each fragment: its best document in the order of RANK, then ratio, then id.

    ``docs`` has doc_id, body and body_raw. One pass over the documents locates the
    quotes of a block, where a document holds a seed of the quote (eight characters,
    punctuation aside) or is the declared one; a second one compares the quotes that
    are located nowhere with all documents that can be as similar as SUGGEST_RATIO. Each verdict has the matched text, what the quote has beyond it (extra)
    and lacks (missing), and whether a chunk holds the quote; below MODIFIED_RATIO the
    matched text is the best suggestion. The best verdict is an aggregate, so nothing but verdicts is shuffled.
    """
    rows = parts.select("quote_id", "part", "quote", "declared")
    n = rows.count()
    blocks = max(1, -(-n // QUOTE_BLOCK))
    best = _best(_located(rows, blocks, docs))
    short = F.length(F.regexp_replace("quote", r"(?U)\s", "")) < MIN_CHARS
    if fuzzy:
        best = stage(best)
        found = _similar(rows.where(~short).join(best, ["quote_id", "part"], "left_anti"), blocks, docs, SUGGEST_RATIO)
        if found is not None:
            best = _best(best.select("quote_id", "part", "b.*").unionByName(found))
    full = rows.join(best, ["quote_id", "part"], "left").select("quote_id", "part", "quote", "declared", "b.*").drop("severity")
    status = F.when(short, "error").otherwise(F.coalesce("status", F.lit("not_found")))
    return full.withColumn("status", status)


def verify_quotes(quotes: DataFrame, docs: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(quote_id, status, ok, fragments, doc_id, matched, extra, missing, in_chunk, suggestion, ratio, occurrences, context, annotations): the worst fragment decides; ok if all are good."""
    judged = verify_fragments(fragments(quotes), docs, fuzzy)
    order = F.array(*[F.lit(s) for s in SEVERITY])
    judged = judged.withColumn("suggestion", F.when(F.col("status") == "not_found", F.col("matched")))
    judged = judged.withColumn("matched", F.when(F.col("status") != "not_found", F.col("matched")))
    judged = judged.withColumn("severity", F.array_position(order, F.col("status")) - 1)
    return judged.groupBy("quote_id").agg(
        F.max_by("status", F.struct("severity", "part")).alias("status"), F.every(F.col("status").isin(*GOOD)).alias("ok"),
        F.count(F.lit(1)).alias("fragments"), *[F.max_by(c, F.struct("severity", "part")).alias(c) for c in ("doc_id", "matched", "extra", "missing", "in_chunk", "suggestion", "ratio", "occurrences", "context", "annotations")],
    )


def summary(verdicts: DataFrame, most: int = 10) -> DataFrame:
    """One row of counts by kind of verdict, with the ids of the first ``most`` that failed."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    failed = verdicts.where(F.col("status").isin("not_in_body", "not_found", "error")).select("quote_id").orderBy("quote_id").limit(most)
    counts = verdicts.agg(
        F.count(F.lit(1)).alias("total"), n("verbatim").alias("verbatim"), n("whitespace", "annotated", "loose").alias("warn"),
        n("modified").alias("modified"), n("other_doc").alias("other_doc"), n("not_in_body", "not_found", "error").alias("failed"),
        F.coalesce(F.every("ok"), F.lit(True)).alias("ok"),
    )
    return counts.crossJoin(failed.agg(F.sort_array(F.collect_list("quote_id")).alias("failed_quotes")))


def extract_quotes(articles: DataFrame) -> DataFrame:
    """(article_id, line, quote, ext_id): quotations in block-quote lines of ``articles`` (article_id, text).

    Each gets the external id that was named last, at or before its line.
    """
    lines = articles.select("article_id", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("at", "text"))
    ids = F.regexp_extract_all("text", F.lit(f"({EXTERNAL_ID})"), 1)
    lines = lines.select("article_id", (F.col("at") + 1).alias("line"), "text", F.element_at(F.when(F.size(ids) > 0, ids), -1).alias("own"))
    before = Window.partitionBy("article_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("ext_id", F.last("own", ignorenulls=True).over(before))
    quoted = F.regexp_extract_all("text", F.lit("(「[^「」]*」|『[^『』]*』|“[^“”]*”)"), 1)
    rows = lines.where(F.ltrim("text").startswith(">")).select("article_id", "line", F.explode(F.transform(quoted, lambda q: tidy(q))).alias("quote"), "ext_id")
    return rows.where(F.length(F.regexp_replace("quote", r"(?U)\s", "")) >= MIN_CHARS)


def verify_articles(articles: DataFrame, docs: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Quotations of articles with their verdicts; a named external id is the declared document (``docs.ext_id``)."""
    found = extract_quotes(articles).withColumn("quote_id", F.xxhash64("article_id", "line", "quote"))
    named = docs.where(F.col("ext_id") != "").groupBy("ext_id").agg(F.min("doc_id").alias("declared"))
    quotes = found.join(named, "ext_id", "left").select("quote_id", "quote", "declared", "article_id", "line", "ext_id").dropDuplicates(["quote_id"])
    verdicts = verify_quotes(quotes.select("quote_id", "quote", "declared"), docs, fuzzy)
    return quotes.join(verdicts, "quote_id").select("article_id", "line", "quote", "ext_id", "status", "ok", "doc_id")
