"""Problem 9: evaluation texts that leaked into training texts."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.arrays import code_points, slices

#: Tokens of a seed: code points of ideographic text, and of other text.
SEED_WIDE, SEED_LETTERS = 8, 20
#: Shortest tile.
TILE_WIDE, TILE_LETTERS = 5, 12
#: Part of the needed share that seeds must give for a search with shorter matches.
CLOSE = 0.6
#: Items that are compared in one pass; their texts are broadcast, so this bounds the broadcast.
ITEM_BLOCK = 5_000
#: Largest gap between two tiles of one passage: so many times the item's length and so many tokens more.
GAP_TIMES, GAP_MORE = 1.5, 150
#: Share of the items that begin with the same sentence from which it is a stock instruction, and least number.
STOCK_SHARE, STOCK_ITEMS = 0.02, 3
_END = np.uint32(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FIRST_SENTENCE = r"[^。．.!！?？\n]{4,80}[。．.!！?？:：\n]"
_BLANKS = " \t\r\n\x0b\x0c\u3000\u00a0\ufeff"


@lru_cache(1)
def token_table() -> np.ndarray:
    """The token of each code point: a letter or digit without width and case, 0 for all that is no token."""
    table = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        s = chr(c)
        if not 0xD800 <= c < 0xE000 and unicodedata.category(s)[0] in "LNS":
            plain = unicodedata.normalize("NFKC", s).casefold()[:1]
            if plain.isalnum():
                table[c] = ord(unicodedata.normalize("NFD", plain)[0]) if plain < "ɐ" else ord(plain)
    return table


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of all texts with an end mark after each, start of each text)."""
    points, starts = code_points(texts)
    mapped = token_table()[points]
    mapped[starts[1:] - 1] = _END
    kept = mapped != 0
    place = np.zeros(len(kept) + 1, dtype=np.int64)
    np.cumsum(kept, out=place[1:])
    return mapped[kept], place[starts]


def rolling(seq: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of every window of ``size`` tokens, by doubling."""
    n = len(seq) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    power, length = seq.astype(np.uint64) + np.uint64(1), 1
    out, done = None, 0
    shift = int(_BASE)
    left = size
    while left:
        if left & 1:
            piece = power[done : done + n] if len(power) >= done + n else power[done:]
            factor = pow(int(_BASE), length, 2**64)
            out = piece.copy() if out is None else out[: len(piece)] * np.uint64(factor) + piece
            done += length
        left >>= 1
        if left:
            power = power[:-length] * np.uint64(shift) + power[length:]
            length *= 2
            shift = shift * shift % 2**64
    out ^= out >> np.uint64(31)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def stock_sentences(items: DataFrame) -> set[str]:
    """First sentences that many of all ``items`` (text) begin with and that are not the whole of each: instructions.

    At most 1 / STOCK_SHARE sentences come to the driver.
    """
    text = F.regexp_replace("text", r"^[\s\u3000\u00a0\ufeff]+", "")
    firsts = items.select(text.alias("text"), F.regexp_extract(text, f"^({_FIRST_SENTENCE})", 1).alias("first"))
    counted = firsts.groupBy("first").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("text") > F.length("first")).alias("goes_on"))
    least = max(STOCK_ITEMS, STOCK_SHARE * items.count())
    return {r["first"] for r in counted.where((F.col("first") != "") & (F.col("n") >= least) & F.col("goes_on")).collect()}


def without_stock(text: str, stock: set[str]) -> str:
    """``text`` without the instruction it begins with."""
    first = re.match(_FIRST_SENTENCE, bare := text.lstrip(_BLANKS))
    return bare[first.end() :] if first and first[0] in stock else text


class Items:
    """Seeds of one block of evaluation items."""

    def __init__(self, ids: list[int], texts: list[str], stock: set[str]) -> None:
        self.ids = ids
        seq, starts = tokens([without_stock(t, stock) for t in texts])
        self.parts = [seq[a : b - 1] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        self.wide = [bool((p >= 0x2E80).mean() > 0.3) if len(p) else True for p in self.parts]
        groups: dict[tuple[bool, int], list[int]] = {}
        for i, p in enumerate(self.parts):
            size, least = (SEED_WIDE, TILE_WIDE) if self.wide[i] else (SEED_LETTERS, TILE_LETTERS)
            # a shorter item is its own seed; below a tile's length it is everyday wording
            if len(p) >= least:
                groups.setdefault((self.wide[i], min(size, len(p))), []).append(i)
        self.tables = {}
        for (wide, size), own in groups.items():
            hashes = [rolling(self.parts[i], size) for i in own]
            k, w = np.concatenate(hashes), np.repeat(own, [len(h) for h in hashes])
            a = np.concatenate([np.arange(len(h)) for h in hashes])
            order = np.argsort(k, kind="stable")
            k, w, a = k[order], w[order], a[order]
            gate = np.zeros(1 << 22, dtype=bool)
            gate[(k & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
            self.tables[wide, size] = (k, w, a, gate)

    def seeds(self, seq: np.ndarray) -> Iterator[tuple[bool, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(wide, size, places in seq, items, places in item) of all shared seeds."""
        for (wide, size), (k, w, a, gate) in self.tables.items():
            h = rolling(seq, size)
            some = np.flatnonzero(gate[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
            low = np.searchsorted(k, h[some], "left")
            n = np.searchsorted(k, h[some], "right") - low
            some, low, n = some[n > 0], low[n > 0], n[n > 0]
            idx = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            yield wide, size, np.repeat(some, n), w[idx], a[idx]


def shared_windows(text: np.ndarray, item: np.ndarray, size: int) -> list[tuple[int, int]]:
    """(place in text, place in item) of all windows of ``size`` tokens that both have, by Karp-Rabin hashes."""
    own = rolling(item, size)
    order = np.argsort(own, kind="stable")
    h = rolling(text, size)
    low = np.searchsorted(own[order], h, "left")
    n = np.searchsorted(own[order], h, "right") - low
    some = np.flatnonzero(n)
    idx = np.repeat(low[some] - np.cumsum(n[some]) + n[some], n[some]) + np.arange(n.sum())
    return list(zip(np.repeat(some, n[some]).tolist(), order[idx].tolist(), strict=True))


def tiles(seeds: list[tuple[int, int]], size: int, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in text, place in item, length), non-overlapping in both, longest first.

    Seeds on one diagonal that touch are one match. The longest match is marked,
    what it leaves of the others is a match again, until none of ``least`` is left.
    """
    runs, last = [], {}
    for d, i in sorted(seeds):
        key = d - i
        if key in last and last[key][0] + last[key][2] >= d:
            last[key][2] = d + size - last[key][0]
        else:
            last[key] = [d, i, size]
            runs.append(last[key])
    open_, marked = [tuple(r) for r in runs], []
    while open_:
        best = max(open_, key=lambda r: (r[2], -r[0], -r[1]))
        marked.append(best)
        rest = []
        for d, i, n in open_:
            for a, b, axis in ((best[0], best[0] + best[2], 0), (best[1], best[1] + best[2], 1)):
                s = (d, i)[axis]
                if s < b and a < s + n:
                    before, after = a - s, s + n - b
                    if before >= after:
                        n = max(before, 0)
                    else:
                        d, i, n = d + b - s, i + b - s, max(after, 0)
            if n >= least:
                rest.append((d, i, n))
        open_ = rest
    return marked


def ordered_cover(marked: list[tuple[int, int, int]], gap: float) -> tuple[int, int, int]:
    """(tokens, first, end) of the heaviest chain of tiles in the order of both texts without a larger gap."""
    marked = sorted(marked)
    best: list[tuple[int, int]] = []
    for k, (d, i, n) in enumerate(marked):
        own = (n, d)
        for j in range(k):
            e, f, m = marked[j]
            if f + m <= i and e + m <= d and d - e - m <= gap and best[j][0] + n > own[0]:
                own = (best[j][0] + n, best[j][1])
        best.append(own)
    if not best:
        return 0, 0, 0
    k = max(range(len(best)), key=lambda x: best[x][0])
    return best[k][0], best[k][1], marked[k][0] + marked[k][2]


def _search(items: Items, share: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: dict[str, list] = {"doc_id": [], "item_id": [], "share": [], "tiles": []}
            for first, last in slices(texts):
                seq, starts = tokens(texts[first:last])
                for wide, size, place, item, at in items.seeds(seq):
                    if not len(place):
                        continue
                    doc = np.searchsorted(starts, place, "right") - 1
                    pair = doc * len(items.ids) + item
                    # seeds of all texts that can reach the share at all: each adds at most its own length
                    order = np.lexsort((at, place, pair))
                    pair, place, at = pair[order], place[order], at[order]
                    edges = np.flatnonzero(np.diff(pair, prepend=-1, append=-1))
                    for a, b in zip(edges[:-1], edges[1:], strict=True):
                        who = int(pair[a]) % len(items.ids)
                        length = len(items.parts[who])
                        if (b - a) * size < CLOSE * share * length:
                            continue
                        least, gap = TILE_WIDE if wide else TILE_LETTERS, GAP_TIMES * length + GAP_MORE
                        found = tiles(list(zip(place[a:b].tolist(), at[a:b].tolist(), strict=True)), size, least)
                        cover, first_at, end_at = ordered_cover(found, gap)
                        if CLOSE * share * length <= cover < share * length:
                            # the next search length: all matches of a tile's length around what was found
                            which = int(pair[a]) // len(items.ids)
                            low, high = max(int(starts[which]), int(first_at - gap)), min(int(starts[which + 1]) - 1, int(end_at + gap))
                            found = tiles(shared_windows(seq[low:high], items.parts[who], least), least, least)
                            cover = max(cover, ordered_cover(found, gap)[0])
                        if cover >= share * length:
                            out["doc_id"].append(ids[first + int(pair[a]) // len(items.ids)])
                            out["item_id"].append(items.ids[who])
                            out["share"].append(cover / length)
                            out["tiles"].append(len(found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["doc_id"], pa.int64()), pa.array(out["item_id"], pa.int64()), pa.array(out["share"], pa.float64()), pa.array(out["tiles"], pa.int32())],
                ["doc_id", "item_id", "share", "tiles"],
            )

    return run


def leaked_items(documents: DataFrame, items: DataFrame, share: float = 1 / 3) -> DataFrame:
    """(doc_id, item_id, share, tiles): documents in which ``share`` of an item's text or more recurs.

    Compared are letters and digits without width, case and accent, so that changes of
    punctuation and spacing do not count. Seeds shared by item and text (Karp-Rabin) are
    joined by hash, matches are marked longest first without overlap, where they come close
    to the share also those of a tile's length around them, and the heaviest chain of tiles in order and close together is measured against the item's length.
    An instruction that many items begin with is not counted; of an item shorter than a
    seed the whole is the seed, and one shorter than the shortest tile is everyday wording
    and never found. Whole texts are compared.

    Items come to the driver in blocks of ITEM_BLOCK, each broadcast for one pass over
    the documents. Null texts of either side match nothing, equal ids count once.
    """
    rows = items.select(F.col("item_id").cast("long"), "text").where(F.col("text").isNotNull())
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    stock = stock_sentences(rows)
    blocks = max(1, -(-rows.count() // ITEM_BLOCK))
    parts = None
    for b in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else rows
        table = own.distinct().orderBy("item_id", "text").collect()
        block = Items([r["item_id"] for r in table], [r["text"] for r in table], stock)
        shared = documents.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            return _search(shared.value, share)(batches)

        found = texts.mapInArrow(run, "doc_id bigint, item_id bigint, share double, tiles int")
        parts = found if parts is None else parts.union(found)
    return parts.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"), F.max("tiles").alias("tiles"))
