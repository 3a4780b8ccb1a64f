"""Problem 3: texts decoded with a wrong encoding."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.arrays import code_points, slices
from glyphmill.llm.lookalikes import CYRILLIC

# Encodings a text may have been written in and wrongly read in. "western" is
# cp1252 with the control characters that Latin-1 has in its place.
SINGLE = ["western", "cp1251", "koi8-r", "cp437", "cp850", "cp866", "mac_roman", "cp1250", "iso8859-15", "cp874"]
DOUBLE = ["gb18030", "big5", "cp932", "euc_kr"]
PAIRS = [
    *[("utf-8", r) for r in SINGLE], *[("gbk", r) for r in SINGLE], *[("big5", r) for r in SINGLE[:2]],
    *[("utf-8", r) for r in DOUBLE], ("gbk", "big5"), ("gbk", "cp932"), ("gbk", "euc_kr"), ("big5", "gbk"), ("cp932", "gbk"), ("cp932", "big5"),
    ("cp932", "western"), ("euc_kr", "western"), ("cp1251", "western"), ("koi8-r", "western"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"),
]
#: Pairs that turn one character into one other.
ALIGNED = {("gbk", "big5"), ("big5", "gbk"), ("cp932", "gbk"), ("cp932", "big5"), ("gbk", "euc_kr"), ("cp1251", "western"), ("koi8-r", "western"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r")}

LOST = "\ufffd"
#: Least count per code point of the corpus for a character to be one that a text was written with; for letters of the
#: alphabets that look-alikes are taken from and that other texts are garbled into.
COMMON, COMMON_ALPHABET = 2e-6, 1e-4
#: Pictures, which may stand in any text, however rare.
PICTURES = ("\U0001f300", "\U0001faff")
#: Gain in log likelihood that a restored passage must bring, in all and per character.
GAIN_ALL, GAIN_EACH = 10.0, 2.5
_LOOK_ALIKE = set(CYRILLIC)
_UTF8 = r"(?:[\xc3-\xdf][\x80-\xbf]|[\xe2-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}|\xc2[\xa0-\xbf\x80-\x9f])"
_RUN_UTF8 = re.compile(f"{_UTF8}+")
_RUN_UTF8_BYTES = re.compile(rb"(?:[\xe2-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}|[\xc3-\xdf][\x80-\xbf](?=[\xe2-\xef][\x80-\xbf])){2,}")
_RUN_DOUBLE = {
    "gbk": re.compile(r"(?:[\xa1-\xf7][\xa1-\xfe]){2,}"),
    "big5": re.compile(r"(?:[\xa1-\xc6][\x40-\x7e\xa1-\xfe]){3,}"),
    "cp932": re.compile(r"(?:[\x81-\x9f\xe0-\xef][\x40-\x7e\x80-\xfc]){3,}"),
    "euc_kr": re.compile(r"(?:[\xb0-\xc8][\xa1-\xfe]){2,}(?: (?:[\xb0-\xc8][\xa1-\xfe]){2,})*"),
}
_RUN_GBK_BYTES = re.compile(rb"(?:[\xa1-\xf7][\xa1-\xfe]){3,}")


def _byte_of(encoding: str) -> dict[str, int]:
    """High byte of each character of a single-byte encoding."""
    name = "cp1252" if encoding == "western" else encoding
    out = {}
    for b in range(0x80, 0x100):
        c = bytes([b]).decode(name, "ignore")
        if c:
            out[c] = b
        if encoding == "western" and b < 0xA0:
            out.setdefault(chr(b), b)
    return out


def count_characters(texts: DataFrame) -> dict[str, int]:
    """How often each character occurs in all of ``texts`` (text): at most as many rows as there are code points."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x10000, dtype=np.int64)
        for batch in batches:
            own = [t for t in batch.column(0).to_pylist() if t]
            for a, b in slices(own):
                points, _ = code_points(own[a:b])
                total += np.bincount(points[points < 0x10000], minlength=0x10000)
                at, n = np.unique(points[points >= 0x10000], return_counts=True)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n)], ["c", "n"])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["c", "n"])

    found = texts.select("text").mapInArrow(count, "c int, n bigint").groupBy("c").agg(F.sum("n").alias("n"))
    return {chr(r["c"]): r["n"] for r in found.collect() if r["c"]}


class Garble:
    """Garbled sequences of the corpus's own characters for all encoding pairs, and their reversal."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.total = max(sum(counts.values()), 1)
        self.counts = counts
        least = max(2.0, COMMON * self.total)
        # what texts are written with: letters and the marks of the scripts that need another encoding
        self.good = {c for c, n in counts.items() if ord(c) > 0x7F and n >= least and self._writable(c, n / self.total)}
        self.good |= set("，。！？：；“”‘’、（）《》「」『』…—–„äöüßÄÖÜéèêëàâîïôùûçñáíóúãõåæøœÉÈÀÇÑÃÅØ")
        self.single = {e: _byte_of(e) for e in SINGLE}
        self.chars: dict[str, dict[str, bytes | None]] = {e: {} for e in DOUBLE + ["gbk"]}
        self.aligned = {p: self._aligned(*p) for p in PAIRS if p in ALIGNED}
        self._build()

    @staticmethod
    def _writable(c: str, share: float) -> bool:
        if "\u0370" <= c <= "\u052f":
            return share >= COMMON_ALPHABET and c.isalpha()
        if "぀" <= c <= "ヿ" or "一" <= c <= "鿿" or "、" <= c <= "〕" or "！" <= c <= "？" or c >= "\U00020000" or PICTURES[0] <= c <= PICTURES[1]:
            return True
        return c.isalpha() and (c < "ƀ" or "\u0e00" <= c <= "\u0e7f" or "가" <= c <= "힣")

    def logp(self, c: str) -> float:
        """Log frequency of a character in the corpus."""
        return math.log((self.counts.get(c, 0) + 0.5) / self.total)

    def _aligned(self, wrote: str, read: str) -> dict[str, str]:
        """Garbled character to the one it was, where both encodings take two bytes."""
        out = {}
        for c in self.good:
            try:
                seen = c.encode(wrote)
                seen = seen.decode("cp1252" if read == "western" else read) if len(seen) == 1 + (wrote not in SINGLE) else ""
            except UnicodeError:
                continue
            if len(seen) == 1 and seen != c and not (wrote in SINGLE and seen in _LOOK_ALIKE) and self.logp(c) - self.logp(seen) > 1:
                out[seen] = c
        return out

    def _build(self) -> None:
        """Bit-parallel automaton: bit p of place k of a character says that it may stand k-th in a sequence of pair p."""
        self.place = np.zeros((3, 0x10000), dtype=np.uint64)
        top = sorted(self.good, key=lambda c: -self.counts.get(c, 0))[:60]
        for p, (wrote, read) in enumerate(PAIRS):
            bit = np.uint64(1 << p)
            if (wrote, read) in self.aligned:
                own = [ord(c) for c in self.aligned[wrote, read]]
                self.place[:, own] |= bit
            elif read in self.single:
                table = {b: c for c, b in reversed(self.single[read].items())}
                both = {b: [c for c, x in self.single[read].items() if x == b] for b in table}
                pictures = map(chr, range(ord(PICTURES[0]), ord(PICTURES[1]) + 1)) if wrote == "utf-8" else ()
                for c in {*self.good, *pictures}:
                    try:
                        raw = c.encode(wrote)
                    except UnicodeError:
                        continue
                    if wrote != "utf-8":
                        raw = raw + raw[:1]
                    for k in range(3):
                        if k < len(raw) and raw[k] >= 0x80:
                            for seen in both.get(raw[k], []):
                                self.place[k, ord(seen)] |= bit
                            self.place[k, ord(LOST)] |= bit
                        elif k < len(raw) and wrote != "utf-8":
                            self.place[k, raw[k]] |= bit
                        elif k >= len(raw):
                            self.place[k] |= bit if wrote == "utf-8" else np.uint64(0)
            else:
                # sequences depend on the neighbour's bytes: each character beside the most frequent ones
                own = set()
                for c in self.good:
                    try:
                        raw = c.encode(wrote)
                        for d in top:
                            both_raw = raw + d.encode(wrote) + raw
                            own.update(both_raw.decode(read, "ignore"))
                    except UnicodeError:
                        continue
                rare = [ord(c) for c in own if 0x7F < ord(c) < 0x10000 and self.counts.get(c, 0) < 2e-4 * self.total]
                self.place[:, rare] |= bit
        self.lost = np.zeros(0x10000, dtype=bool)
        self.lost[ord(LOST)] = True

    def hits(self, texts: list[str]) -> dict[int, int]:
        """Texts with a sequence of some pair: index to the bits of the pairs (all bits for lost characters)."""
        points, starts = code_points(texts, "\x00\x00\x00")
        points = np.minimum(points, 0xFFFF)
        bits = self.place[0][points[:-2]] & self.place[1][points[1:-1]] & self.place[2][points[2:]]
        gone = np.flatnonzero(self.lost[points])
        at = np.flatnonzero(bits)
        out: dict[int, int] = {}
        for i, b in zip((np.searchsorted(starts, at, "right") - 1).tolist(), bits[at].tolist(), strict=True):
            out[i] = out.get(i, 0) | b
        for i in np.unique(np.searchsorted(starts, gone, "right") - 1).tolist():
            out[i] = 2**len(PAIRS) - 1
        return out

    def _bytes(self, text: str, read: str) -> tuple[bytes, list[int]]:
        """Bytes of a text in a double-byte encoding and the character each byte comes from."""
        memo, parts, owner = self.chars[read], [], []
        for i, c in enumerate(text):
            raw = memo.get(c)
            if raw is None:
                try:
                    raw = c.encode(read) if c != LOST else b"\x00"
                except UnicodeError:
                    raw = b"\x00"
                memo[c] = raw
            parts.append(raw)
            owner.extend([i] * len(raw))
        return b"".join(parts), owner

    def _accept(self, seen: str, restored: str, least: int) -> bool:
        high = [c for c in restored if ord(c) > 0x7F]
        if len(high) < least or sum(c in self.good or PICTURES[0] <= c <= PICTURES[1] for c in high) < 0.8 * len(high):
            return False
        gain = sum(map(self.logp, restored)) - sum(map(self.logp, seen))
        return gain > GAIN_ALL * (len(seen) > 3) and gain > GAIN_EACH * len(high)

    def spans(self, text: str, bits: int) -> list[tuple[int, int, str]]:
        """(start, end, restored) of the garbled passages of one text, by the pairs that hit it."""
        found: list[tuple[int, int, str]] = []
        for p, (wrote, read) in enumerate(PAIRS):
            if not bits >> p & 1:
                continue
            if (wrote, read) in self.aligned:
                found += self._aligned_spans(text, self.aligned[wrote, read])
            elif read in self.single:
                table = self.single[read]
                flat = "".join(chr(table.get(c, 0)) if ord(c) > 0x7F else c for c in text)
                if wrote == "utf-8":
                    for m in _RUN_UTF8.finditer(flat):
                        restored = m[0].encode("latin-1").decode("utf-8", "replace")
                        if any("\x7f" < c < "Ā" for c in restored) and _RUN_UTF8.search(restored):
                            again = "".join(chr(self.single["western"].get(c, 0)) if ord(c) > 0x7F else c for c in restored)
                            restored = _RUN_UTF8.sub(lambda x: x[0].encode("latin-1").decode("utf-8", "replace"), again)
                        if self._accept(text[m.start() : m.end()], restored, 1):
                            found.append((m.start(), m.end(), restored))
                else:
                    for m in _RUN_DOUBLE[wrote].finditer(flat):
                        restored = m[0].encode("latin-1").decode(wrote, "replace")
                        seen = text[m.start() : m.end()]
                        # words of look-alike letters read as text of another encoding by chance
                        if not set(seen) <= _LOOK_ALIKE and self._accept(seen, restored, 3):
                            found.append((m.start(), m.end(), restored))
            else:
                raw, owner = self._bytes(text, read)
                for m in (_RUN_UTF8_BYTES if wrote == "utf-8" else _RUN_GBK_BYTES).finditer(raw):
                    restored = m[0].decode(wrote, "replace")
                    a, b = owner[m.start()], owner[m.end() - 1] + 1
                    if self._accept(text[a:b], restored, 2):
                        found.append((a, b, restored))
        # of overlapping passages the longest counts
        kept: list[tuple[int, int, str]] = []
        for s in sorted(found, key=lambda x: (x[0] - x[1], x[0])):
            if all(s[1] <= k[0] or s[0] >= k[1] for k in kept):
                kept.append(s)
        return sorted(kept)

    def _aligned_spans(self, text: str, table: dict[str, str]) -> list[tuple[int, int, str]]:
        out, first, gain, best, end, n = [], None, 0.0, 0.0, 0, 0
        for i, c in enumerate(text + "\x00\x00"):
            r = table.get(c)
            step = self.logp(r) - self.logp(c) if r else -0.5 if "\x1f" < c < "\x7f" else -9.0
            if first is None and r:
                first, gain, best, end = i, 0.0, 0.0, i
            if first is None:
                continue
            gain += step
            if gain > best:
                best, end = gain, i + 1
            if gain < best - 9 or i == len(text):
                restored = "".join(table.get(x, x) for x in text[first:end])
                n = sum(x in table for x in text[first:end])
                if n >= 3 and best > GAIN_ALL and best > GAIN_EACH * n:
                    out.append((first, end, restored))
                first = None
        return out


def repair(records: DataFrame) -> DataFrame:
    """(rec, rec_id, restored, spans, lost) of the garbled rows of ``records`` (rec, rec_id, text).

    The corpus's own characters (counted over all rows) give, for every pair of a
    written and a read encoding, the sequences they turn into; a bit-parallel automaton
    finds them in all texts in one pass, and each match is widened to the passage that
    the reversal turns into characters of the corpus. Only matched passages are
    replaced; text around them stays. ``lost`` says that characters were replaced by
    U+FFFD, so that the original cannot be told there; such rows count as garbled.
    Null and empty texts are never garbled; rows repeated with the same text come once.
    """
    rows = records.select("rec", F.col("rec_id").cast("long").alias("rec_id"), "text").where(F.length("text") > 0)
    # sequences of at most 65 536 characters for each pair: a few MB, whatever the size of the table
    shared = records.sparkSession.sparkContext.broadcast(Garble(count_characters(rows)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        garble = shared.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            keep, restored, spans, lost = [], [], [], []
            for a, b in slices(texts):
                for i, bits in garble.hits(texts[a:b]).items():
                    text = texts[a + i]
                    found = garble.spans(text, bits)
                    gone = LOST in text
                    if not found and not gone:
                        continue
                    parts, at = [], 0
                    for x, y, r in found:
                        parts += [text[at:x], r]
                        at = y
                    keep.append(a + i)
                    restored.append("".join(parts) + text[at:])
                    spans.append(len(found))
                    lost.append(gone)
            chosen = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(chosen), batch.column(1).take(chosen), pa.array(restored, pa.string()), pa.array(spans, pa.int32()), pa.array(lost, pa.bool_())],
                ["rec", "rec_id", "restored", "spans", "lost"],
            )

    return rows.mapInArrow(run, "rec string, rec_id bigint, restored string, spans int, lost boolean")
