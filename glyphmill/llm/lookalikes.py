"""Problem 4: one form for texts that look the same."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.arrays import code_points
from glyphmill.runtime import cut

# Letters of other alphabets and the Latin letters they are drawn like.
CYRILLIC = "аеорсухіјѕԁһԛԝүАВЕЅІЈКМНОРСТУХԌԚԜҮӀ"
CYRILLIC_AS = "aeopcyxijsdhqwyABESIJKMHOPCTYXGQWYI"
GREEK = "ονυρικαγΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
GREEK_AS = "ovupikayABEZHIKMNOPTYX"
LATIN = "ɑɡ"
LATIN_AS = "ag"
# Characters that show nothing, besides those of category Cf.
INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5᠋᠌᠍\u3164\ufe00\ufe01\ufe02\ufe03\ufe04\ufe05\ufe06\ufe07\ufe08\ufe09\ufe0a\ufe0b\ufe0c\ufe0d\ufe0e\ufe0f\uffa0"

#: Decompositions that change only the width, the type face, the code block or the line breaking of a character.
SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<compat>", "<noBreak>")
_EMOJI = "\U0001f000-\U0001faff☀-➿"
#: Characters that are their own form unless a table says otherwise.
PLAIN = r"[ -~\n¡-¬®-ſ、-・一-鿿！（），：；？–-‟…]"

_ODD = re.compile(PLAIN.replace("[", "[^", 1))


class Classes:
    """Union-find over strings; the class of a string holds all that look like it."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, s: str) -> str:
        """Root of the class of ``s``."""
        root = s
        while (up := self.parent.setdefault(root, root)) != root:
            root = up
        while self.parent[s] != root:
            self.parent[s], s = root, self.parent[s]
        return root

    def join(self, a: str, b: str) -> None:
        """Put two strings into one class."""
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def members(self) -> dict[str, list[str]]:
        """All classes by root."""
        out = defaultdict(list)
        for s in list(self.parent):
            out[self.find(s)].append(s)
        return out


def _same_look(c: str) -> str | None:
    """What ``c`` is drawn like by its Unicode decomposition."""
    kind, _, rest = unicodedata.decomposition(c).partition(" ")
    if kind not in SAME_LOOK or c == "…":
        return None
    plain = unicodedata.normalize("NFKC", c)
    if kind in ("<wide>", "<narrow>") and not any(unicodedata.category(x)[0] in "LNMZ" for x in plain):
        return None  # the width of a mark can be seen
    if plain.startswith(" ") and len(plain) > 1:
        return None  # a spacing accent is no blank
    return plain


@lru_cache(1)
def classes() -> Classes:
    """Transitive look-alike classes of strings and code points, made by rule from Unicode's tables."""
    found = Classes()
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        kind = unicodedata.category(c)
        if kind == "Zs":
            found.join(c, " ")
        elif kind == "Cf" or c in INVISIBLE:
            found.join(c, "")
        elif plain := _same_look(c):
            found.join(c, plain)
    for other, latin in ((CYRILLIC, CYRILLIC_AS), (GREEK, GREEK_AS), (LATIN, LATIN_AS)):
        for a, b in zip(other, latin, strict=True):
            found.join(a, b)
    for line in ("\r\n", "\r", "\x85", "\u2028", "\u2029"):
        found.join(line, "\n")
    found.join("\t", " ")
    return found


def _members() -> list[str]:
    return sorted({m for group in classes().members().values() for m in group if m})


def member_counts(texts: DataFrame, text_col: str) -> dict[str, int]:
    """How often each member of a class occurs in all texts; strings by their first two code points."""
    single = np.zeros(sys.maxunicode + 2, dtype=bool)
    double = {}
    for m in _members():
        if len(m) == 1:
            single[ord(m)] = True
        else:
            double[ord(m[0]) << 21 | ord(m[1])] = m
    codes = np.array(sorted(double), dtype=np.int64)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = defaultdict(int)
        for batch in batches:
            cps, _ = code_points([t for t in batch.column(0).to_pylist() if t])
            own, n = np.unique(cps[single[cps]], return_counts=True)
            for c, k in zip(own.tolist(), n.tolist(), strict=True):
                seen[chr(c)] += k
            pairs = cps[:-1].astype(np.int64) << 21 | cps[1:]
            at = np.searchsorted(codes, pairs)
            own, n = np.unique(pairs[codes[np.minimum(at, len(codes) - 1)] == pairs], return_counts=True)
            for c, k in zip(own.tolist(), n.tolist(), strict=True):
                seen[double[c]] += k
        if seen:
            yield pa.RecordBatch.from_pydict({"m": list(seen), "n": list(seen.values())})

    # at most one row per member of a class comes to the driver
    total = texts.select(text_col).mapInArrow(count, "m string, n bigint").groupBy("m").agg(F.sum("n").alias("n"))
    return {r["m"]: r["n"] for r in total.collect()}


def representatives(counts: dict[str, int]) -> dict[str, str]:
    """What each member is rewritten to: the most frequent of its class, then a plain, a short, the first one."""
    out = {}
    for group in classes().members().values():
        if "" in group:
            best = ""
        elif " " in group or "\n" in group:
            best = " " if " " in group else "\n"
        else:
            best = min(group, key=lambda m: (-counts.get(m, 0), bool(_ODD.search(m)), len(m), m))
        # strings that occur nowhere need no rewriting
        out.update((m, best) for m in group if m != best and (len(m) == 1 or m == "\r\n" or counts.get(m, 0)))
    return out


class _Mapping(dict):
    """Code point to its replacement; others are entered as themselves when first met, as misses are slow."""

    def __missing__(self, key: int) -> int:
        self[key] = key
        return key


def rewriter(table: dict[str, str]):
    """Function that gives the forms of texts: every member replaced in one pass, longest match first.

    Texts of characters that no member and no accent is made of are their own form; they
    are told by a table over code points, for all texts at once.
    """
    single = _Mapping((ord(m), r) for m, r in table.items() if len(m) == 1)
    longer = sorted((m for m in table if len(m) > 1 and m != "\r\n"), key=len, reverse=True)
    strings = re.compile("|".join(map(re.escape, longer))) if longer else None
    # between two pictures the joiner makes them one
    joined = re.compile(f"(?<=[{_EMOJI}\ufe0f])\u200d(?=[{_EMOJI}])")
    odd = np.ones(sys.maxunicode + 1, dtype=bool)
    for c in map(chr, range(0x10000)):
        if not _ODD.match(c):
            odd[ord(c)] = False
    odd[[ord(m[0]) for m in table if m]] = True
    for c in np.flatnonzero(~odd).tolist():
        # an accented letter is odd where its letter is
        odd[c] = any(odd[ord(x)] for x in unicodedata.normalize("NFD", chr(c))[:1])

    def once(text: str) -> str:
        text = text.replace("\r\n", "\n")
        if strings:
            text = strings.sub(lambda m: table[m[0]], text)
        if "\u200d" in text and joined.search(text):
            return "\u200d".join(part.translate(single) for part in joined.split(text))
        return text.translate(single)

    def form(text: str) -> str:
        out = unicodedata.normalize("NFC", once(unicodedata.normalize("NFD", text)))
        # a character that only now has its accent may be a member itself
        return once(out) if strings else out

    def forms(texts: list[str | None]) -> list[str | None]:
        points, starts = code_points([t or "" for t in texts])
        points = points.copy()
        points[starts[1:] - 1] = ord("a")  # the gaps between texts
        out = list(texts)
        for i in np.unique(np.searchsorted(starts, np.flatnonzero(odd[points]), "right") - 1).tolist():
            out[i] = form(texts[i])
        return out

    return forms


def one_form(text: Column, table: dict[str, str]) -> Column:
    """``text`` with look-alikes replaced by their representatives; null for null."""

    @F.pandas_udf("string")
    def rewrite(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        change = rewriter(dict(table))
        for s in texts:
            yield pd.Series(change([None if t is None else t for t in s]), index=s.index, dtype=object)

    return rewrite(text)


def with_form(texts: DataFrame, text_col: str = "text", out: str = "form") -> DataFrame:
    """``texts`` with its one form in ``out``: equal for all texts that read the same.

    Not visible are: the width of letters and digits, the kind of blank, characters
    without a glyph, the way an accent or a line end is stored, and the alphabet that
    a look-alike letter is taken from. Marks keep their width, as that can be seen.
    '' stays '', null stays null.
    """
    table = representatives(member_counts(texts, text_col))
    return texts.withColumn(out, one_form(F.col(text_col), table))


def same_look_pairs(texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id_a, id_b), id_a < id_b: different ids whose texts look the same but are not equal.

    Forms and texts are compared by 128-bit hashes. Only forms with more than one
    spelling are joined (found with a map-side aggregate, so that many copies of one
    text cost one row per task); skewed forms are split by adaptive execution.
    Null texts are in no pair. A repeated row counts once.
    """
    slim = with_form(texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()))
    slim = slim.select(
        "id",
        F.xxhash64("form").alias("f1"), F.xxhash64(F.lit(1), "form").alias("f2"),
        F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"),
    )
    slim = cut(slim)
    spellings = slim.groupBy("f1", "f2").agg(
        F.min(F.struct("t1", "t2")).alias("low"), F.max(F.struct("t1", "t2")).alias("high")
    )
    several = spellings.where(F.col("low") != F.col("high")).select("f1", "f2")
    rows = cut(slim.join(several, ["f1", "f2"], "left_semi").distinct())
    a = rows.select("f1", "f2", F.col("id").alias("id_a"), F.struct("t1", "t2").alias("ta"))
    b = rows.select("f1", "f2", F.col("id").alias("id_b"), F.struct("t1", "t2").alias("tb"))
    pairs = a.join(b, ["f1", "f2"]).where((F.col("id_a") < F.col("id_b")) & (F.col("ta") != F.col("tb")))
    return pairs.select("id_a", "id_b").distinct()
