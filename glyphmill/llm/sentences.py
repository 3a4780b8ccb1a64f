"""Problem 10: sentence boundaries across languages and scripts."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents that the classifier is fitted on, at most (chosen by a hash of the id), different feature rows, how often a
#: row counts at most, and the classifier's hashed features.
SAMPLE_DOCS, SAMPLE_ROWS, ROW_WEIGHT, FEATURES = 3000, 60_000, 20, 1 << 14

# Marks, brackets and words of the languages.
END_MARKS = "。！？!?．｡…."
OPEN = "「『“‘„《〈（([【〔«｢"
CLOSE = "」』”’“》〉）)]】〕»｣"
PAIRS = {
    "「": "」", "｢": "｣", "『": "』", "“": "”", "‘": "’", "„": "“”", "《": "》", "〈": "〉",
    "（": "）)", "(": ")）", "[": "]", "【": "】", "〔": "〕", "«": "»", '"': '"',
}
QUOTES = "「｢『“‘„«\""
TITLES = "《〈"
GO_ON = "，、；：,;:)）-–—·/"
BEFORE_NAMES = "st no nr mr mrs ms dr prof hr fr frl sr jr gen col capt lt sgt rev hon pres gov sen rep mt ft art fig bd abb kap str mio mrd tsd".split()
OTHER_SHORT = "etc e.g i.e viz cf vs approx ca bzw usw vgl evtl ggf inkl tel ed eds pp p s z.b d.h u.a o.ä v.chr inc ltd co corp dept est a.m p.m u.s".split()
BETWEEN = "vs cf e.g i.e viz approx ca bzw evtl incl inkl z.b d.h".split()
MONTHS = (
    "januar februar märz april mai juni juli august september oktober november dezember "
    "january february march may june july october december"
).split()
SAY = re.compile(r"[说說道喊问問答叫写寫嚷喃言嘟囔叹嘆念讲講谈談]")
ERROR_WORDS = (
    "request entity too large|bad gateway|gateway time-?out|service unavailable|too many requests|internal server error|"
    "not found|forbidden|unauthori[sz]ed|access denied|connection (?:reset|refused|timed out)|timed? ?out|upstream|no response from|"
    "bad request|method not allowed|payload too large|proxy error|temporarily unavailable|rate limit"
)

_ERROR = re.compile(
    rf"\s*(?:<(?:!doctype|html)\b|[\[{{]\s*\"?(?:error|code|message|status|detail)\b|(?:error\W*)?(?:\d{{3}}\W*)?(?:{ERROR_WORDS})\b)", re.I
)
_HTML_OR_JSON = re.compile(r"\s*(?:<(?:!doctype|html)\b|\{)", re.I)
_FRONT = re.compile(r"\ufeff*---[ \t]*\r?\n(?:.*\r?\n)*?---[ \t]*(?:\r?\n|\Z)")
_LINE = re.compile(r"[^\n]*\n?")
_HEADING = re.compile(r"[ \t]*#{1,6}[ \t]")
_LIST = re.compile(r"[ \t]*(?:[-*+•‣◦]|\(?\d{1,3}[.)、]|[（(]\d{1,3}[）)])[ \t]+(?=\S)")
_STAMP = re.compile(r"[ \t]*\[?\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?\]?")
_SCAN = re.compile(r"[「」『』“”‘’„《》〈〉（）()\[\]【】〔〕«»｢｣\"]|[。！？!?．｡….]+(?:[ \t]*[。！？!?．｡….]+(?![^\s。！？!?．｡….]))*|[ \t\u00a0\u3000]+(?=[\u0e00-\u0e7f])")
_STOP = re.compile(r"[。！？!?．｡…\n]")
_WORD_BEFORE = re.compile(r"[^\W_][\w.\-’']*$")
_CJK = re.compile(r"[ᄀ-ᇿ⺀-鿿가-\ud7af豈-\ufaffｦ-ﾟ\U00020000-\U0003ffff]")
_THAI = re.compile(r"[\u0e00-\u0e7f]")
_BLANKS = " \t\r\n\u00a0\u3000\ufeff\u2028\u2029\u200b\x0b\x0c\x85\u2002\u2003\u2009\u202f\u1680\u2000\u2001\u2004\u2005\u2006\u2007\u2008\u200a\u205f"


def is_error_text(body: str) -> bool:
    """Whether the whole text is an error page or an error message."""
    if _HTML_OR_JSON.match(body):
        tail = body.rstrip()[-1:]
        return bool(_ERROR.match(body)) and tail in ">}]" or body.lstrip()[:1] == "<"
    return len(body) < 400 and not _CJK.search(body) and bool(_ERROR.match(body))


def body_start(text: str) -> int:
    """Where the text begins after a byte order mark and front-matter."""
    front = _FRONT.match(text)
    return front.end() if front else len(text) - len(text.lstrip("\ufeff"))


def _pairs(s: str) -> list[tuple[int, int]]:
    """(open, close) of matched brackets and quotations of ``s``; unmatched ones do not count."""
    stack: list[tuple[str, int]] = []
    out = []
    for m in re.finditer(r"[「」『』“”‘’„《》〈〉（）()\[\]【】〔〕«»｢｣\"]", s):
        c, at = m[0], m.start()
        if c == "’" and at and s[at - 1].isalpha() and s[at + 1 : at + 2].isalpha() and not _CJK.match(s[at - 1]) and not _CJK.match(s[at + 1]):
            continue  # an apostrophe
        for k in range(len(stack) - 1, -1, -1):
            if c in PAIRS[stack[k][0]] and at > stack[k][1]:
                out.append((stack[k][1], at))
                del stack[k:]
                break
        else:
            if c in PAIRS:
                stack.append((c, at))
    return out


def _outer(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The outermost of nested pairs, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(pairs):
        if not out or a > out[-1][1]:
            out.append((a, b))
    return out


def _kind(c: str) -> str:
    """Class of the character after (or before) a candidate."""
    if not c:
        return "none"
    if c in END_MARKS:
        return "mark"
    if c in OPEN or c == '"':
        return "open"
    if c in CLOSE:
        return "close"
    if c in GO_ON:
        return "dash" if c in "-–—·/" else "comma"
    if c.isdigit():
        return "digit"
    if _CJK.match(c):
        return "cjk"
    if _THAI.match(c):
        return "thai"
    return "upper" if c.isupper() else "lower" if c.islower() else "other"


def period_features(s: str, at: int, end: int) -> tuple[str, ...]:
    """What a full stop at ``at`` stands between: tokens, case, length, digits and script."""
    before = _WORD_BEFORE.search(s[max(0, at - 24) : at])
    word = before[0] if before else ""
    after = re.match(r"[\s\"“”‘’„»«)\]」』]*([^\W_]+|\S?)", s[end : end + 40])
    nxt = after[1] if after else ""
    gap = "blank" if s[end : end + 1].isspace() else "none" if end < len(s) else "end"
    low = word.lower().rstrip(".")
    case = _kind(nxt[:1])
    case = case if case in ("cjk", "digit", "upper", "lower", "comma", "open") else "other"
    kind = "number" if word.isdigit() else "letter" if len(word) == 1 else "dotted" if "." in word else "upper" if word[:1].isupper() else "lower"
    if word and _CJK.match(word[-1]):
        kind = "cjk"
    return (
        f"w={low}", f"n={nxt.lower()[:12]}", f"k={kind}", f"l={min(len(word), 8)}", f"c={case}", f"g={gap}",
        f"kc={kind},{case},{gap}", f"t={low in BEFORE_NAMES},{case}", f"o={low in OTHER_SHORT},{low in BETWEEN},{case}",
        f"m={kind},{nxt.lower() in MONTHS}", f"lg={min(len(word), 5)},{case},{gap}",
    )


def period_label(s: str, at: int, end: int, features: tuple[str, ...]) -> int | None:
    """1 or 0 where what follows leaves no doubt about a full stop, else None."""
    f = dict(x.split("=", 1) for x in features)
    if f["g"] == "end":
        return 1
    if f["c"] == "cjk" and (f["k"] == "cjk" or f["g"] == "none"):
        return 1
    if f["g"] == "none" and f["c"] in ("digit", "lower", "upper"):
        return 0
    if f["c"] == "lower" or s[end : end + 1] in ",;:，、；：" or f["c"] == "digit" and f["k"] in ("letter", "dotted"):
        return 0
    if f["w"] in BEFORE_NAMES or f["w"] in BETWEEN or f["k"] == "letter" and f["c"] == "upper":
        return 0  # titles and initials stand before names, some short forms between words
    if f["k"] == "number" and f["n"] in MONTHS:
        return 0
    if f["k"] in ("lower", "cjk", "upper") and f["l"] >= "5" and f["c"] in ("upper", "cjk"):
        return 1
    if f["c"] == "open" and f["g"] == "blank" and f["k"] in ("lower", "cjk", "upper") and f["l"] >= "4" and s[end:].lstrip()[1:2].isupper():
        return 1
    if f["k"] in ("number", "dotted") and f["n"] in ("the", "der", "die", "das", "am", "a", "in"):
        return 1
    return None


def _shown(kind: str, **values: object) -> tuple[str, ...]:
    """What is seen of a candidate that is no single full stop: its kind, then name and value of all that counts."""
    return (f"{kind}:", *[f"{k}={v}" for k, v in values.items()])


def expanded(shown: tuple[str, ...]) -> list[str]:
    """Features of a candidate: each value; of what is no single full stop also every two of them, and all together."""
    if not shown[0].endswith(":"):
        return list(shown)
    one = [shown[0] + v for v in shown[1:]]
    return [shown[0], *one, *[f"{x}&{y}" for i, x in enumerate(one) for y in one[i + 1 :]], "&".join(one)]


def mark_features(s: str, at: int, end: int, marks: str) -> tuple[str, ...]:
    """A run of end marks that is not a single full stop: the marks, what stands on both sides, and the gap."""
    rest = s[end : end + 40].lstrip(_BLANKS)
    kind = "dots" if set(marks) <= set(".…") else "low" if set(marks) <= set("!?") else "wide" if set(marks) <= set("。！？．｡") else "mixed"
    return _shown(
        "mark", marks=kind, one=len(marks) == 1, last=marks[-1], before=_kind(s[at - 1 : at]), after=_kind(rest[:1]), blank=s[end : end + 1] in _BLANKS,
        tight=s[at - 1 : at].isdigit() and s[end : end + 1].isdigit(),
    )


def mark_label(s: str, at: int, end: int, marks: str) -> int | None:
    """As :func:`period_label`: marks go on where a comma, a lower-case word or a digit without blank follows."""
    after = _kind(s[end:].lstrip(_BLANKS)[:1])
    if set(marks) <= set(".…"):
        return int(after not in ("lower", "comma", "dash"))
    if marks == "．" and s[at - 1 : at].isdigit() and s[end : end + 1].isdigit():
        return 0
    return 0 if after == "comma" or after == "lower" and set(marks) <= set("!?") else 1


def quote_features(s: str, opened: int, at: int, end: int, first: int) -> tuple[str, ...]:
    """A closing bracket or quotation mark after an end mark: where it was opened, and how the text goes on."""
    rest = s[end : end + 60].lstrip(_BLANKS)
    kind = "title" if s[opened] in TITLES else "quote" if s[opened] in QUOTES else "bracket"
    stop = _STOP.search(rest)
    tail = rest[: stop.start() if stop else 41]
    say = SAY.search(tail) if len(tail) <= 40 else None
    after = "to" if rest[:1] == "と" else _kind(rest[:1])
    return _shown(
        "quote", opened=kind, at="start" if opened <= first else _kind(s[:opened].rstrip(_BLANKS)[-1:]), after=after, blank=s[end : end + 1] in _BLANKS,
        say="none" if not say else "near" if say.start() < 15 else "far", tail=min(len(tail) // 10, 4),
    )


def quote_label(s: str, opened: int, at: int, end: int, first: int) -> int | None:
    """As :func:`period_label`: a quotation ends a sentence unless a clause of saying, or more of the sentence, follows."""
    rest = s[end : end + 60].lstrip(_BLANKS)
    c, blank = rest[:1], s[end : end + 1] in _BLANKS
    after = _kind(c)
    if after in ("comma", "dash", "mark", "close", "lower") or s[opened] in TITLES:
        return 0
    if s[opened] not in QUOTES:
        return int(opened == first)
    if opened > first:
        return int(s[:opened].rstrip(_BLANKS)[-1:] in ("：", ":", "，", ","))
    if after == "open" or blank and after == "upper":
        return 1
    stop = _STOP.search(rest)
    tail = rest[: stop.start() if stop else 41]
    return int(not (c == "と" or len(tail) <= 40 and SAY.search(tail) or after == "thai"))


def blank_features(s: str, at: int, end: int) -> tuple[str, ...]:
    """A blank before a Thai letter: what stands on both sides and how far the next blank is."""
    nxt = re.match(r"[^\s]*", s[end : end + 40])[0]
    return _shown("blank", before="mark" if s[at - 1 : at] in END_MARKS else _kind(s[at - 1 : at]), length=min(len(nxt) // 6, 5), mark=nxt[-1:] in END_MARKS)


def blank_label(s: str, at: int, end: int) -> int | None:
    """As :func:`period_label`: in Thai a blank ends a sentence, after a mark that has done so it does not."""
    before = s[at - 1 : at]
    return int(before not in END_MARKS and bool(_THAI.match(before) or before.isdigit() or before in CLOSE))


def line_features(before: str, after: str, uniform: bool, marked: bool) -> tuple[str, ...]:
    """A line break within a block: scripts on both sides, case, the mark at the line's end, and the block's layout."""
    last, nxt = next((c for c in reversed(before) if c.isalnum()), " "), next((c for c in after if c.isalnum()), " ")
    return _shown("line", last=_script(last), next=_script(nxt), case=_kind(nxt), end=before[-1] in END_MARKS, uniform=uniform, marked=marked)


def line_label(before: str, after: str, uniform: bool, marked: bool) -> int | None:
    """As :func:`period_label`: wrapped lines go on, others end."""
    last, nxt = next((c for c in reversed(before) if c.isalnum()), " "), next((c for c in after if c.isalnum()), " ")
    letters = _script(last) == "letters" == _script(nxt)
    return int(not (letters and marked or uniform and before[-1] not in END_MARKS))


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) % FEATURES


class BoundaryModel:
    """Maximum-entropy classifier of candidate boundaries over hashed features."""

    def __init__(self) -> None:
        self.weights = np.zeros(FEATURES)
        self._known: dict[tuple[str, ...], bool] = {}

    def fit(self, rows: list[tuple[str, ...]], labels: list[int], counts: list[int] | None = None, rounds: int = 80) -> BoundaryModel:
        """Gradient ascent of the likelihood with a small Gaussian prior; rows count as often as ``counts`` says."""
        self._known = {}
        if not rows or len(set(labels)) < 2:
            return self
        features = [expanded(r) for r in rows]
        width = np.array([len(r) for r in features])
        slots, owner = np.array([_slot(x) for r in features for x in r]), np.repeat(np.arange(len(rows)), width)
        y, n = np.array(labels, dtype=np.float64), np.array(counts or [1] * len(rows), dtype=np.float64)
        # a step is divided by how many features share it
        seen = np.bincount(slots, weights=n[owner], minlength=FEATURES) + 20.0
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, weights=self.weights[slots], minlength=len(rows)), -30, 30)))
            gap = n * (y - p) * 11 / width
            grad = np.bincount(slots, weights=gap[owner], minlength=FEATURES)
            self.weights += 3.0 * (grad - 0.05 * self.weights) / seen
        return self

    def score(self, shown: tuple[str, ...]) -> float:
        """Log odds of a boundary."""
        return float(sum(self.weights[_slot(x)] for x in expanded(shown)))

    def ends(self, shown: tuple[str, ...]) -> bool:
        """Whether a candidate is a boundary; answers are kept, as most candidates are alike."""
        known = self._known.get(shown)
        if known is None:
            if len(self._known) > 200_000:
                self._known.clear()
            known = self._known[shown] = self.score(shown) > 0
        return known


class Teacher(BoundaryModel):
    """Collects the reliable candidates of texts instead of judging them."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[tuple[str, ...]] = []
        self.labels: list[int] = []

    def told(self, features: tuple[str, ...], label: int | None) -> bool:
        """Keep a candidate with its label, which is also the answer; without one nothing ends here."""
        if label is not None:
            self.rows.append(features)
            self.labels.append(label)
        return bool(label)


def training_rows(text: str) -> tuple[list[tuple[str, ...]], list[int]]:
    """Features and labels of the reliable candidates of one text."""
    teacher = Teacher()
    sentence_spans(text, teacher)
    return teacher.rows, teacher.labels


def _script(c: str) -> str:
    return "cjk" if _CJK.match(c) else "thai" if _THAI.match(c) else "letters"


def _judged(model: BoundaryModel, features: tuple[str, ...], label, *args) -> bool:
    """Whether a candidate ends a sentence; the teacher is told, any other model decides by the features alone."""
    return model.told(features, label(*args)) if isinstance(model, Teacher) else model.ends(features)


def _uniform(lines: list[str]) -> bool:
    """Whether ideographic lines were cut at one width, in the middle of sentences."""
    inner = [len(x) for x in lines[:-1]]
    ends = sum(x[-1:] in END_MARKS + CLOSE for x in lines[:-1])
    return len(inner) >= 3 and min(inner) >= max(inner) - 2 and 4 * ends < len(inner) and any(m in x for x in lines for m in "。！？")


def segments(text: str, start: int, model: BoundaryModel) -> list[tuple[int, int]]:
    """Spans that no sentence goes beyond: headings, list items, turns, and lines or wrapped paragraphs."""
    out: list[tuple[int, int]] = []
    block: list[tuple[int, int]] = []

    def flush() -> None:
        if not block:
            return
        lines = [text[a:b].strip(_BLANKS) for a, b in block]
        uniform = _uniform(lines)
        marked = any(c in line for line in lines for c in END_MARKS)
        first = 0
        for k in range(1, len(block) + 1):
            if k < len(block):
                where = (lines[k - 1], lines[k], uniform, marked)
                if not _judged(model, line_features(*where), line_label, *where):
                    continue
                joined = text[block[first][0] : block[k - 1][1]]
                opened = len(_pairs(joined + text[block[k][0] : block[k][1]])) > len(_pairs(joined)) + len(_pairs(text[block[k][0] : block[k][1]]))
                if opened and not _SPEAKER_START.match(lines[k]):
                    continue
            out.append((block[first][0], block[k - 1][1]))
            first = k
        block.clear()

    at = start
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end]
        if not line.strip(_BLANKS):
            flush()
        elif _HEADING.match(line):
            flush()
            out.append((at, end))
        elif _LIST.match(line):
            flush()
            out.append((at, end))
        else:
            if _SPEAKER_START.match(line):
                flush()
            block.append((at, end))
        at = end + 1
    flush()
    return out


_SPEAKER_START = re.compile(r"[ \t\ufeff]*(?:\[?\d{1,2}:\d{2}|[^\s。，！？!?,.:：「『“\"（(\[《]{1,8}[：:](?!//))")


def _prefix(s: str) -> int:
    """Length of a time stamp and a speaker's name at the start of ``s``."""
    stamp = _STAMP.match(s)
    at = stamp.end() if stamp else 0
    name = re.match(r"[ \t]*[^\s。，！？!?,.:：「『“\"（(\[《]{1,6}[：:](?!//)", s[at:])
    if name and (len(name[0].strip()) == 2 or not SAY.search(name[0].strip()[-2:-1])):
        at += name.end()
    while at < len(s) and s[at] in _BLANKS:
        at += 1
    return at


def split_segment(s: str, model: BoundaryModel) -> list[tuple[int, int]]:
    """(start, end) of the sentences of one segment."""
    cuts: list[int] = []
    outer = _outer(_pairs(s))
    close_at = {b: a for a, b in outer}
    pair, n = 0, len(s)
    first = _prefix(s)  # where the words of the current sentence begin

    def cut(end: int) -> None:
        nonlocal first
        cuts.append(end)
        first = end
        while first < n and s[first] in _BLANKS:
            first += 1

    for m in _SCAN.finditer(s):
        at, end, token = m.start(), m.end(), m[0]
        if cuts and at < cuts[-1]:
            continue
        while pair < len(outer) and outer[pair][1] < at:
            pair += 1
        if pair < len(outer) and outer[pair][0] < at < outer[pair][1]:
            continue
        if token[0] in _BLANKS:
            if at and _judged(model, blank_features(s, at, end), blank_label, s, at, end):
                cut(at)
            continue
        if token in "「」『』“”‘’„《》〈〉（）()[]【】〔〕«»｢｣\"":
            if at in close_at:
                inside = s[close_at[at] + 1 : at].rstrip(_BLANKS)
                where = (s, close_at[at], at, end, first)
                if inside and inside[-1] in END_MARKS and s[end:].strip(_BLANKS) and _judged(model, quote_features(*where), quote_label, *where):
                    cut(end)
            continue
        # a run of end marks
        while end < n and s[end] in CLOSE and s[end] not in "“" and not any(a == end for a, _ in outer):
            end += 1  # closing marks whose opening one is missing
        if not s[end : end + 200].strip(_BLANKS) and not s[end:].strip(_BLANKS):
            cut(end)
            continue
        marks = token.replace(" ", "").replace("\t", "")
        if marks == ".":
            features = period_features(s, at, end)
            ends = _judged(model, features, period_label, s, at, end, features)
        else:
            ends = _judged(model, mark_features(s, at, end, marks), mark_label, s, at, end, marks)
        if ends:
            cut(end)
    out, start = [], 0
    for end in [*cuts, n]:
        a, b = start, end
        while a < b and s[a] in _BLANKS:
            a += 1
        while b > a and s[b - 1] in _BLANKS:
            b -= 1
        if b > a:
            if any(ch.isalnum() for ch in s[a:b]) or not out:
                out.append((a, b))
            else:  # marks alone belong to the sentence before
                out[-1] = (out[-1][0], b)
        start = end
    return out


def sentence_spans(text: str | None, model: BoundaryModel) -> list[tuple[int, int]]:
    """(start, end) of every sentence of ``text``, in order; none for null, blank and error texts."""
    if not text:
        return []
    start = body_start(text)
    if is_error_text(text[start:]):
        return []
    out = []
    for a, b in segments(text, start, model):
        s = text[a:b]
        if _HEADING.match(s) or _LIST.match(s):
            left = len(s) - len(s.lstrip(_BLANKS))
            right = len(s.rstrip(_BLANKS))
            if right > left:
                out.append((a + left, a + right))
            continue
        out.extend((a + x, a + y) for x, y in split_segment(s, model))
    return out


def fit_model(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> BoundaryModel:
    """The classifier, fitted on the reliable candidates of at most SAMPLE_DOCS documents.

    The sample is the first by a hash of the id and bounded by that number; its size
    does not grow with the table. Equal feature rows are counted where they lie, and at
    most SAMPLE_ROWS different ones, the most frequent, come to the driver.
    """
    rows = documents.select(id_col, text_col).where(F.col(text_col).isNotNull())
    total = max(rows.count(), 1)
    share = min(1.0, 1.2 * SAMPLE_DOCS / total)
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit(3)), F.lit(1_000_000))
    # the ids are few; the texts are read where they lie
    few = rows.where(place < int(share * 1_000_000) + 1).select(id_col, place.alias("__place")).orderBy("__place", id_col).limit(SAMPLE_DOCS)
    texts = rows.join(F.broadcast(few.select(id_col).distinct()), id_col, "left_semi").select(id_col, text_col)

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [training_rows(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(["\x1f".join(f) for rows, _ in out for f in rows], pa.string()), pa.array([y for _, ys in out for y in ys], pa.int32())],
                ["f", "y"],
            )

    counted = texts.mapInArrow(label, "f string, y int").groupBy("f", "y").agg(F.count(F.lit(1)).alias("n"))
    found = counted.orderBy(F.desc("n"), "f", "y").limit(SAMPLE_ROWS).collect()
    return BoundaryModel().fit([tuple(r["f"].split("\x1f")) for r in found], [r["y"] for r in found], [min(r["n"], ROW_WEIGHT) for r in found])


def split_sentences(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_pos, end_pos), code points of the stored text, a row per sentence.

    Candidates are runs of end marks, closing quotations and brackets after an end mark,
    blanks before Thai letters and line breaks within a block; none lies within an open
    quotation or bracket. Each is classified by a maximum-entropy model over the tokens,
    case, lengths, digits and script around it, which is fitted on the candidates that
    their surroundings leave no doubt about. Null, blank and error texts have
    no sentence; repeated rows give the same rows once.
    """
    model = documents.sparkSession.sparkContext.broadcast(fit_model(documents, id_col, text_col))

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spans = batch.column(0), [sentence_spans(t, model.value) for t in batch.column(1).to_pylist()]
            n = np.fromiter(map(len, spans), dtype=np.int64, count=len(spans))
            flat = np.array([x for s in spans for x in s], dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(np.repeat(np.arange(len(spans)), n))), pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["doc_id", "start_pos", "end_pos"]
            )

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.where(F.col("text").isNotNull()).mapInArrow(split, "doc_id bigint, start_pos bigint, end_pos bigint")
