"""Personal data in whole texts: plain identifiers, and those under disguise with their source offsets.

Base: email, ip, card (Luhn) and phone, leftmost and non-overlapping per kind. Added: a chain of
transducers writes a normalised text and, for each written character, keeps the source span it
came from; the same detectors run on it and what they find is mapped back.

- Characters: look-alike letters, digits of any script, full-width forms, dashes and odd spaces
  become ASCII; invisible characters vanish.
- Spelled digits (en, fr, de, es; "double", "triple", "plus") in runs of three or more; shorter runs
  beside figures, where the identifier that they complete decides.
- at/dot disguises: bracketed at or dot, at/dot as words between labels (bare words only with a
  spelled dot and a known last label, a country's or a common one), spaces around them.
An added span always covers a disguise and never lies within a base span of its kind; where the
base sees a fragment of a disguised identifier, its span stays and the whole one is added.

Defined cases: a null text is the empty text and holds nothing; equal starts are ordered by kind
as listed; every row of a repeated id is reported; an empty table gives an empty result; long
texts and long runs of one character take linear time; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, prepare

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]
RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"

# The patterns of the base, written so that failing starts are not tried again and again.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGITS = str.maketrans("", "", " ().-+")


def emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    back = digits[::-1]
    return (sum(map(int, back[::2])) + sum(sum(divmod(2 * int(d), 10)) for d in back[1::2])) % 10 == 0


def ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield m.span()


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := m[0].translate(_NOT_DIGITS)) <= 19 and luhn(d):
            yield m.span()


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(m[0].translate(_NOT_DIGITS)) <= 15:
            yield m.span()


DETECTORS: tuple[Callable[[str], Iterator[Span]], ...] = (emails, ips, cards, phones)

# Letters of other scripts that look like ASCII ones.
_LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l", "ѵ": "v", "ԛ": "q", "ԝ": "w", "г": "r", "п": "n",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ɑ": "a", "ɡ": "g", "ı": "i", "ʟ": "L",
    "․": ".", "。": ".", "∙": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-", "﹣": "-", "﹫": "@", "﹢": "+", "✚": "+", "➕": "+",
}
_INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff"
_SPACES = "\u00a0\u2000-\u200a\u202f\u205f\u3000"
_ODD = re.compile(rf"[{_INVISIBLE}{_SPACES}{''.join(_LOOKALIKES)}\uff01-\uff5e\U0001d400-\U0001d7ff]|(?![0-9])\d")
_HIDDEN = re.compile(rf"[{_INVISIBLE}]")

# Words for digits, for the signs, and common last labels of mail domains.
_DIGITS = dict(zip("zero oh one two three four five six seven eight nine".split(), "00123456789"))
_DIGITS |= dict(zip("zéro un deux trois quatre cinq six sept huit neuf".split(), "0123456789"))
_DIGITS |= dict(zip("null eins zwei drei vier fünf sechs sieben acht neun".split(), "0123456789"))
_DIGITS |= dict(zip("cero uno dos tres cuatro cinco seis siete ocho nueve".split(), "0123456789"))
_TIMES = {"double": 2, "triple": 3}
_AT_WORDS, _DOT_WORDS = "at|arroba|arobase", "dot|punkt|punto|point"
_LAST = frozenset("com org net edu gov mil int info biz io co ai dev app me tv eu uk name pro online site shop store xyz club tech cloud email example test invalid local".split())
_LAST |= frozenset(  # of countries
    """ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz
    de dj dk dm do dz ec ee eg er es et fi fj fk fm fo fr ga gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it je jm jo jp
    ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz
    om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz
    ua ug us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw""".split()
)

_DIGIT_WORD = "|".join(sorted(_DIGITS, key=len, reverse=True))
_ELEMENT = rf"(?:(?:{'|'.join(_TIMES)})[\s,-]+)?(?:{_DIGIT_WORD})"
_SPELLED = re.compile(rf"\b(?:plus[\s,-]+)?{_ELEMENT}(?:[\s,.-]+(?:(?:{_DOT_WORDS})[\s,-]+)?{_ELEMENT})*\b")
_PART = re.compile(rf"plus|{_DOT_WORDS}|{'|'.join(_TIMES)}|{_DIGIT_WORD}")
_BRACKET_AT = rf"[ \t]*[\[({{<][ \t]*(?:{_AT_WORDS}|@)[ \t]*[\])}}>][ \t]*"
_BRACKET_DOT = rf"[ \t]*[\[({{<][ \t]*(?:{_DOT_WORDS}|\.)[ \t]*[\])}}>][ \t]*"
_DOT = rf"(?:{_BRACKET_DOT}|[ \t]+(?:{_DOT_WORDS})[ \t]+|[ \t]+\.[ \t]+|\.)"
_AT = re.compile(rf"{_BRACKET_AT}|[ \t]+(?:{_AT_WORDS})[ \t]+|[ \t]*@[ \t]*")
_AT_SURE = re.compile(rf"{_BRACKET_AT}|[ \t]*@[ \t]*")
_RIGHT = re.compile(rf"[a-z0-9-]+(?:{_DOT}[a-z0-9-]+)+")
_LEFT = re.compile(rf"(?:[a-z0-9_%+-]+(?:{_BRACKET_DOT}|[ \t]+(?:dot|punkt|punto)[ \t]+))*[a-z0-9._%+-]+\Z")
_ANY_DOT = re.compile(_DOT)
_DOT_WORD = re.compile(rf"[ \t](?:{_DOT_WORDS})[ \t]")
#: Figures right before or after a short spelled run.
_FIGURE_BEFORE, _FIGURE_AFTER = re.compile(rf"[0-9]([\s,-]+(?:{_DOT_WORDS})[\s,-]+|[\s,.-]{{1,3}})\Z"), re.compile(r"[\s,.-]{1,3}[0-9]")
#: Characters before an at sign within which its local part is looked for first, and those that a disguised dot takes.
_LOCAL_REACH, _DOT_REACH = 200, 20


def _plain(c: str) -> str:
    if c in _LOOKALIKES:
        return _LOOKALIKES[c]
    if c.isdecimal():
        return str(unicodedata.decimal(c))
    if _HIDDEN.match(c):
        return ""
    if c.isspace():
        return " "
    form = unicodedata.normalize("NFKC", c)
    return form if len(form) == 1 else c


Piece = tuple[int, int, str]


class Rewriter:
    """Applies pieces (start, end, output) to a text; maps places of the output back."""

    def __init__(self, text: str, pieces: list[Piece]) -> None:
        self.out_at, self.src, out, at, n = [], [], [], 0, 0
        for start, end, new in pieces:
            if start > at:
                self._add(n, at, start, True)
                out.append(text[at:start])
                n += start - at
            if new:
                self._add(n, start, end, False)
                out.append(new)
                n += len(new)
            at = end
        if at < len(text):
            self._add(n, at, len(text), True)
            out.append(text[at:])
        self.text = "".join(out)

    def _add(self, n: int, start: int, end: int, copied: bool) -> None:
        self.out_at.append(n)
        self.src.append((start, end, copied))

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """The source span of the output span, and whether it covers a piece that is not a copy or a gap."""
        a, b = bisect_right(self.out_at, start) - 1, bisect_right(self.out_at, end - 1) - 1
        s0, e0, copied = self.src[a]
        first = s0 + start - self.out_at[a] if copied else s0
        s1, e1, copied = self.src[b]
        last = s1 + end - self.out_at[b] if copied else e1
        return first, last, last - first != end - start or not all(c for _, _, c in self.src[a : b + 1])


def character_pieces(text: str) -> list[Piece]:
    return [(m.start(), m.end(), p) for m in _ODD.finditer(text) if (p := _plain(m[0])) != m[0]]


def digit_pieces(low: str) -> tuple[list[Piece], list[Piece]]:
    """Pieces of runs of three or more spelled digits, and of shorter runs beside figures."""
    pieces: tuple[list[Piece], list[Piece]] = [], []
    for run in _SPELLED.finditer(low):
        parts = [(run.start() + m.start(), run.start() + m.end(), m[0]) for m in _PART.finditer(run[0])]
        short, at, times = sum(w in _DIGITS for *_, w in parts) < 3, run.start(), 1
        if short:
            before = _FIGURE_BEFORE.search(low, max(0, at - _DOT_REACH), at)
            if not before and not _FIGURE_AFTER.match(low, run.end()):
                continue
            if before and before[1].strip(" \t\n,.-"):
                pieces[1].append((before.start(1), at, "."))
        to = pieces[short]
        for start, end, word in parts:
            if word in _TIMES:
                times = _TIMES[word]
                continue
            new = "+" if word == "plus" else _DIGITS[word] * times if word in _DIGITS else "."
            to.append((at, end, new) if times > 1 else (start, end, new))
            if start > at and times == 1:
                to.insert(-1, (at, start, ""))
            at, times = end, 1
    return pieces


def local_part(low: str, done: int, end: int) -> re.Match | None:
    """The local part that ends at ``end``: looked for further back while it fills what was looked at."""
    reach = _LOCAL_REACH
    while True:
        begin = max(done, end - reach)
        left = _LEFT.search(low[begin:end])
        if not left or begin == done or left.start() > _DOT_REACH:
            return left
        reach *= 2


def mail_pieces(low: str) -> list[Piece]:
    pieces: list[Piece] = []
    done = 0
    for m in (_AT if _DOT_WORD.search(low) or "[.]" in low or "(.)" in low or "dot" in low else _AT_SURE).finditer(low):
        if m.start() < done:
            continue
        right = _RIGHT.match(low, m.end())
        left = right and local_part(low, done, m.start())
        if not right or not left:
            continue
        from_ = m.start() - len(left[0])
        to, dots = right.end(), [d for d in _ANY_DOT.finditer(low, m.end(), right.end())]
        dots_left = [d for d in _ANY_DOT.finditer(low, from_, m.start()) if d[0] != "."]
        mark = m[0].strip(" \t")
        bare = lambda d: d[0] != "." and d[0].strip(" \t")[0] not in "[({<"
        while mark[0] not in "[({<" and dots and bare(dots[-1]) and low[dots[-1].end() : to] not in _LAST:
            to = dots.pop().start()  # a bare sign before what is no last label ends the address
        masked_dots = [d for d in dots if d[0] != "."]
        last = low[dots[-1].end() : to] if dots else ""
        if mark == "@" and not masked_dots and not dots_left and m[0] == "@":
            continue  # plain
        if mark == "@" and m[0] != "@" and not (m[0][0] in " \t" and m[0][-1] in " \t"):
            continue  # a space on one side alone is a mention or a list
        if mark[0] not in "[({<@" and not (masked_dots and last in _LAST):
            continue
        if not dots or mark == "@" and last not in _LAST and any(map(bare, masked_dots)):
            continue
        pieces += [(d.start(), d.end(), ".") for d in dots_left]
        if m[0] != "@":
            pieces.append((m.start(), m.end(), "@"))
        pieces += [(d.start(), d.end(), ".") for d in masked_dots]
        done = to
    return pieces


def find_base(text: str) -> list[list[Span]]:
    return [list(find(text)) for find in DETECTORS]


def find_disguised(text: str, base: list[list[Span]]) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of identifiers that only the normalised text shows."""
    odd = [] if text.isascii() or not _ODD.search(text) else character_pieces(text)
    first = Rewriter(text, odd) if odd else None
    plain = first.text if first else text
    low = plain.replace("İ", "I").lower()
    mails, (digits, short) = mail_pieces(low), digit_pieces(low)
    out = _mapped(text, first, plain, mails + digits, base) if odd or mails or digits else []
    if short:  # figures with a few spelled digits: only what neither the plain patterns nor longer runs have a part of
        known = [sorted([*spans, *((a, b) for a, b, k in out if k == kind)]) for kind, spans in enumerate(base)]
        out += [(a, b, k) for a, b, k in _mapped(text, first, plain, mails + digits + short, base) if not any(x < b and a < y for x, y in known[k])]
    return out


def _mapped(text: str, first: Rewriter | None, plain: str, pieces: list[Piece], base: list[list[Span]]) -> list[tuple[int, int, int]]:
    """What the detectors find in the rewritten text, under a disguise and not within a base span of its kind."""
    kept, at = [], 0
    for p in sorted(pieces):  # the two kinds rarely meet; the earlier piece wins
        if p[0] >= at:
            kept.append(p)
            at = p[1]
    second = Rewriter(plain, kept)
    out = []
    for kind, find in enumerate(DETECTORS):
        for a, b in find(second.text):
            a, b, changed = second.back(a, b)
            if first:
                a, b, hidden = first.back(a, b)
                changed = changed or hidden
            near = bisect_right(base[kind], (a, len(text))) - 1
            if changed and not (near >= 0 and base[kind][near][1] >= b):
                out.append((a, b, kind))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def inspect(text: str) -> tuple[list[int], str, str, int]:
    base = find_base(text)
    flat = [(a, b, k) for k, spans in enumerate(base) for a, b in spans]
    added = find_disguised(text, base)
    plain = joined(flat)
    return [len(s) for s in base], hashlib.sha256(plain.encode()).hexdigest(), joined(flat + added) if added else plain, len(added)


def find_private(docs: DataFrame) -> DataFrame:
    """A row a document: base counts and digest, all spans (code points, end exclusive), how many were added, and how many there are."""
    prepare(docs.sparkSession)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [inspect(t) for t in batch.column(1).to_pylist()]
            counts = {f"n_{kind}": pa.array([r[0][k] for r in rows], pa.int64()) for k, kind in enumerate(KINDS)}
            added, all_ = (pa.array([f(r) for r in rows], pa.int64()) for f in (lambda r: r[3], lambda r: sum(r[0]) + r[3]))
            digests, spans = (pa.array([r[k] for r in rows], pa.string()) for k in (1, 2))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), **counts, "base_sha256": digests, "spans": spans, "n_added": added, "n_spans": all_})

    return id_text(docs).mapInArrow(look, RESULT)
