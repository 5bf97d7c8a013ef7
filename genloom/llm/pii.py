"""Personal data by offset-preserving deobfuscation.

Base patterns find e-mail addresses, IPv4 addresses, payment cards and phone numbers in a text as it is. Beyond them three
transducers rewrite disguises: homoglyphs (look-alike letters, digits of other scripts and widths, invisible characters),
spelled digits ("five five five", "double two"), and at/dot disguises ("[at]", "(dot)", " at ... dot "). Each maps a text
to a text along with, for every output character, the source span it came from; their composition keeps source offsets.
The base patterns run on what they give, and each hit maps back to the source characters it came from. Hits inside what the
base patterns have found already add nothing; base spans are never changed.

The transducers run over whole texts. A batch is first searched, by Arrow's regular expressions, for patterns that hold in
every text which a transducer would rewrite (may_be_rewritten), so clean texts cost one cheap scan and nothing is skipped.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genloom.llm import textkernel as tk
from genloom.llm.spans import digest, joined
from genloom.runtime import table

KINDS = ["email", "ip", "card", "phone"]
#: The base patterns, in forms whose scan is linear in the text: possessive, and begun at a run's start where a later start
#: could match no better. An address is found from its at sign, see emails().
LOCAL, DOMAIN = re.compile(r"[A-Za-z0-9._%+-]*+"), re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

#: Look-alike letters outside compatibility forms: Cyrillic and Greek, with the Latin letters they pass for.
LOOKALIKE = dict(zip("аеорсухіјѕԁһӏвкмнтАВЕКМНОРСТУХІЈЅοανρτυικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhlbkmhtABEKMHOPCTYXIJSoavptuikABEZHIKMNOPTYX", strict=True))
INVISIBLE = "­᠎​‌‍‎‏⁠⁡⁢⁣﻿"
#: Digit words: English, and the words of the corpus's other languages that no common word of prose equals.
SPELLED = {w: str(i) for i, ws in enumerate(("zero oh null cero zéro", "one eins uno", "two zwei zwo dos deux", "three drei tres trois", "four vier cuatro quatre", "five fünf cinco cinq", "six sechs seis", "seven sieben siete sept", "eight acht ocho huit", "nine neun nueve neuf")) for w in ws.split()}
_WORDS = "|".join(sorted(SPELLED, key=len, reverse=True))
_ONE = rf"(?:(?:double|triple)[\s-]+)?(?<!\w)(?:{_WORDS})(?!\w)"
#: At least three digit words in a row, possibly with digits and joining signs among them.
SPELLED_RUN = re.compile(rf"(?<!\w)(?:plus[\s-]+)?{_ONE}(?:[\s,.()+-]*(?:{_ONE}|[0-9]|plus(?!\w)|(?:dot|point)(?!\w))){{2,}}", re.I)
SPELLED_PART = re.compile(rf"(?:(double|triple)[\s-]+)?(?<!\w)({_WORDS})(?!\w)|(plus)(?!\w)|(dot|point)(?!\w)", re.I)
#: Top-level domains that may end an address whose at is a bare word; those that are common words are left out.
_TOP = "com|org|net|edu|gov|mil|info|biz|io|co|dev|app|ai|uk|ca|de|fr|es|nl|eu|ch|se|dk|fi|pl|pt|br|mx|jp|cn|ru|au|nz"
_POINT = r"(?:\s*[\[({<]\s*(?:dot|punkt|punto|point|\.)\s*[\])}>]\s*|\s+(?:dot|punkt|punto)\s+|\.)"
#: Bracketed or spelled at and dot. Runs of white space and dashes are entered at their start only.
_GAP = r"(?:(?<!\s)\s+|(?<!\s))"
_DASH = r"(?:(?<!\s)\s+|(?<![\s_-]))[_-]+"
AT = re.compile(rf"{_GAP}[\[({{<]\s*(?:at|@|arroba|ät)\s*[\])}}>]\s*|(?<!\s)\s+(?:at|arroba)\s+(?=[\w-]+(?:{_POINT}[\w-]+)*?{_POINT}(?:{_TOP})(?!\w))|{_DASH}at[_-]+\s*", re.I)
DOT = re.compile(rf"{_GAP}[\[({{<]\s*(?:dot|punkt|punto|point|\.)\s*[\])}}>]\s*|(?<=\w)\s+(?:dot|punkt|punto)\s+(?=\w)|(?<=[^\W_]){_DASH}dot[_-]+\s*(?=\w)", re.I)
SPACED_AT = re.compile(r"(?<=[A-Za-z0-9])\x20{1,3}@\x20{0,3}(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])@\x20{1,3}(?=[A-Za-z0-9])")


#: The patterns above without what looks around, for Arrow; its \s is ASCII only.
_SP = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NOT_SP = _SP.replace("[", "[^", 1)
_JOIN = _SP.replace("]", ",.()+-]") + "*"
_ITEM = rf"(?:{_WORDS}|[0-9]|plus|dot|point|(?:double|triple)(?:{_SP}|-)+(?:{_WORDS}))"
_MAY = (
    rf"[\[({{<]{_SP}*(?:at|@|arroba|ät|dot|punkt|punto|point|\.){_SP}*[\])}}>]|{_SP}(?:dot|punkt|punto){_SP}|[_-](?:at|dot)[_-]"
    rf"|{_SP}(?:at|arroba){_SP}+{_NOT_SP}+\.(?:{_TOP})|[A-Za-z0-9]\x20{{1,3}}@|@\x20{{1,3}}[A-Za-z0-9]|(?:{_WORDS}){_JOIN}{_ITEM}{_JOIN}{_ITEM}"
)


@cache
def homoglyphs() -> dict[str, str]:
    """Each character outside ASCII that stands for ASCII, with what it stands for; invisible characters with nothing."""
    out = dict(LOOKALIKE) | dict.fromkeys(INVISIBLE, "")
    for cp in (*range(0xB2, 0x3000), *range(0xFE00, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F1A0), *range(0xE0020, 0xE0080)):
        c = chr(cp)
        if c in out or unicodedata.category(c) in ("Cn", "Cs", "Zs", "Mn"):
            continue
        n = unicodedata.normalize("NFKC", c)
        if unicodedata.category(c) == "Nd":
            n = str(unicodedata.digit(c))
        if n != c and len(n) == 1 and n.isascii() and n.isprintable():
            out[c] = n
    for c in "‐‑‒–−﹣":
        out[c] = "-"
    out["．"] = out["。"] = out["․"] = out["﹒"] = "."
    return out


@cache
def _glyph():
    """Any of the characters that homoglyphs() rewrites."""
    return re.compile("[" + "".join(homoglyphs()) + "]")


def may_be_rewritten(texts: pa.Array) -> pa.Array:
    """False for texts that no transducer rewrites. The dotless and the dotted i are there because re.I takes them for an i."""
    glyph = pc.match_substring_regex(texts, _glyph().pattern[:-1] + "ıİ]")
    return pc.fill_null(pc.or_(glyph, pc.match_substring_regex(texts, _MAY, ignore_case=True)), False)


class Mapped:
    """A text with the source span of each of its characters."""

    def __init__(self, text: str, start=None, end=None):
        self.text = text
        self.start = np.arange(len(text)) if start is None else start
        self.end = np.arange(1, len(text) + 1) if end is None else end

    def rewrite(self, hits: list[tuple[int, int, str]]) -> Mapped:
        """The text with each (start, end, new) replaced; every new character stands for the whole replaced span."""
        if not hits:
            return self
        out, at = [], 0
        for a, b, new in hits:
            out += self.text[at:a], new
            at = b
        out.append(self.text[at:])
        first, last = np.array([h[0] for h in hits]), np.array([h[1] for h in hits])
        size = np.array([len(h[2]) for h in hits])
        # what stays between hits and what each hit gives, in turn: from which character the start and the end come
        rest = np.concatenate((first, [len(self.text)])) - np.concatenate(([0], last))
        n = np.zeros(2 * len(hits) + 1, np.int64)
        n[0::2], n[1::2] = rest, size
        lo, hi = np.zeros_like(n), np.zeros_like(n)
        lo[0::2], lo[1::2] = np.concatenate(([0], last)), first
        hi[0::2], hi[1::2] = lo[0::2], last - 1
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place[np.repeat(np.arange(len(n)) % 2 == 1, n)] = 0
        return Mapped("".join(out), self.start[np.repeat(lo, n) + place], self.end[np.repeat(hi, n) + place])


def _glyphs(m: Mapped) -> Mapped:
    if m.text.isascii():
        return m
    table = homoglyphs()
    return m.rewrite([(*h.span(), table[h[0]]) for h in _glyph().finditer(m.text)])


def _spelled(m: Mapped) -> Mapped:
    hits = []
    for run in SPELLED_RUN.finditer(m.text):
        at = run.start()
        for p in SPELLED_PART.finditer(m.text, run.start(), run.end()):
            between = m.text[at : p.start()]
            if hits and at > run.start() and between and not between.strip(" ,\t\n"):
                hits.append((at, p.start(), ""))  # white space and commas between spelled digits go
            times = {"double": 2, "triple": 3}.get((p[1] or "").lower(), 1)
            hits.append((*p.span(), "+" if p[3] else "." if p[4] else SPELLED[p[2].lower().replace("ı", "i").replace("i\u0307", "i")] * times))
            at = p.end()
    return m.rewrite(hits)


def _at_dot(m: Mapped) -> Mapped:
    m = m.rewrite([(*h.span(), "@") for h in AT.finditer(m.text)])
    m = m.rewrite([(*h.span(), "@") for h in SPACED_AT.finditer(m.text)])
    return m.rewrite([(*h.span(), ".") for h in DOT.finditer(m.text)])


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """The matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, from each at sign outwards."""
    out, at, i = [], 0, text.find("@")
    while i >= 0:
        start, domain = i - LOCAL.match(text[at:i][::-1]).end(), DOMAIN.match(text, i + 1)
        if start < i and domain:
            out.append((start, domain.end()))
        at = domain.end() if start < i and domain else i + 1
        i = text.find("@", at)
    return out


def detect(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns."""
    out = [("email", *span) for span in emails(text)]
    if not DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if 12 <= len(m[0]) <= 40:
            d = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def disguised(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """What the patterns find after the transducers, as source spans, less what lies inside a base span of the same kind; a
    span that only begins or ends in one stays, since it covers more of the identifier."""
    plain = Mapped(text)
    m = _at_dot(_spelled(_glyphs(plain)))
    if m is plain:
        return []
    ends = {k: [0] for k in KINDS}
    starts = {k: [0] for k in KINDS}
    for k, p, q in base:  # spans of a kind are in order and apart
        starts[k].append(p)
        ends[k].append(q)
    out = set()
    for kind, x, y in detect(m.text):
        s, e = int(m.start[x]), int(m.end[y - 1])
        if ends[kind][bisect_right(starts[kind], s) - 1] < e:
            out.add((kind, s, e))
    return sorted(out, key=lambda s: (s[1], s[2], s[0]))


def pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_disguised, n_spans, base_sha256, spans) for every row of docs.

    The counts of kinds and base_sha256 are of the base patterns; n_spans and spans also have what deobfuscation adds. A
    null text counts as empty: no spans and the digest of the empty string. Repeated rows are scanned each; an empty table
    gives no rows; other columns are not read; a null id stays.
    """

    def part(batches):
        for b in batches:
            cols = [[] for _ in range(8)]
            for t, may in zip(b.column(1), may_be_rewritten(b.column(1)).to_pylist()):
                text = t.as_py() or ""
                base = detect(text)
                more = disguised(text, base) if may else []
                kinds = [s[0] for s in base]
                for c, x in zip(cols, (*(kinds.count(k) for k in KINDS), len(more), len(base) + len(more), digest(base, KINDS), joined(base + more, KINDS))):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:6]), *(pa.array(c, pa.string()) for c in cols[6:])], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_disguised", "n_spans", "base_sha256", "spans"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_disguised long, n_spans long, base_sha256 string, spans string"
    return tk.map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col), part, schema)


def op2_pii(spark, sf_dir):
    return pii(table(spark, sf_dir, "documents"))


QUERIES = {"op2_pii": op2_pii}
ORACLES: dict = {}
