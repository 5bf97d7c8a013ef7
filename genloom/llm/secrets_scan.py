"""Secret scan by dictionary-primed zstandard novelty.

Base patterns give assignments, access keys and long hexadecimal runs. Beyond them a string in a sensitive context (after a
name that holds a word such as password, auth or credential and an assigning sign, as a bearer token or basic credentials,
as the password in an URL, or in a key block, public keys aside) is a candidate: the maximal run, whatever its length, or
the whole body of the block. Its novelty is its marginal compressed size: the bytes by which a frame grows when the
candidate is appended to its surrounding code, under a zstandard dictionary of that surrounding text and of identifiers
that code commonly uses, over the candidate's length. Words, paths and names repeat something known and compress; keys
don't. How far anything can compress depends on its alphabet and length, so the measure is held against that of a random
string of the same length over the candidate's characters; a candidate that comes near it is reported as kind novel.

Every scan is linear in the text: patterns are anchored at signs and words and look back over one run only.
"""

from __future__ import annotations

import base64
import binascii
import itertools
import random
import re
from bisect import bisect_right

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genloom.llm import textkernel as tk
from genloom.llm.spans import digest, joined
from genloom.runtime import table

KINDS = ["assign", "access", "hex", "novel"]
#: Share of the novelty of a random string of its kind from which a candidate counts as incompressible; characters of
#: context on either side; least characters of a candidate.
NOVELTY, AROUND, SHORTEST = 0.8, 2048, 12
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a maximal run of 16 or more, as [0-9a-f]+ with a check of its length
HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "basic", "credential", "signature", "private", "://")
_RUN = r"[A-Za-z0-9+/_.=~!$%^&*-]"
#: An assigning sign with a candidate behind it; the name before it is looked at from the sign backwards.
SIGN = re.compile(rf"(?:=>|:=|[:=])\s{{0,3}}[\"'`]?(?={_RUN}{{12}})", re.A)
CANDIDATE = re.compile(rf"{_RUN}++", re.A)
NAME = re.compile(r"\s{0,3}[\"'\]]{0,2}(\w*+)", re.A)
SENSITIVE = re.compile("pass|pwd|secret|token|key|auth|credential|signature|private", re.A | re.I)
BEARER = re.compile(rf"\b(?:(bearer)|basic)\s{{1,3}}({_RUN}{{12,}}+)", re.A | re.I)
LOGIN = re.compile(rf"://[^\s:/@]++:({_RUN}{{12,}}+)@", re.A)
#: Marks of a key block, and its body's lines where the end mark is missing.
MARK = re.compile(r"-----(BEGIN|END)\x20([^\n-]*+-----)?", re.A | re.I)
BODY = re.compile(r"(?:(?:\s|\\[rn])*+(?:[A-Za-z0-9+/=]{16,}+|[A-Za-z0-9+/]{1,15}=++|[\w-]++:\x20[^\n]*+|[A-Za-z0-9+/=]++(?=\s*+\Z)))*+", re.A)
_BETWEEN = re.compile(r'''(?:\s|\\[rn]|["'+,]){1,16}''')
IDENTIFIERS = (
    "import from class def return self public private static final void string int function const let var new this null none true false "
    "config settings environment variable default value example placeholder changeme your_password your_secret_key your_api_key_here "
    "password username user admin root token secret key access_token refresh_token client_id client_secret api_key apikey auth authorization "
    "bearer basic header request response session cookie database connection host port localhost server client service account "
    "os.environ.get getenv process.env System.getProperty config.get settings.SECRET_KEY read_file load_secret vault path/to/file "
    "http https www example.com github.com amazonaws.com application/json content-type utf-8 abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 xxxxxxxxxxxxxxxx 0000000000000000 ................ ---------------- ================"
).encode()


def novelty(before: str, candidate: str, after: str) -> tuple[float, float]:
    """Marginal compressed bytes a character against the surroundings and the identifier dictionary: of the candidate, and
    of a random string of its length over its characters."""
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + b"\n" + after.encode("utf-8", "replace") + b"\n" + before.encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    pack = zstandard.ZstdCompressor(level=19, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False).compress
    # a probe of the context's end stands before the candidate, so that both frames hold the same overhead
    probe = before[-32:].encode("utf-8", "replace")
    none, n = len(pack(probe)), max(1, len(candidate))
    chance = "".join(random.Random(0).choices(sorted(set(candidate)) or [""], k=len(candidate)))
    return (len(pack(probe + candidate.encode())) - none) / n, (len(pack(probe + chance.encode())) - none) / n


def _is_novel(text: str, a: int, b: int, candidate: str) -> bool:
    if candidate == candidate[0] * len(candidate):  # a string of one character is like any other of them
        return False
    got, chance = novelty(text[max(0, a - AROUND) : a], candidate, text[b : b + AROUND])
    return got >= NOVELTY * chance


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def _blocks(text: str):
    """(start, end) of the bodies of key blocks: up to the next mark if that is an end, else as far as lines look like base64."""
    marks = list(MARK.finditer(text))
    for m, nxt in zip(marks, [*marks[1:], None]):
        head = (m[2] or "").upper()
        if m[1].upper() == "BEGIN" and "KEY" in head and "PUBLIC" not in head:
            ends = nxt is not None and nxt[1].upper() == "END"
            yield m.end(), nxt.start() if ends else BODY.match(text, m.end()).end()


def _is_login(s: str) -> bool:
    """Whether s is base64 of a name, a colon and a password."""
    try:
        return b":" in base64.b64decode(s, validate=True)
    except binascii.Error:
        return False


def _contexts(text: str, low: str):
    """(start, end) of the candidates outside key blocks."""
    at = 0
    while m := SIGN.search(text, at):
        # the name before the sign, read backwards; what lies between two signs is read once
        back = NAME.match(text[at : m.start()][::-1])
        at = m.end()
        if SENSITIVE.search(back[1][::-1]):
            at = CANDIDATE.match(text, at).end()
            yield m.end(), at
    if "bearer" in low or "basic" in low:
        yield from (m.span(2) for m in BEARER.finditer(text) if m[1] or _is_login(m[2]))
    if "://" in text:
        yield from (m.span(1) for m in LOGIN.finditer(text))


def novel_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    low = text.lower()
    if not any(h in low for h in HINTS):
        return []
    out, taken = [], sorted((a, b) for _, a, b in base)
    for a, b in _blocks(text) if "-----begin " in low else ():
        b -= len(text[a:b]) - len(text[a:b].rstrip())
        a += len(text[a:b]) - len(text[a:b].lstrip())
        s = _BETWEEN.sub("", text[a:b])
        if len(s) >= SHORTEST and _is_novel(text, a, b, s):
            out.append(("novel", a, b))
    taken = sorted([*taken, *((a, b) for _, a, b in out)])
    first, furthest = [a for a, _ in taken], list(itertools.accumulate((b for _, b in taken), max))
    seen = set()
    for a, b in _contexts(text, low):
        b = a + len(text[a:b].rstrip(".,;:!"))
        i = bisect_right(first, a) - 1  # what lies inside a base span or a block is covered already
        if b - a < SHORTEST or (i >= 0 and furthest[i] >= b) or (a, b) in seen:
            continue
        seen.add((a, b))
        if _is_novel(text, a, b, text[a:b]):
            out.append(("novel", a, b))
    return sorted(out, key=lambda s: s[1:])


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_novel, n_spans, base_sha256, spans) for every row of docs.

    The counts of kinds and base_sha256 are of the base patterns; n_spans and spans also have what the novelty measure adds,
    as kind novel. A null text counts as empty: no spans and the digest of the empty string. Repeated rows are scanned each;
    an empty table gives no rows; other columns are not read; a null id stays.
    """

    def part(batches):
        for b in batches:
            cols = [[] for _ in range(7)]
            for t in b.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                more = novel_spans(text, base)
                kinds = [s[0] for s in base]
                for c, x in zip(cols, (*(kinds.count(k) for k in KINDS[:3]), len(more), len(base) + len(more), digest(base, KINDS), joined(base + more, KINDS))):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:5]), *(pa.array(c, pa.string()) for c in cols[5:])], ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "n_spans", "base_sha256", "spans"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, n_spans long, base_sha256 string, spans string"
    return tk.map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col), part, schema)


def op8_secrets(spark, sf_dir):
    return secrets(table(spark, sf_dir, "documents"))


QUERIES = {"op8_secrets": op8_secrets}
ORACLES: dict = {}
