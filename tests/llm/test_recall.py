"""What the methods of op2 and op8 add, measured on planted cases, and that their scans are linear in a text."""

import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from genloom.llm import pii, secrets_scan
from test_text import base_pii, base_secrets

DIGITS = "zero one two three four five six seven eight nine".split()


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(n))


def luhn_number(rng, n=16):
    d = [rng.randint(0, 9) for _ in range(n - 1)]
    for c in range(10):
        if pii.luhn("".join(map(str, [*d, c]))):
            return "".join(map(str, [*d, c]))


def name(rng):
    return "".join(rng.choice("abcdefghklmnoprstuvz") for _ in range(rng.randint(3, 8)))


def fullwidth(s):
    return "".join(chr(ord(c) + 0xFEE0) if c.isdigit() else c for c in s)


def phone(rng):
    return "+1 " + "".join(str(rng.randint(2, 9)) for _ in range(10))


DISGUISES = {
    "bracketed at and dot": ("email", lambda r: f"{name(r)}.{name(r)} [at] {name(r)} [dot] com"),
    "round brackets": ("email", lambda r: f"{name(r)}(at){name(r)}(dot)org"),
    "spelled at and dot": ("email", lambda r: f"{name(r)} at {name(r)} dot com"),
    "spelled at": ("email", lambda r: f"{name(r)} at {name(r)}.{r.choice(['com', 'org', 'de', 'io'])}"),
    "arroba and punto": ("email", lambda r: f"{name(r)} arroba {name(r)} punto es"),
    "dashes": ("email", lambda r: f"{name(r)}_at_{name(r)}_dot_net"),
    "spaces around the at": ("email", lambda r: f"{name(r)} @ {name(r)}.com"),
    "Cyrillic letters": ("email", lambda r: f"{name(r)}а@{name(r)}о.com"),
    "invisible characters": ("email", lambda r: f"{name(r)}​{name(r)}@{name(r)}­{name(r)}.com"),
    "wide digits of a phone": ("phone", lambda r: fullwidth(phone(r))),
    "spelled phone": ("phone", lambda r: "plus one " + " ".join(DIGITS[int(c)] for c in phone(r)[3:])),
    "partly spelled phone": ("phone", lambda r: "+1 " + " ".join([*(DIGITS[r.randint(2, 9)] for _ in range(3)), str(r.randint(1000000, 9999999))])),
    "doubled digits": ("phone", lambda r: "plus one double five " + " ".join(DIGITS[r.randint(2, 9)] for _ in range(8))),
    "wide digits of a card": ("card", lambda r: fullwidth(luhn_number(r))),
    "dashes of a card": ("card", lambda r: "‑".join(re.findall("....", luhn_number(r)))),
    "spelled card": ("card", lambda r: " ".join(DIGITS[int(c)] for c in luhn_number(r))),
    "spelled dots of an address": ("ip", lambda r: " dot ".join(str(r.randint(1, 255)) for _ in range(4))),
    "bracketed dots of an address": ("ip", lambda r: "[.]".join(str(r.randint(1, 255)) for _ in range(4))),
    "wide address": ("ip", lambda r: ".".join(fullwidth(str(r.randint(1, 255))) for _ in range(4))),
}


@pytest.mark.parametrize("disguise", DISGUISES)
def test_recall_of_disguises(disguise):
    kind, make = DISGUISES[disguise]
    rng, found, exact = random.Random(disguise), 0, 0
    for _ in range(60):
        hidden = make(rng)
        t = f"{prose(rng, 30)}; {hidden} ; {prose(rng, 30)}"
        a, spans = t.index(hidden), pii.disguised(t, pii.detect(t))
        found += any(k == kind and s < a + len(hidden) and a < e for k, s, e in spans)
        exact += (kind, a, a + len(hidden)) in spans
    assert found >= 54 and exact >= 54, (found, exact)


def test_a_longer_disguised_span_stays_beside_the_base_span():
    t = "write to ann@mail.co [dot] uk today"
    base = pii.detect(t)
    assert base == [("email", 9, 20)] and pii.disguised(t, base) == [("email", 9, 29)]


def test_prose_gets_no_spans(spark):
    """Precision: the documents' prose, and English sentences with the words that transducers know."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert sum(r.n_disguised for r in pii.pii(df).select("n_disguised").collect()) == 0
    for t in ("Meet at noon at the station, dot the i and cross the t.", "one or two, three at most, four if five come", "We were at home. Point taken, he said at last.", "at one point the ratio was 3 to 4"):
        assert not pii.disguised(t, pii.detect(t))


ALPHABETS = {
    "digits": "0123456789", "upper hex": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "lower": "abcdefghijklmnopqrstuvwxyz", "lower and digits": "abcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "URL base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
FORMS = ["db_pass = '{}'\nconnect(host, db_pass)", 'headers["Authorization"] = "Bearer {}"', "url = 'https://svc:{}@db.example.com/x'", "export SIGNING_KEY={}\nexec server", '{{"client": "a", "private_key": "{}"}}']


@pytest.mark.parametrize("alphabet", ALPHABETS)
@pytest.mark.parametrize("size", [16, 24, 40, 100, 900, 5000])
def test_recall_of_secrets(alphabet, size):
    rng, found = np.random.default_rng(size), 0
    for i in range(20):
        key = "".join(rng.choice(list(ALPHABETS[alphabet]), size))
        t = f"import os\nfrom app import settings\n\n{FORMS[i % 5].format(key)}\n\ndef main():\n    return settings.run()\n"
        base = secrets_scan.base_spans(t)
        a = t.index(key)
        found += any(s <= a and e >= a + size for _, s, e in base + secrets_scan.novel_spans(t, base))
    assert found >= 18


def test_basic_credentials():
    t = "curl -H 'X: Basic dXNlcjpwNHNzdzByZC0xMjM0NQ==' http://h"
    assert secrets_scan.novel_spans(t, []) == [("novel", 18, 46)]
    t = "basic understanding of basic requirements"
    assert not secrets_scan.novel_spans(t, [])


def test_code_without_secrets_gets_few_spans():
    code = ["token = settings.SECRET_KEY", "password = os.environ.get('DB_PASSWORD')", "api_key: config.get(default_value)", "key = getConfigurationValueFromEnvironment", "auth = Client(username, password)", "secret_name: path/to/file/config", "key: my_default_value_of_key", "private_key_path = /path/to/file/private_key", "credentials = credentials.credentials.Credentials", "http://localhost:8080/path/to/file/config"]
    t = "\n".join(code)
    assert len(secrets_scan.novel_spans(t, secrets_scan.base_spans(t))) <= 1
    assert sum(bool(secrets_scan.novel_spans(line, secrets_scan.base_spans(line))) for line in code) <= 2


def test_prose_gets_no_secrets(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = secrets_scan.secrets(df).collect()
    assert sum(r.n_novel > 0 for r in out) <= 0.01 * len(out)


RUNS = {
    "letters": "a", "digits": "1", "base64": "aB3/", "dots": "1.", "ats": "a@", "spaces": " ", "dashes": "-", "underscores": "_", "brackets": "[ ", "spelled": "one ", "commas": "one,,,", "keys": "key", "assigned": "key=", "signs": "=", "addresses": "://", "blocks": "-----BEGIN A KEY-----\n", "dotted": " dot ", "at words": " at a.b", "names": "_at_", "plus": "+1(",
}


@pytest.mark.parametrize("run", RUNS)
def test_long_runs_are_read_in_linear_time(run):
    took = []
    for n in (100_000, 1_000_000):
        t = "token x@ +1 five ] key " + RUNS[run] * (n // len(RUNS[run])) + " key"
        began = time.process_time()
        pii.disguised(t, pii.detect(t))
        secrets_scan.novel_spans(t, secrets_scan.base_spans(t))
        took.append(time.process_time() - began)
    assert took[1] < 20 * max(took[0], 0.15), took


_SECRET = st.lists(st.sampled_from(["password", "passwd", "SECRET", "token", "api_key", "apikey", "'", '"', " ", "  ", ":", "=", "AKIA", "ABCDEFGH12345678", "0f9a", "deadbeefdeadbeef", "x", ".", "-", "/", "\n", "é"]), max_size=14).map("".join)


@settings(max_examples=500, deadline=None)
@given(_SECRET)
def test_secret_base_on_any_text(t):
    assert sorted(secrets_scan.base_spans(t)) == sorted(base_secrets(t))


_MAIL = st.lists(st.sampled_from(["a", "B9", "@", ".", "..", "-", "_", "%", "+", " ", "é", "10", ".1", "255.", "256"]), max_size=24).map("".join)


@settings(max_examples=800, deadline=None)
@given(_MAIL)
def test_pii_base_on_runs(t):
    assert sorted(pii.detect(t)) == sorted(base_pii(t))
