import hashlib
import random
import time

import duckdb
import pytest

from phonolake.llm import secret_scan

SF = "/root/testdata/sf0.01"


def plain(text):
    """The three patterns as stated: leftmost matches of any length, short ones dropped, letter by letter."""
    low, found = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text), []
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")

    def run(i, allowed):
        j = i
        while j < len(text) and text[j] in allowed:
            j += 1
        return j

    i = 0
    while i < len(text):
        word = next((w for w in ("password", "passwd", "secret", "token", "api_key", "apikey") if low.startswith(w, i)), None)
        end = None
        if word:
            j = i + len(word)
            j += j < len(text) and text[j] in "\"'"
            j = run(j, " ")
            if j < len(text) and text[j] in ":=":
                j = run(j + 1, " ")
                j += j < len(text) and text[j] in "\"'"
                end = run(j, value)
                if end > j:
                    if end - j >= 12:
                        found.append((i, end, "assign"))
                else:
                    end = None
        i = end or i + 1
    for kind, allowed, head, least in (("access", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), "AKIA", 18), ("hex", set("0123456789abcdef"), "", 16)):
        i = 0
        while i < len(text):
            end = run(i + len(head), allowed) if text.startswith(head, i) else i
            if end > i + len(head) and end - i >= least:
                found.append((i, end, kind))
            i = end if end > i + len(head) else i + 1
    return sorted(found, key=lambda f: (f[0], secret_scan.KINDS.index(f[2])))


def test_patterns_equal_a_plain_reading():
    draw = random.Random(4)
    parts = ["password", "PassWD", "secret", "token", "api_key", "ApiKey", "=", ":", " ", '"', "'", "AKIA", "AKIAZZZZ9999XXXX11", "0123456789abcdef", "deadbeef", "ab", "ſecret", "toKen", "x.y-z/w+", "é", "\n", "AAAA1111BBBB22"]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(1, 14)))
        got = [(s, e, kind) for s, e, kind, _, _ in secret_scan.text_spans(text) if kind != "literal"]
        assert got == plain(text), text


def test_given_texts_equal_duckdb(spark):
    piece = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    sql = f"""SELECT doc_id, len(list_filter(regexp_extract_all(text, '{piece}', 1), lambda x: len(x) >= 12)),
      len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: len(x) >= 18)), len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: len(x) >= 16))
      FROM '{SF}/documents.parquet'"""
    got = secret_scan.secret_counts(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert {(r.doc_id, r.n_assign, r.n_access, r.n_hex) for r in got} == set(duckdb.sql(sql).fetchall())
    for r in got:
        base = [s for s in r.spans.split(",") if s and not s.startswith("literal")]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and len(base) == r.n_assign + r.n_access + r.n_hex
        assert bool(r.n_literal) <= bool(r.n_assign), "clean texts stay clean"


def literals(text):
    return {text[s:e] for s, e, kind, _, _ in secret_scan.text_spans(text) if kind == "literal"}


@pytest.mark.parametrize(
    ("text", "values"),
    [
        ('db_password = "hunter2!x9"', {"hunter2!x9"}),
        ("DB_PWD=Zx81-qq07", {"Zx81-qq07"}),
        ('{"clientSecret": "a8f5f167f44f", "user": "bob-77-xyz"}', {"a8f5f167f44f"}),
        ("api:\n  access_key: Qw7Er2Ty9\n  region: eu-west-1\n", {"Qw7Er2Ty9"}),
        ('password: str = "p4ssw0rd99"', {"p4ssw0rd99"}),
        ('a = "Xk29fj"\nb = "Lm83qz"\nauth_key = a + b\n', {"Xk29fj", "Lm83qz"}),
        ('BASE = "t0psecret77"\nalias = BASE\nsetup(password=alias)\n', {"t0psecret77"}),
        ("K1=Ab12Cd34Ef\nSESSION_TOKEN=${K1}\n", {"Ab12Cd34Ef"}),
        ('key = (\n  "Ab12Cd34"\n  "Ef56Gh78"\n)\nsecret = key\n', {"Ab12Cd34", "Ef56Gh78"}),
        ('x = "first11a"\npassword = x\nx = "second22b"\n', {"first11a"}),
        ("<password>S3cr3tPa55</password>", {"S3cr3tPa55"}),
        ('<add key="ApiKey" value="Zz91-Yy82-Xx73"/>', {"Zz91-Yy82-Xx73"}),
        ('config.setPassword("S3cr3tPa55")', {"S3cr3tPa55"}),
        ('headers.put("api_key", "S3cr3tPa55")', {"S3cr3tPa55"}),
        ("mysql --password S3cr3tPa55 -u root", {"S3cr3tPa55"}),
        ('#define API_KEY "S3cr3tPa55"', {"S3cr3tPa55"}),
        ("postgres://bob:S3cr3tPa55@db/main", {"S3cr3tPa55"}),
        ('password = "changeme123"', set()),
        ('password = "${DB_PASSWORD}"', set()),
        ('password_file = "/run/a1b2c3d4"', set()),
        ('password = os.environ["DB_PASSWORD"]', set()),
        ("password = settings.password", set()),
        ("token: something\nThe key: be patient, don't panic.", set()),
        ('greeting = "Ab12Cd34Ef56"', set()),
        ("a = b\nb = a\npassword = a\n", set()),
        ("", set()),
    ],
)
def test_literals_that_reach_sensitive_names(text, values):
    assert literals(text) == values


def test_propagation_equals_substitution():
    """Chains of constants against replacing names by their values until nothing changes."""
    draw = random.Random(8)
    for _ in range(200):
        lines, value = [], {}
        for i in range(draw.randint(1, 12)):
            terms = draw.sample(sorted(value), min(len(value), draw.randint(0, 2)))
            own = [f"v{draw.randint(10, 99)}Q{draw.randint(100, 999)}z"] if not terms or draw.random() < 0.5 else []
            name = draw.choice([f"part{i}", f"secret{i}", f"note{i}"])
            lines.append(f"{name} = " + " + ".join([*(f'"{o}"' for o in own), *terms]))
            value[name] = set(own).union(*(value[t] for t in terms))
        want = set().union(*(v for n, v in value.items() if n.startswith("secret")), set())
        assert literals("\n".join(lines)) == want, lines


def test_edges_and_time(spark):
    rows = [(1, None), (2, ""), (None, "secret=abcdefghijkl"), (3, "é token='abcdefghijklm'"), (3, "é token='abcdefghijklm'")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, found int, spans string")
    got = sorted(((r.doc_id, r.n_assign, r.spans.split(",")[0]) for r in secret_scan.secret_counts(docs).collect()), key=repr)
    assert got == sorted([(1, 0, ""), (2, 0, ""), (None, 1, "assign:0:19"), (3, 1, "assign:2:22"), (3, 1, "assign:2:22")], key=repr)
    assert secret_scan.secret_spans(docs.limit(0)).count() == 0
    for text in ['password="' * 40000, "a=b\n" * 60000 + "password = a", "password = a+" * 30000, "key: ${" * 50000, '"""' + "'" * 99999 + "secret", "token(" * 60000, "a+" * 90000 + "pwd"]:
        start = time.time()
        secret_scan.text_spans(text)
        assert time.time() - start < 10, text[:20]
