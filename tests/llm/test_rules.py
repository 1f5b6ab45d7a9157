"""Chat windows, URL rules and secret scans."""

import base64
import bz2
import gzip
import hashlib
import json
import lzma
import random
import re
import urllib.parse
import zlib
from collections import defaultdict

import pytest
import zstandard
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from readloom.llm import chat, queries as Q, secret_scan as S, urls

DATA = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, formatted string, cell long"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], TURNS)


def read_back(windows):
    new = F.slice(chat.parsed_turns(F.col("formatted")), F.col("n_context") + 1, F.col("n_turns"))
    out = defaultdict(list)
    for r in sorted(windows.select("conv_id", "window_start", new.alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss")).alias("masked"), "n_tokens", "n_context", "formatted").collect(), key=lambda r: (r.conv_id is None, r.conv_id or 0, r.window_start)):
        out[r.conv_id].append(r)
    return out


NASTY = ["\\### Assistant: </turn> ok", "", "####", "a\\", "<\\/turn>", "</turn></turn>\n", "### user: hi", "\\n\\#", "x" * 3000, "é\U0001f600"]


def test_chat_round_trip(spark):
    rows = [(c, t, ("system" if t == 0 else "user" if t % 2 else "assistant"), NASTY[(c + t) % len(NASTY)]) for c in range(12) for t in range(c + 1)]
    rows += [(None, None, None, None), (None, 1, "a:b\\", "x"), (5, 2, "assistant", "again"), (5, 2, "assistant", "again")]
    back = read_back(chat.turn_windows(turns(spark, rows), 64, 16))
    expected = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        expected[c].append((r or "", x or ""))
    assert {c: [tuple(t) for w in ws for t in w.turns] for c, ws in back.items()} == expected
    assert {c: "".join(w.masked for w in ws) for c, ws in back.items()} == {c: "".join(x for r, x in ts if r == "assistant") for c, ts in expected.items()}


def test_chat_windows(spark):
    rows = [(1, 0, "system", "be brief")] + [(1, t, "user" if t % 2 else "assistant", f"turn {t} " + "y" * 40) for t in range(1, 40)]
    ws = read_back(chat.turn_windows(turns(spark, rows), 64, 32))[1]
    assert len(ws) > 10 and all(w.n_tokens <= 64 + 32 + 6 for w in ws)
    assert all(w.formatted.startswith("### system: be brief</turn>\n") for w in ws)
    assert ws[0].n_context == 0 and all(w.n_context >= 2 for w in ws[1:])  # the system turn and some history
    for before, w in zip(ws, ws[1:]):
        history = w.formatted.split(chat.END)[1 : w.n_context]
        assert before.formatted.split(chat.END)[-2] == history[-1]


def test_chat_empty(spark):
    assert chat.turn_windows(turns(spark, [])).count() == 0


@pytest.mark.skipif(not __import__("os").path.isdir(DATA), reason="no test data")
def test_chat_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, t, r, "\\### Assistant: </turn> ok") for t, r in enumerate(("user", "assistant"))]
    talks = defaultdict(list)
    for c, _, r, x in sorted(rows):
        talks[c].append((r, x or ""))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    expected = {}
    for c, ts in talks.items():
        loss = "".join(x for r, x in ts if r == "assistant")
        expected[c] = (len(ts), sha("".join(f"{r}\n{x}\n" for r, x in ts)), len(loss), sha(loss))
    got = Q.op2_chat(spark, DATA).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == expected and len(got) == len(expected)
    assert all(r.formatted_chars > 0 for r in got)


def judged(spark, rows, rules):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(rows)], "page_id long, url string, host string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, rules).collect()}


def test_url_rules(spark):
    rules = spark.sql("SELECT * FROM VALUES ('com','/en/','block'),('example.com','/en/7','allow'),('example.com','/en/7','block'),('a.example.com','','allow'),('','/x','block'),('org',NULL,'block') AS r(host,path,verdict)")
    got = judged(spark, ["http://www.Example.COM/en/700?x#y", "https://example.com/en/6", "x.com/en/", None, "", "a://b.a.example.com", "http://badexample.com/fr/", "http://notcom/en/", "s://h://com/en/", "http://com/en/#", "https://ÀB.com/en/é"], rules)
    assert got[0] == ("www.example.com", "/en/700", "example.com/en/7", "block")  # block beats allow of equal rules
    assert got[1] == ("example.com", "/en/6", "com/en/", "block")
    assert got[2] == got[3] == got[4] == ("", "", None, "allow")
    assert got[5] == ("b.a.example.com", "", "a.example.com", "allow")
    assert got[6] == ("badexample.com", "/fr/", None, "allow") and got[7] == ("notcom", "/en/", None, "allow")
    assert got[8][0] == "h:" and got[9] == ("com", "/en/", "com/en/", "block")
    assert got[10][0] == "Àb.com" and got[10][3] == "block"
    assert judged(spark, [], rules) == {}


KEY = "AKIA" + "Q7" * 8


def wrapped(text):
    raw = text.encode()
    b64 = lambda b: base64.b64encode(b).decode()
    yield "base64", b64(raw)
    yield "urlsafe", base64.urlsafe_b64encode(raw).decode().rstrip("=")
    yield "url", "".join(f"%{c:02X}" for c in raw)
    yield "unicode", "".join(f"\\u{ord(c):04x}" for c in text)
    yield "entities", "".join(f"&#{ord(c)};" for c in text)
    for name, data in (("gzip", gzip.compress(raw)), ("bz2", bz2.compress(raw)), ("xz", lzma.compress(raw)), ("zstd", zstandard.compress(raw))):
        yield name, b64(data)


@pytest.mark.parametrize("before", ["", "é\U0001f600 "])
def test_secret_layers(before):
    for name, code in wrapped(f"my key {KEY} ok"):
        for outer, nested in [("", code), *wrapped(code)]:
            text = f"{before}see [{nested}] end"
            base, found, unopened = S.scan_text(text)
            spans = [(a, b) for k, a, b in found if k == 1]
            assert spans and all(len(before) + 5 <= a < b <= len(text) - 5 for a, b in spans), (name, outer)
            assert not [x for x in base if x[0] == 1] and unopened == 0


def test_secret_cycles_and_limits():
    assert S.scan_text("%2525252541")[0] == []
    bomb = base64.b64encode(gzip.compress(b"A" * 100_000)).decode()
    assert S.scan_text(f"x {bomb} y", limit=1000)[2] == 1
    text = f"token = {KEY} and password=abc, secret: abcdef"
    assert S.scan_text(text)[0] == [(0, 0, len("token = ") + 20), (1, 8, 28), (0, text.index("secret"), len(text))]


@pytest.mark.parametrize("piece", [300, 3001])
def test_secret_large_contents(monkeypatch, piece):
    """Contents over the limit, in many pieces: secrets anywhere, within long runs and escapes and across pieces."""
    monkeypatch.setattr(S, "PIECE", piece)
    monkeypatch.setattr(S, "STEP", 100)
    filler = "".join(f"{i * 7919 % 1000003} lines of a log.\n" for i in range(300))
    random = base64.b64encode(bytes(i * i % 251 for i in range(9000))).decode()
    inner = base64.b64encode(gzip.compress(f"{filler} {KEY} {filler}".encode())).decode()
    escaped = "".join(f"%{c:02x}" for c in f"{filler[:3000]} {KEY} {filler[:3000]}".encode())
    spaces = "password" + " " * 5000 + "= hunter22"
    for kind, secret in ((1, KEY), (2, "0123456789abcdef" * 2), (0, spaces), (1, inner), (1, escaped), (1, f"{random}.{KEY}")):
        for before, after in ((filler, ""), ("", filler), (filler[:2990], filler)):
            for pack in (gzip.compress, bz2.compress, lzma.compress, zstandard.compress):
                code = base64.b64encode(pack(f"{before} {secret} {after}".encode())).decode()
                found = S.scan_text(f"see [{code}] end", limit=1000)
                assert (kind, 5, 5 + len(code.rstrip("="))) in {(k, a, b - code.count("=")) for k, a, b in found[1]} and found[2] == 1
    assert not S.scan_text(f"see [{base64.b64encode(gzip.compress(filler.encode())).decode()}] end", limit=1000)[1]


def b64(data):
    return base64.b64encode(data).decode()


def test_secret_wrapped_base64():
    filler = "".join(chr(33 + i * i % 90) for i in range(60))
    plain, packed = f"{filler} password=hunter22secret {filler}".encode(), gzip.compress(f"{filler * 9} {KEY}".encode())
    for kind, data in ((0, plain), (1, packed)):
        for width in (20, 64, 76):
            for sep in ("\n", "\r\n", "\n    ", "\\n"):
                lines = [b64(data)[i : i + width] for i in range(0, len(b64(data)), width)]
                code = sep.join(lines)
                found = S.scan_text(f"see [{code}] end")[1]
                assert any(k == kind and a == 5 and b >= 5 + len(code.rstrip("=")) for k, a, b in found), (kind, width, sep)
        armored = "-----BEGIN CERTIFICATE-----\n" + "\n".join(lines) + "\n-----END CERTIFICATE-----"
        assert any(k == kind for k, *_ in S.scan_text(armored)[1])


def test_secret_wrapped_in_large_contents(monkeypatch):
    monkeypatch.setattr(S, "PIECE", 3000)
    data = b64(bytes(i * i % 251 for i in range(9000)) + gzip.compress(f"my key {KEY} ok".encode()))
    for sep in ("\n", "\r\n"):
        inner = sep.join(data[i : i + 76] for i in range(0, len(data), 76))
        assert any(k == 1 for k, *_ in S.scan_text(b64(gzip.compress(f"see {inner} end".encode())), limit=1000)[1]), sep


def test_secret_members_and_alignments():
    for pack in (gzip.compress, bz2.compress, lzma.compress, zstandard.compress):
        first, second = pack(b"a line of text, passw"), pack(b"ord=hunter22 and more")
        assert any(k == 0 for k, *_ in S.scan_text(b64(first + second))[1]), pack
        assert any(k == 1 for k, *_ in S.scan_text(b64(first + pack(b"a") + pack(f"key {KEY}".encode())))[1]), pack
        assert any(k == 1 for k, *_ in S.scan_text(b64(b"some bytes" + pack(f"key {KEY}".encode())))[1]), pack
    frame = b"\x50\x2a\x4d\x18\4\0\0\0abcd"
    assert any(k == 0 for k, *_ in S.scan_text(b64(zstandard.compress(b"passw") + frame + zstandard.compress(b"ord=hunter22")))[1])
    for before in ("a", "a/", "id_", "path"):
        for code in (b64(f"my key {KEY} ok".encode()), b64(gzip.compress(f"my key {KEY} ok".encode()))):
            assert any(k == 1 for k, *_ in S.scan_text(f"{before}{code}")[1]), before


def escaped(data):
    yield "url", urllib.parse.quote(data)
    yield "url+", urllib.parse.quote_plus(data)
    yield "url all", "".join(f"%{c:02x}" for c in data)
    yield "bytes", repr(data)
    yield "hex", "".join(f"\\x{c:02x}" for c in data)
    yield "json", json.dumps(data.decode("latin-1"))


@pytest.mark.parametrize("step", [1 << 16, 50])
def test_secret_escaped_contents(monkeypatch, step):
    """Compressed contents whose bytes are escaped, in the text and inside others."""
    monkeypatch.setattr(S, "STEP", step)
    filler = "".join(chr(33 + i * i % 90) for i in range(200))
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress):
        for name, code in escaped(pack(f"{filler} {KEY} {filler}".encode())):
            found = S.scan_text(f"see {code} end")[1]
            assert any(k == 1 and 4 <= a < b <= 5 + len(code) for k, a, b in found), (pack, name)
            assert any(k == 1 for k, *_ in S.scan_text(f"see {b64(gzip.compress(f'a {code} b'.encode()))} end")[1]), (pack, name)
    assert not S.scan_text(repr(gzip.compress(filler.encode())))[1] and not S.scan_text("x%9Cabc BZh91AY%26SY %1f%8b%08 end")[1]


def test_secret_not_quite_utf8():
    raw = b"caf\xe9 \0\1\2 password=hunter22"
    for code in (b64(raw), b64(gzip.compress(raw)), "".join(f"%{c:02X}" for c in raw), r"\ud800" + "".join(f"\\u{c:04x}" for c in raw)):
        assert any(k == 0 for k, *_ in S.scan_text(f"x {code} y")[1]), code


def test_large_contents_are_masked(spark):
    code = base64.b64encode(gzip.compress(b"log line\n" * 1000 + b"password=hunter22")).decode()
    docs = spark.createDataFrame([(1, f"a {code} b")], "doc_id long, text string")
    assert S.redact(docs, limit=1000).first().text == "a [SECRET] b"
    assert S.scan(docs, limit=1000).first().n_large == 1


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from(list("AKIA token=:\"'secret_apikeyſK9f0%2\\u&#;é\n")), max_size=80))
def test_secret_base(text):
    pattern = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    expected = {(0, *m.span()) for m in pattern.finditer(text) if len(m[2]) >= 6}
    expected |= {(1, *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20} | {(2, *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24}
    base, found, _ = S.scan_text(text)
    assert set(base) == expected and expected <= set(found)


def test_scan_finds_what_single_texts_hold(spark):
    """Neighbouring rows don't matter: texts begin and end in letters, and every order gives the spans of each text alone."""
    rng = random.Random(4)
    texts = [f"{KEY} is the key", "a plain text ends here", "0123456789abcdef" * 2, "abc", "deadbeef", "", "password=hunter22", "pass", "word=hunter22", "%41%4b", "Zm9v" * 5, "a%", "41b", None, "é", f"x{KEY}"]
    expected = {t: sorted(S.scan_text(t or "")[1]) for t in texts}
    for _ in range(6):
        rng.shuffle(texts)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
        got = {r.doc_id: sorted((S.KINDS.index(x.kind), x.start, x.end) for x in r.spans) for r in S.scan(docs).collect()}
        assert got == {i: expected[t] for i, t in enumerate(texts)}


@pytest.mark.skipif(not __import__("os").path.isdir(DATA), reason="no test data")
def test_secret_query(spark):
    data = DATA.replace("0.001", "0.01")  # the smallest table has no secrets
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = Q.op4_secrets(spark, data).collect()
    assert len(got) == len(texts) and sum(r.n_access + r.n_assign for r in got) > 0
    join = lambda spans: ",".join(f"{S.KINDS[k]}:{a}:{b}" for k, a, b in spans)
    for r in got:
        base, found, n = S.scan_text(texts[r.doc_id])
        counts = [sum(k == i for k, *_ in base) for i in range(3)]
        assert [r.n_assign, r.n_access, r.n_hex, r.n_large] == [*counts, n]
        assert r.base_sha256 == hashlib.sha256(join(base).encode()).hexdigest()
        assert r.spans == join(sorted(found, key=lambda x: (x[1], x[0], x[2])))


def test_scan_and_redact(spark):
    rows = [(1, f"key {KEY}!", 3), (2, None, 4), (3, "", 5), (4, "plain", 6), (4, "plain", 6), (None, "passwd: hunter22", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = sorted((r.doc_id or 0, [(s.kind, s.start, s.end, s.base) for s in r.spans]) for r in S.scan(docs).collect())
    assert got == [(0, [("assign", 0, 16, True)]), (1, [("access", 4, 24, True)]), (2, []), (3, []), (4, []), (4, [])]
    masked = S.redact(docs)
    assert masked.columns == docs.columns
    assert sorted(tuple(r) for r in masked.collect() if r.doc_id and r.text) == [(1, "key [SECRET]!", 3), (4, "plain", 6), (4, "plain", 6)]
    assert S.redact(docs.filter("doc_id = 99")).count() == 0
