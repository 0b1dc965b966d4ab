import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from weirline.llm import secrets

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


PIECES = ["token", "TOKEN", "Secret", "passwd", "password", "api_key", "apikey", "=", ":", " ", '"', "'", "abcdefgh", "AKIA", "AKIAABCDEFGHIJKL", "0123456789abcdef", "f" * 15, "f" * 31, "İ", "ſ", "K", "😀", "é", "\n", "x", ".", "-"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40))
def test_base_spans_equal_plain_patterns(pieces):
    text = "".join(pieces)
    assert [tuple(s) for s in secrets.scan(text, secrets.automaton()) if s.kind < 3] == plain(text)


def test_checksum_decides():
    payload = "a1B2" * 7 + "zz"
    good = "ghp_" + payload + secrets.crc_base62(payload)
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    words = secrets.automaton()
    assert [s.text() for s in secrets.scan(f"é {good}.", words)] == ["github:2:42"]
    assert secrets.scan(bad, words) == [] and secrets.scan(good + "x", words) == []
    assert [s.text() for s in secrets.scan("npm_" + payload + secrets.crc_base62(payload), words)] == ["npm:0:40"]
    assert [s.text() for s in secrets.scan(f"token={good}", words)] == ["assign:0:46", "github:6:46"]


def test_table(spark):
    long = "word " * 50_000 + 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'
    rows = [("s", 1, None, 1), ("s", 2, "", 1), ("s", 3, long, 1), ("s", 3, long, 1), (None, None, "AKIAABCDEFGHIJKL", None)]
    got = secrets.find_secrets(spark.createDataFrame(rows, "spans string, doc_id long, text string, n_hex long")).collect()
    assert len(got) == 5
    by = {r.id: r for r in got}
    assert by[1].spans == "" and by[1].base_sha256 == hashlib.sha256(b"").hexdigest() == by[2].base_sha256
    assert by[3].spans == "assign:250000:250049,hex:250009:250049" and (by[3].n_assign, by[3].n_access, by[3].n_hex) == (1, 0, 1)
    assert by[3].base_sha256 == hashlib.sha256(by[3].spans.encode()).hexdigest() and by[None].n_access == 1
    assert secrets.find_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0
