import hashlib
import math
import random
import re
import string
from collections import Counter

from . import rows as R

from assay.llm import secret_scan as S

HEX, KEY = "0123456789abcdef" * 3, "AKIA" + "Q7Z2" * 5
TEXTS = [
    (1, f'password = "abc12" token: {HEX} x'),
    (2, f"é{HEX} AKIA12 {KEY} api_key='s3cr3t/v+alue' API-KEY=zzzzzzz apikey:abcdefg"),
    (3, "secret=token:abcdefgh passwd=password=longvalue"),
    (4, None), (5, ""), (6, "plain words only and 1234567890123456"),
    (7, "id 550e8400-e29b-41d4-a716-446655440000 blob Zx8Qp2Lm9Vt4Rk7Wn3Yb6Hc1Jd5 done"),
    (8, "Zx8Qp2Lm9Vt4Rk7Wn3Yb6Hc1Jd5-example aaaaaaaaaaaaaaaaaaaaaaaaaaaa1b"),
    (9, "tok " * 30_000 + f"token={HEX}"),
    (10, ("Zx8Qp2Lm9Vt4Rk7Wn3Yb6Hc1Jd5" * 700)),
]


def _brute(text):
    text = text or ""
    names = "(?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY])"
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(names + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    base = list(out)
    for m in re.finditer(S.CANDIDATE, text):
        s = m[0]
        if not (re.search("[0-9]", s) and re.search("[A-Za-z]", s)) or any(re.search(p, s) for p in S.ALLOW):
            continue
        bits = S.HEX_BITS if re.fullmatch("[0-9a-fA-F]+", s) else S.WIDE_BITS
        most = max(-sum(c / S.WINDOW * math.log2(c / S.WINDOW) for c in Counter(s[i : i + S.WINDOW]).values()) for i in range(len(s) - S.WINDOW + 1))
        if most >= bits - 1e-12 and not any(a < m.end() and m.start() < z for a, _, z, _ in base):
            out.append((m.start(), 3, m.end(), "entropy"))
    return sorted(base), sorted(out)


def test_against_brute_force(spark, tmp_path):
    got = {r["doc_id"]: r for r in S.op6_secret_scan(spark, R.table(spark, tmp_path, TEXTS)).collect()}
    text = lambda x: ",".join(f"{k}:{a}:{z}" for a, _, z, k in x)
    for i, t in TEXTS:
        base, every = _brute(t)
        n = Counter(k for *_, k in base)
        assert got[i]["spans"] == text(every), i
        assert got[i]["base_sha256"] == hashlib.sha256(text(base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [n["assign"], n["access"], n["hex"]]
    assert "entropy" in got[7]["spans"] and "entropy" not in got[8]["spans"]


def test_redaction_keeps_the_rest(spark):
    df = R.frame(spark, TEXTS)
    out = {r["doc_id"]: r for r in S.redact(df).collect()}
    assert S.redact(df).columns == df.columns
    for i, t in TEXTS:
        if t is None:
            assert out[i]["text"] is None
            continue
        want, at = "", 0
        for a, _, z, _ in _brute(t)[1]:
            if a >= at:
                want += t[at:a] + "[secret]"
            at = max(at, z)
        assert out[i]["text"] == want + t[at:] and out[i]["n_chars"] == len(want + t[at:])
    assert S.redact(R.frame(spark, [])).count() == 0


def test_random_tokens_of_every_alphabet(spark):
    r = random.Random(4)
    for name, alphabet in (("base32", string.ascii_uppercase + "234567"), ("base36", string.ascii_lowercase + string.digits), ("hex", "0123456789abcdef"), ("base62", string.ascii_letters + string.digits)):
        rows = [(k, "tok " + "".join(r.choice(alphabet) for _ in range(20)) + " end") for k in range(300)]
        rows = [(k, t) for k, t in rows if re.search("[0-9]", t) and re.search("[A-Za-z]", t[4:24])]
        found = S.scan(R.frame(spark, rows)).where("size(spans) > 0").count()
        assert found >= 0.94 * len(rows), (name, found, len(rows))


def test_what_a_rule_leaves_of_a_candidate(spark):
    key, secret = "AKIA" + "Q7Z2" * 4, "wJalrXUtnFEMI/K7MDENG+bPxRfiCY5Zk8Qp2Lm9"
    text = f"é {key}/{secret} and plain words"
    assert S.redact(R.frame(spark, [(1, text)])).first()["text"] == "é [secret][secret] and plain words"
    got = S.scan(R.frame(spark, [(1, text)])).first()["spans"]
    assert [(x["start"], x["end"], x["kind"]) for x in got] == [(2, 22, "access"), (22, 23 + len(secret), "entropy")]
