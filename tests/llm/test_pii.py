import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lumaveil.llm import pii as P


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def brute(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and luhn(d) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


@given(st.text(alphabet="a.@-0125 +(x)😀", max_size=60))
@settings(max_examples=1500, deadline=None)
def test_base_equals_the_patterns(text):
    assert P.base_spans(text) == brute(text)


def test_checks_and_context():
    kinds = lambda t: [t[a:b] for k, a, b, _ in P.spans(t) if k not in P.BASE]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 32 ok") == ["GB82 WEST 1234 5698 7654 32"]
    assert kinds("IBAN GB83 WEST 1234 5698 7654 32") == []
    assert kinds("social security 123-45-6789") == ["123-45-6789"] and kinds("order 123-45-6789") == []
    assert kinds("call (415) 555-0132 now") == ["(415) 555-0132"] and kinds("part 415-555-0132") == []
    assert kinds('token = "dafbac99949115180e7593de87b4492bcef9890b"') == ["dafbac99949115180e7593de87b4492bcef9890b"]
    assert P.mask("mail a.b@c.de, 4111 1111 1111 1111!") == "mail [EMAIL], [CARD]!"
    assert P.mask("nothing here 12") == "nothing here 12"


def test_long_texts_take_linear_time():
    for t in ("1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" * 150_000, "x" * 300_000 + "@", "1 " * 150_000, "AB12" * 75_000, "token=" + "a1" * 150_000):
        P.spans(t)


def test_query(spark):
    rng = random.Random(1)
    bits = ["me@mail.example.com", "10.0.0.255", "256.1.1.1", "4111111111111111", "4111-1111-1111-1111", "+1 (407) 555-7710", "😀", "word", "é", "1.2.3.4.5.6.7.8"]
    rows = [(i, " ".join(rng.choices(bits, k=rng.randint(1, 30))), "x") for i in range(100)] + [(200, None, ""), (201, "", None), (None, "a@b.cd", ""), (1, "a@b.cd", "")]
    got = P.op4(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    want = []
    for d, t, _ in rows:
        b = brute(t or "")
        n = [sum(k == kind for k, _, _ in b) for kind in P.BASE]
        want.append((d, *n, hashlib.sha256(",".join(f"{k}:{a}:{e}" for k, a, e in b).encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    assert all(hashlib.sha256(",".join(s for s in r.spans.split(",") if s.split(":")[0] in P.BASE).encode()).hexdigest() == r.base_sha256 for r in got)
    assert P.op4(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_redact_keeps_rows(spark):
    df = spark.createDataFrame([(1, "a@b.cd x", 8, "k"), (2, None, 0, None), (2, "", 0, None)], "doc_id long, text string, n_chars long, pii string")
    out = P.redact(df)
    assert out.dtypes == df.dtypes
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "[EMAIL] x", 9, "k"), (2, None, 0, None), (2, "", 0, None)], key=str)


def test_long_secrets():
    for n in (200, 201, 600):
        value = "eyJhbGciOi1" * 60
        assert P.mask(f"token={value[:n]} end") == "token=[SECRET] end", n
    assert P.mask("token=a1") == "token=a1"
