import datetime
import hashlib
import random

import pytest

from tidemark.llm.pii import pseudonymise

KEY = "secret"


def feistel(symbols, radix, kind):
    """The permutation as the docstring describes it, written apart from the operator."""
    s, half = list(symbols), len(symbols) // 2
    for r in range(10):
        first = r % 2 == 0
        other = s[half:] if first else s[:half]
        head = "|".join([KEY, kind, str(r), str(len(s)), ",".join(map(str, other))])
        s = [(x + int(hashlib.sha256(f"{head}|{i}".encode()).hexdigest()[:12], 16)) % radix[i] if (i < half) == first else x for i, x in enumerate(s)]
    return s


def chars(body, kind):
    at = [i for i, c in enumerate(body) if c.isascii() and c.isalnum()]
    if kind == "secret":
        radix, value, back = [16] * len(at), lambda c: int(c, 16), lambda c, v: format(v, "x" if body == body.lower() else "X")
    else:
        radix = [10 if body[i].isdigit() else 26 for i in at]
        value = lambda c: int(c) if c.isdigit() else ord(c) - ord("a" if c.islower() else "A")
        back = lambda c, v: str(v) if c.isdigit() else chr(ord("a" if c.islower() else "A") + v)
    new, out = feistel([value(body[i]) for i in at], radix, kind), list(body)
    for i, v in zip(at, new, strict=True):
        out[i] = back(body[i], v)
    return "".join(out)


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10


def card(digits):
    new = chars(digits[:-1], "card")
    return new + next(c for c in "0123456789" if luhn(new.replace(" ", "").replace("-", "") + c) == 0)


def day(date):
    n = (date - datetime.date(1930, 1, 1)).days
    block, at = divmod(n, 90 * 487)
    a, b = feistel(divmod(at, 487), (90, 487), "date")
    return datetime.date(1930, 1, 1) + datetime.timedelta(block * 90 * 487 + a * 487 + b)


def run(spark, *texts):
    rows = pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), KEY).orderBy("doc_id").collect()
    return [r.text for r in rows], [list(r.pii_kinds) for r in rows]


def test_values_equal_the_plain_permutation(spark):
    draw = random.Random(5)
    number = "".join(draw.choices("0123456789", k=15))
    number += next(c for c in "0123456789" if luhn(number + c) == 0)
    ip = [draw.randrange(256) for _ in range(4)]
    date = datetime.date(1984, 2, 29)
    texts = [
        number, f"{number[:4]} {number[4:8]} {number[8:12]} {number[12:]}", ".".join(map(str, ip)), date.isoformat(), date.strftime("%d.%m.%Y"), "x@y.example.com", "Ab.c9@mail7.example.com",
        "+1 (017) 555-7713", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "123-45-6789",
    ]
    plain = [
        card(number), None, ".".join(map(str, feistel(ip, [256] * 4, "ipv4"))), day(date).isoformat(), day(date).strftime("%d.%m.%Y"), chars("x", "email") + "@y.example.com",
        chars("Ab.c9", "email") + "@mail7.example.com", "+1" + chars(" (017) 555-7713", "phone"), chars(texts[8], "secret"), None,
    ]
    a, g, s = feistel([122, 44, 6788], [898, 99, 9999], "ssn")
    plain[9] = f"{a + 2 if a >= 665 else a + 1:03d}-{g + 1:02d}-{s + 1:04d}"
    plain[1] = " ".join(plain[0][i : i + 4] for i in range(0, 16, 4))
    got, kinds = run(spark, *(f"see {t}, ok" for t in texts))
    assert got == [f"see {p}, ok" for p in plain]
    assert [k[0] for k in kinds] == ["card", "card", "ipv4", "date", "date", "email", "email", "phone", "secret", "ssn"]


def test_invalid_values_and_other_texts_stay(spark):
    texts = ["4111111111111112", "999.1.1.1", "1.2.3.4.5", "1980-02-30", "000-12-3456", "DE00370400440532013000", "version 2.0, 12 of 34", "abc 12345678", "no@where", "é", "12/13/14"]
    got, kinds = run(spark, *texts)
    assert got == texts and not any(kinds)


def test_different_values_stay_different_and_valid(spark):
    dates = [(datetime.date(1930, 1, 1) + datetime.timedelta(i)).isoformat() for i in range(0, 44000, 9)]
    new, _ = run(spark, " ".join(dates), " ".join(reversed(dates)))
    a, b = (x.split(" ") for x in new)
    assert len(set(a)) == len(dates) and a == b[::-1] and all(datetime.date.fromisoformat(x) for x in a)
    cards = [x + next(c for c in "0123456789" if luhn(x + c) == 0) for x in (f"45{i:013d}" for i in range(500))]
    new = run(spark, ",".join(cards))[0][0].split(",")
    assert len(set(new)) == 500 and all(luhn(x) == 0 and len(x) == 16 for x in new)


def test_iban_is_valid_again(spark):
    got, kinds = run(spark, "pay GB82WEST12345698765432 or DE89 3704 0044 0532 0130 00.")
    assert kinds == [["iban", "iban"]]
    for x in (got[0][4:26], got[0][30:57]):
        s = x.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def test_edges(spark, edge, nothing):
    out = pseudonymise(edge, KEY)
    rows = out.collect()
    assert len(rows) == edge.count() and dict(out.dtypes)["n_pii"] == "int" and out.columns.count("n_pii") == 1
    assert {(r.text, r.n_pii) for r in rows if r.doc_id in (1, 2)} == {("", 0), (None, 0)}
    assert pseudonymise(nothing, KEY).isEmpty()


@pytest.mark.parametrize("text", ["4111111111111111" * 3, "@@@@", "1" * 200, "a.b" * 5000 + "@", "+1 " * 2000, "-" * 5000, "9 " * 3000])
def test_no_blow_up(spark, text):
    assert run(spark, text)[0] == [text]


@pytest.mark.parametrize("n", [127, 4000, 500_000])
@pytest.mark.parametrize(
    "head, unit, tail",
    [("x@", "a.", "com"), ("x@", "a-", ".com"), ("x@a", ".b", ""), ("", "x.", "@y.com"), ("", "ab", "@"), ("", "1.", "1"), ("", "12-", "1"), ("+", "1 ", ""), ("+1", " 23", ""), ("GB82", " WEST", ""), ("", "0f", ""), ("", "1/", "1"), ("", "(123) ", "")],
)
def test_long_runs_of_every_repeated_group(spark, head, unit, tail, n):
    text = head + unit * n + tail
    got, _ = run(spark, f"see {text} end")
    assert got[0].startswith("see ") and got[0].endswith(" end") and len(got[0]) == len(text) + 8


def test_domains_have_bounds(spark):
    good, long = "x@" + "a." * 126 + "com", "x@" + "a." * 127 + "com"
    got, kinds = run(spark, good, long, "x@" + "z" * 64 + ".com", "x@y.com.123")
    assert kinds == [["email"], [], [], ["email"]] and got[1] == long and got[0].endswith(good[1:])


@pytest.mark.parametrize("spellings", [("+49 170 1234567", "+491701234567", "+49-170-123-4567"), ("+1 212 555 0123", "+12125550123", "+1.212.555.0123"), ("+420 601 234 567", "+420601234567"), ("+7 495 123 4567", "+74951234567")])
def test_phones_are_linked_whatever_their_separators(spark, spellings):
    got, kinds = run(spark, *spellings)
    plain = {"".join(c for c in g if c.isdigit()) for g in got}
    assert len(plain) == 1 and all(k == ["phone"] for k in kinds) and got[0] != spellings[0]
    assert got[0].startswith(spellings[0].split(" ")[0])
