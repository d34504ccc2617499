"""Format-preserving pseudonyms for personal data, in DataFrame operations only.

Validated values (card numbers by their check digit, IBANs by theirs, addresses of the internet by their octets, social
security numbers by their number ranges, calendar dates, telephone numbers, local parts of mail addresses, hexadecimal
secrets) are replaced by values of the same format.  The replacement is a keyed Feistel permutation over the symbols of
the value, each with the number of choices its place has: digits 10, letters 26, octets 256, days of a period, and so on.
Check digits are computed anew.  So different values stay different, equal values get equal pseudonyms in every
document and whatever their separators, and a permuted value is valid again.  A telephone number keeps its country
code, which its digits tell wherever the separators are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import fresh

ROUNDS = 10

#: The formats, as Java regular expressions; the first that fits at a place counts.  Repeated groups are
#: bounded, as the engine recurses once for each repetition: a domain has at most 127 labels of at most 63 characters, and
#: the part before it at most 64.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}+@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}"
SECRET = r"(?<![\p{L}\p{N}])(?:(?=[0-9]{0,127}[a-f])[0-9a-f]{32,128}|(?=[0-9]{0,127}[A-F])[0-9A-F]{32,128})(?![\p{L}\p{N}])"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
PHONE = r"(?<![\p{L}\p{N}.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[ .-]\d{4}(?![\p{L}\p{N}]|[.-]\d)|(?<![\p{L}\p{N}])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?![\p{L}\p{N}])"
CARD = r"(?<![\p{L}\p{N}.-])(?:\d{13,19}|(?:\d{4}[ -]){3}\d{4}(?:[ -]?\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{4,5})(?![\p{L}\p{N}]|[.-]\d)"
SSN = r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}]|-\d)"
IPV4 = r"(?<![\p{L}\p{N}.])\d{1,3}(?:\.\d{1,3}){3}(?![\p{L}\p{N}]|\.\d)"
DATE = r"(?<![\p{L}\p{N}/.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\p{L}\p{N}]|[/.-]\d)"
ANY = "|".join((EMAIL, SECRET, IBAN, DATE, SSN, IPV4, PHONE, CARD))

#: The country codes of telephone numbers that have one or two digits; the others have three.
CODE = r"^\+(?:[17]|2[ .-]?[07]|3[ .-]?[0-469]|4[ .-]?[013-9]|5[ .-]?[1-8]|6[ .-]?[0-6]|8[ .-]?[1246]|9[ .-]?[0-58]|\d[ .-]?\d[ .-]?\d)"

#: Days of a period within which dates are permuted: 90 * 487 days are 120 years, counted from 1930-01-01.
DAYS = (90, 487)
DAY_0 = "1930-01-01"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def feistel(symbols: Column, radix: Column, secret: str, kind: Column) -> Column:
    """``symbols`` (each below its ``radix``) permuted; arrays of long.  In even rounds the first half (the shorter one)
    is moved by a keyed hash of the second, in odd rounds the second by one of the first; a single symbol is moved by a
    keyed constant."""
    half = F.floor(F.size(symbols) / 2)

    def round_(state: Column, r: Column) -> Column:
        first = (r % 2) == 0
        other = F.when(first, F.slice(state, half + 1, F.size(state) - half)).otherwise(F.slice(state, 1, half))
        seed = F.concat_ws("|", F.lit(secret), kind, r.cast("string"), F.size(state).cast("string"), F.array_join(F.transform(other, lambda x: x.cast("string")), ","))

        def move(x: Column, i: Column) -> Column:
            shift = F.conv(F.substring(F.sha2(F.concat(head, F.lit("|"), i.cast("string")), 256), 1, 12), 16, 10).cast("long")
            return F.when((i < half) == first, (x + shift) % F.get(radix, i)).otherwise(x)

        head = seed
        return F.transform(state, move)

    whole = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), symbols, round_)
    return F.when(F.size(symbols) > 0, whole).otherwise(symbols)


def _code(c: Column) -> Column:
    return F.ascii(c)


def _between(c: Column, low: str, high: str) -> Column:
    return (_code(c) >= ord(low)) & (_code(c) <= ord(high)) & (F.length(c) == F.octet_length(c))


def _radix(c: Column, kind: Column) -> Column:
    """The number of choices a character has; 1 for separators."""
    hexa = kind == "secret"
    return (
        F.when(hexa, F.lit(16))
        .when(_between(c, "0", "9"), F.lit(10))
        .when(_between(c, "a", "z") | _between(c, "A", "Z"), F.lit(26))
        .otherwise(F.lit(1))
        .cast("long")
    )


def _symbol(c: Column, kind: Column) -> Column:
    return (
        F.when(_between(c, "0", "9"), _code(c) - ord("0"))
        .when(kind == "secret", _code(F.lower(c)) - ord("a") + 10)
        .when(_between(c, "a", "z"), _code(c) - ord("a"))
        .otherwise(_code(c) - ord("A"))
        .cast("long")
    )


def _character(c: Column, value: Column, kind: Column) -> Column:
    """The character of ``c``'s class that stands for ``value``."""
    letter = F.when(_between(c, "a", "z"), F.lit("a")).otherwise(F.lit("A"))
    return (
        F.when((kind == "secret"), F.conv(value, 10, 16))
        .when(_between(c, "0", "9"), value.cast("string"))
        .otherwise(F.char(_code(letter) + value))
    )


def _permuted_text(body: Column, kind: Column, secret: str) -> Column:
    """The digits and letters of ``body`` permuted, its other characters in place."""

    def with_chars(chars: Column) -> Column:
        moving = F.filter(chars, lambda c: _radix(c, kind) > 1)
        new = feistel(F.transform(moving, lambda c: _symbol(c, kind)), F.transform(moving, lambda c: _radix(c, kind)), secret, kind)

        def put(both: Column) -> Column:
            def one(c: Column, i: Column) -> Column:
                before = F.size(F.filter(F.slice(chars, 1, i), lambda d: _radix(d, kind) > 1))
                return F.when(_radix(c, kind) > 1, _character(c, F.get(both, before), kind)).otherwise(c)

            return F.array_join(F.transform(chars, one), "")

        return let(new, put)

    plain = let(F.filter(F.split(body, ""), lambda c: c != ""), with_chars)
    return F.when((kind == "secret") & (body == F.lower(body)), F.lower(plain)).otherwise(plain)


def _digits(s: Column) -> Column:
    return F.transform(F.filter(F.split(F.regexp_replace(s, r"\D", ""), ""), lambda c: c != ""), lambda c: c.cast("int"))


def _luhn_sum(s: Column, doubled: int) -> Column:
    """The check sum of the digits; those with an even (``doubled`` 0) or odd number from the right are doubled."""
    return F.aggregate(
        F.transform(F.reverse(_digits(s)), lambda d, i: F.when(i % 2 == doubled, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)),
        F.lit(0),
        lambda a, b: a + b,
    )


def _mod97(s: Column) -> Column:
    """An alphanumeric string as a number modulo 97, letters as 10 to 35."""
    digit = lambda c: F.when(_between(c, "0", "9"), _code(c) - ord("0")).otherwise(_code(c) - ord("A") + 10)
    chars = F.filter(F.split(F.regexp_replace(s, " ", ""), ""), lambda c: c != "")
    return F.aggregate(F.transform(chars, digit), F.lit(0), lambda a, d: F.when(d > 9, a * 100 + d).otherwise(a * 10 + d) % 97)


def _date(m: Column) -> Column:
    """The date that ``m`` writes, or null: year-month-day, else day before month unless only month before day is a date."""
    part = lambda a, b, c: F.try_to_timestamp(F.concat_ws("-", a, F.lpad(b, 2, "0"), F.lpad(c, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
    n = F.split(m, "[-/.]")
    return F.when(m.rlike("^[0-9]{4}-"), part(n[0], n[1], n[2])).otherwise(F.coalesce(part(n[2], n[1], n[0]), part(n[2], n[0], n[1])))


def _month_first(m: Column) -> Column:
    return m.rlike("^[0-9]{1,2}[/.]") & (F.split(m, "[/.]")[1].cast("int") > 12)


def _kind(m: Column) -> Column:
    """What a match is; null if it isn't valid."""
    octets = F.transform(F.split(m, r"\."), lambda o: o.cast("int"))
    ssn = F.transform(F.split(m, "-"), lambda o: o.cast("int"))
    return (
        F.when(m.contains("@"), F.lit("email"))
        .when(m.rlike("^(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})$"), F.lit("secret"))
        .when(m.rlike("^[A-Z]{2}[0-9]{2}"), F.when(_mod97(F.concat(F.substring(F.regexp_replace(m, " ", ""), 5, 64), F.substring(m, 1, 4))) == 1, F.lit("iban")))
        .when(m.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$|^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$|^[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4}$"), F.when(_date(m).isNotNull(), F.lit("date")))
        .when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(~ssn[0].isin(0, 666) & (ssn[0] < 900) & (ssn[1] > 0) & (ssn[2] > 0), F.lit("ssn")))
        .when(m.rlike(r"^[0-9]{1,3}(?:[.][0-9]{1,3}){3}$"), F.when(F.forall(octets, lambda o: o < 256), F.lit("ipv4")))
        .when(m.rlike(r"^[0-9](?:[ -]?[0-9]){12,19}$"), F.when(_luhn_sum(m, 1) % 10 == 0, F.lit("card")))
        .otherwise(F.lit("phone"))
    )


def _numbers(m: Column, kind: Column) -> tuple[Column, Column]:
    """Symbols and radices of the kinds that are numbers rather than characters."""
    day = F.datediff(_date(m), F.lit(DAY_0).cast("date"))
    in_period = F.pmod(day, F.lit(DAYS[0] * DAYS[1]))
    area = F.split(m, "-")[0].cast("long")
    ssn = F.array(F.when(area > 666, area - 2).otherwise(area - 1), F.split(m, "-")[1].cast("long") - 1, F.split(m, "-")[2].cast("long") - 1)
    long_array = lambda *v: F.array(*(F.lit(x).cast("long") for x in v))
    symbols = F.when(kind == "ipv4", F.transform(F.split(m, r"\."), lambda o: o.cast("long"))).when(kind == "ssn", ssn).otherwise(F.array(F.floor(in_period / DAYS[1]), (in_period % DAYS[1]).cast("long")))
    radix = F.when(kind == "ipv4", long_array(256, 256, 256, 256)).when(kind == "ssn", long_array(898, 99, 9999)).otherwise(long_array(*DAYS))
    return symbols, radix


def _written(m: Column, kind: Column, new: Column) -> Column:
    """The permuted numbers in the format of ``m``."""
    area = F.when(new[0] >= 665, new[0] + 2).otherwise(new[0] + 1)
    ssn = F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), F.lpad((new[1] + 1).cast("string"), 2, "0"), F.lpad((new[2] + 1).cast("string"), 4, "0"))
    day = F.datediff(_date(m), F.lit(DAY_0).cast("date"))
    size = DAYS[0] * DAYS[1]
    date = F.date_add(F.lit(DAY_0).cast("date"), (F.floor(day / size) * size + new[0] * DAYS[1] + new[1]).cast("int"))
    d, mon, y = F.date_format(date, "dd"), F.date_format(date, "MM"), F.date_format(date, "yyyy")
    sep = F.when(m.contains("/"), F.lit("/")).otherwise(F.lit("."))
    dates = F.when(m.rlike("^[0-9]{4}-"), F.concat_ws("-", y, mon, d)).when(_month_first(m), F.concat(mon, sep, d, sep, y)).otherwise(F.concat(d, sep, mon, sep, y))
    return F.when(kind == "ipv4", F.array_join(F.transform(new, lambda o: o.cast("string")), ".")).when(kind == "ssn", ssn).otherwise(dates)


def pseudonym(m: Column, kind: Column, secret: str) -> Column:
    """The pseudonym of a valid value."""

    def numbers(_: Column) -> Column:
        symbols, radix = _numbers(m, kind)
        return let(feistel(symbols, radix, secret, kind), lambda new: _written(m, kind, new))

    head = (
        F.when(kind == "phone", F.regexp_extract(m, CODE, 0))
        .when(kind == "iban", F.regexp_extract(m, "^....", 0))
        .otherwise(F.lit(""))
    )
    tail = F.when(kind == "email", F.regexp_extract(m, "@.*$", 0)).when(kind == "card", F.regexp_extract(m, ".$", 0)).otherwise(F.lit(""))

    def text(h: Column) -> Column:
        body = F.substr(m, F.length(h) + 1, F.length(m) - F.length(h) - F.length(tail))

        def close(new: Column) -> Column:
            check = F.pmod(F.lit(10) - _luhn_sum(new, 0) % 10, F.lit(10)).cast("string")
            plain = F.regexp_replace(new, " ", "")
            digits = F.lpad((98 - _mod97(F.concat(plain, F.substring(h, 1, 2), F.lit("00")))).cast("string"), 2, "0")
            return F.when(kind == "card", F.concat(new, check)).when(kind == "iban", F.concat(F.substring(h, 1, 2), digits, new)).otherwise(F.concat(h, new, tail))

        return let(_permuted_text(body, kind, secret), close)

    return F.when(kind.isin("ipv4", "ssn", "date"), let(F.lit(0), numbers)).otherwise(let(head, text))


def pseudonymise(docs: DataFrame, secret: str, column: str = "text", keep: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``column``, and n_pii (values replaced) and pii_kinds (their kinds, in order).

    Values that fail validation, as numbers whose check digit is wrong, stay as they are.  A null text stays null, with
    n_pii 0; an empty one stays empty.  Rows are handled one by one, so repeated rows get equal results.  Columns of
    ``docs`` called n_pii or pii_kinds are replaced, others are kept whatever their names.  With ``keep`` the columns are
    those of ``docs`` alone.
    """
    docs = docs if keep else docs.drop(*[c for c in docs.columns if c.lower() in ("n_pii", "pii_kinds")])
    found, new, kinds = fresh(docs, "found", "new", "kinds")
    text = F.col(f"`{column}`")
    # every format holds a digit or an @
    marked = docs.withColumn(found, F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    marked = marked.withColumn(kinds, F.transform(found, _kind))
    marked = marked.withColumn(new, F.when(F.size(found) > 0, F.zip_with(found, kinds, lambda m, k: F.when(k.isNull(), m).otherwise(pseudonym(m, k, secret)))))
    # a text is its pieces between the matches and the matches in turn
    pieces = F.zip_with(F.split(text, ANY, -1), F.col(new), lambda piece, value: F.concat(piece, F.coalesce(value, F.lit(""))))
    replaced = F.when(F.size(found) > 0, F.array_join(pieces, "")).otherwise(text)
    real = F.filter(kinds, lambda k: k.isNotNull())
    columns = [replaced.alias(c) if c == column else F.col(f"`{c}`") for c in docs.columns]
    if keep:
        return marked.select(*columns)
    return marked.select(*columns, F.coalesce(F.size(real), F.lit(0)).alias("n_pii"), F.coalesce(real, F.array().cast("array<string>")).alias("pii_kinds"))
