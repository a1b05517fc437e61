"""Personal data replaced by format-preserving Feistel pseudonyms, in DataFrame expressions only.

A value that validates (card by Luhn, phone, IPv4 address, social-security number, IBAN by its check
digits, calendar date, e-mail address, credential) is permuted by a keyed Feistel network over the domain
of its format, so equal values stay equal in every document and the form stays valid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Length of an IBAN without its first four characters, by country.
IBAN = {
    11: "NO", 12: "BE", 14: "DK FI FO FK GL NL SD", 15: "MK SI", 16: "AT BA EE KZ LT LU XK MN", 17: "CH HR LI LV", 18: "BG BH CR DE GB GE IE ME RS VA", 19: "AE GI IL IQ OM SO TL",
    20: "AD CZ ES MD PK RO SA SE SK TN VG", 21: "LY PT ST", 22: "IS TR", 23: "BI DJ FR GR IT MC MR SM", 24: "AL AZ BY CY DO GT HN HU LB NI PL", 25: "BR EG PS QA UA", 26: "JO KW MU YE", 27: "MT SC", 28: "LC", 29: "RU",
}
NAMED = "|".join(f"(?:{names.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n}}}" for n, names in IBAN.items())
#: What stands before a credential: its name, then : or = or =>, with quotes and blanks.
NAME = r"(?i:pass(?:word|wd|phrase|code)|pwd|(?:api|access|secret|private|auth|client)[ _-]?(?:key|token|secret)|\btoken|_token|\bsecret)"
CONTEXT = rf"{NAME}[\"']?[ \t]{{0,3}}(?:=>|[:=])[ \t]{{0,3}}[\"']?"
VALUE = r"(?:(?=[^\s\"',;<>(){}]*[0-9])[^\s\"',;<>(){}]{6,}|[^\s\"',;<>(){}]{8,})(?<![.:!?])"
TOKEN = r"\b(?:(?:AKIA|ASIA)[A-Z0-9]{16}\b|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk[-_][A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{30,}|hf_[A-Za-z0-9]{20,})"
PREFIX = r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk[-_]|AIza|hf_)?"
#: The forms that are looked for, in the order in which they are tried.
FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": rf"{TOKEN}|(?<=[:=>][ \t]{{0,3}}[\"']?)(?<={CONTEXT}){VALUE}|(?<=\b(?i:bearer) )[A-Za-z0-9._~+/=-]{{16,}}",
    "iban": rf"\b(?=[A-Z]{{2}}[0-9]{{2}})(?:(?:{NAMED})(?![A-Za-z0-9])|[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}\b)",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-]|\.[0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])|\+[0-9]{1,3}(?:(?:[ .-]?[0-9]{2}){4,6}|(?:[ .-]?[0-9]{2,4}){2,3})(?![0-9])",
}
PATTERN = "|".join(f"(?:{x})" for x in FORMS.values())
DAYS, LOW, HIGH = 72900, 270, 270  # a block of days from 1900-01-01 is LOW * HIGH days long


def _noise(key: str, tweak: Column, i: Column, value: Column) -> Column:
    text = F.concat_ws("|", F.lit(key), tweak, i.cast("string"), value.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def feistel(key: str, tweak: Column, left: Column, right: Column, left_size: Column, right_size: Column) -> Column:
    """struct(l, r): keyed permutation of the pairs 0 <= l < left_size, 0 <= r < right_size."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def turn(at: Column, i: Column) -> Column:
        return F.when(
            i % 2 == 1, F.struct(F.pmod(at["l"] + F.pmod(_noise(key, tweak, i, at["r"]), left_size), left_size).alias("l"), at["r"].alias("r"))
        ).otherwise(F.struct(at["l"].alias("l"), F.pmod(at["r"] + F.pmod(_noise(key, tweak, i, at["l"]), right_size), right_size).alias("r")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _power(base: int, n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(base**k).cast("long") for k in range(11)]), n + 1)


def permute_string(key: str, tweak: Column, text: Column, alphabet: str) -> Column:
    """Keyed permutation of the strings over alphabet of each length, 16 characters at a time, each tweaked by those before."""
    base = len(alphabet)
    symbols = "0123456789abcdefghijklmnopqrstuvwxyz"[:base]
    number = lambda x: F.coalesce(F.conv(F.when(F.length(x) > 0, x).otherwise("0"), base, 10).cast("long"), F.lit(0))
    show = lambda x, k: F.when(k > 0, F.lpad(F.lower(F.conv(x.cast("string"), 10, base)), k, "0")).otherwise("")

    def part_of(at: Column) -> Column:
        """One part, with the length of each half."""
        a, b = at["a"], at["b"]
        mixed = feistel(key, F.concat_ws("|", at["tweak"], (a + b).cast("string"), at["done"]), number(F.substring(at["part"], F.lit(1), a)), number(F.substring(at["part"], a + 1, b)), _power(base, a), _power(base, b))
        return _let(F.struct(mixed.alias("m"), a.alias("a"), b.alias("b")), lambda x: F.concat(show(x["m"]["l"], x["a"]), show(x["m"]["r"], x["b"])))

    def whole(given: Column) -> Column:
        coded = given["coded"]
        pieces = F.sequence(F.lit(0), F.greatest(F.floor((F.length(coded) - 1) / 16), F.lit(0)).cast("int"))

        def piece(done: Column, i: Column) -> Column:
            part = F.substring(coded, i * 16 + 1, F.lit(16))
            sized = _let(part, lambda x: F.struct(x.alias("part"), F.floor(F.length(x) / 2).cast("int").alias("a"), F.ceil(F.length(x) / 2).cast("int").alias("b"), done.alias("done"), given["tweak"].alias("tweak")))
            return F.concat(done, _let(sized, part_of))

        return F.aggregate(pieces, F.lit("").cast("string"), piece)

    given = F.struct(F.translate(text, alphabet, symbols).alias("coded"), tweak.alias("tweak"))
    return F.translate(_let(given, whole), symbols, alphabet)


def _refill(form: Column, symbols: str, values: Column) -> Column:
    """form with its characters out of the regex class symbols replaced in turn by those of values."""
    def at(i: Column) -> Column:
        c = F.substring(form, i, F.lit(1))
        rank = F.length(F.regexp_replace(F.substring(form, F.lit(1), i), F.lit(f"[^{symbols}]"), F.lit("")))
        return F.when(c.rlike(f"[{symbols}]"), F.substring(values, rank, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), at), "")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn_sum(digits: Column, first_doubled: int) -> Column:
    """Luhn sum; counted from the right, places of parity first_doubled are doubled (0: the last is)."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == first_doubled, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0), add)


def _card(key: str, value: Column) -> Column:
    def new(digits: Column) -> Column:
        body = F.concat(F.substring(digits, 1, 1), permute_string(key, F.lit("card"), F.substring(digits, F.lit(2), F.length(digits) - 2), "0123456789"))
        full = _let(body, lambda b: F.concat(b, F.pmod(10 - _luhn_sum(b, 0) % 10, F.lit(10)).cast("string")))
        return F.when(_luhn_sum(digits, 1) % 10 == 0, _let(full, lambda f: _refill(value, "0-9", f))).otherwise(value)

    return _let(_digits(value), new)


def _phone(key: str, value: Column) -> Column:
    def new(digits: Column) -> Column:
        local = F.substring(digits, F.length(digits) - 9, F.lit(10))
        area, exchange, line = (F.substring(local, a, n).cast("long") for a, n in ((1, 3), (4, 3), (7, 4)))
        north = F.length(digits).isin(10, 11) & (area >= 200) & (exchange >= 200) & ((F.length(digits) == 10) | digits.startswith("1"))
        mixed = feistel(key, F.lit("phone"), area - 200, (exchange - 200) * 10000 + line, F.lit(800), F.lit(8_000_000))
        shown = lambda m: F.concat((m["l"] + 200).cast("string"), (F.floor(m["r"] / 10000) + 200).cast("string"), F.lpad((m["r"] % 10000).cast("string"), 4, "0"))
        head = F.substring(digits, F.lit(1), F.length(digits) - 10)
        country = F.length(_digits(F.regexp_extract(value, r"^\+[0-9]{1,3}", 0)))
        abroad = F.concat(F.substring(digits, F.lit(1), country), permute_string(key, F.lit("phone"), F.substring(digits, country + 1, F.length(digits)), "0123456789"))
        return F.when(north, _let(mixed, lambda m: _refill(value, "0-9", F.concat(head, shown(m))))).when(
            value.startswith("+") & F.length(digits).between(8, 15), _let(abroad, lambda a: _refill(value, "0-9", a))
        ).otherwise(value)

    return _let(_digits(value), new)


def _ip(key: str, value: Column) -> Column:
    def new(parts: Column) -> Column:
        o = [F.element_at(parts, k).cast("long") for k in (1, 2, 3, 4)]
        good = (o[0] > 0) & F.forall(parts, lambda x: x.cast("int") <= 255)
        mixed = feistel(key, F.lit("ip"), (o[0] - 1) * 256 + o[1], o[2] * 256 + o[3], F.lit(255 * 256), F.lit(65536))
        shown = lambda m: F.concat_ws(".", *[x.cast("string") for x in (F.floor(m["l"] / 256) + 1, m["l"] % 256, F.floor(m["r"] / 256), m["r"] % 256)])
        return F.when(good, _let(mixed, shown)).otherwise(value)

    return _let(F.split(value, r"\."), new)


def _ssn(key: str, value: Column) -> Column:
    a, b, c = (F.substring(value, s, n).cast("long") for s, n in ((1, 3), (5, 2), (8, 4)))
    good = (a > 0) & (a < 900) & (a != 666) & (b > 0) & (c > 0)
    rank = F.when(a > 666, a - 2).otherwise(a - 1)  # 898 areas
    mixed = feistel(key, F.lit("ssn"), rank, (b - 1) * 9999 + c - 1, F.lit(898), F.lit(99 * 9999))
    area = lambda m: F.when(m["l"] >= 665, m["l"] + 2).otherwise(m["l"] + 1)
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.when(good, _let(mixed, lambda m: F.concat_ws("-", pad(area(m), 3), pad(F.floor(m["r"] / 9999) + 1, 2), pad(m["r"] % 9999 + 1, 4)))).otherwise(value)


def _date(key: str, value: Column) -> Column:
    def shift(day: Column, form: str) -> Column:
        days = F.datediff(day, F.lit("1900-01-01").cast("date"))
        block = F.floor(days / DAYS)
        mixed = feistel(key, F.concat(F.lit("date"), block.cast("string")), F.floor(F.pmod(days, F.lit(DAYS)) / HIGH), F.pmod(days, F.lit(HIGH)), F.lit(LOW), F.lit(HIGH))
        return _let(mixed, lambda m: F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), (block * DAYS + m["l"] * HIGH + m["r"]).cast("int")), form))

    out = value
    for form, shape in (("MM.dd.yyyy", r"\."), ("dd.MM.yyyy", r"\."), ("MM/dd/yyyy", "/"), ("dd/MM/yyyy", "/"), ("yyyy-MM-dd", "-")):
        day = F.try_to_timestamp(value, F.lit(form)).cast("date")
        out = F.when(value.rlike(shape) & day.isNotNull() & (F.year(day) >= 1), shift(day, form)).otherwise(out)
    return out


def _mod97(text: Column) -> Column:
    """Remainder modulo 97 of an IBAN's characters read as a number, letters as 10 to 35."""
    def step(rest: Column, c: Column) -> Column:
        number = F.conv(c, 36, 10).cast("int")
        return F.when(number > 9, (rest * 100 + number) % 97).otherwise((rest * 10 + number) % 97)

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), step)


def _iban(key: str, value: Column) -> Column:
    def new(plain: Column) -> Column:
        country, body = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
        good = _mod97(F.concat(body, F.substring(plain, 1, 4))) == 1
        fresh = _letters_and_digits(key, "iban", body, country)
        made = _let(fresh, lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))
        return F.when(good, _let(made, lambda m: _refill(value, "A-Z0-9", m))).otherwise(value)

    return _let(F.regexp_replace(value, " ", ""), new)


def _letters_and_digits(key: str, name: str, value: Column, tweak: Column) -> Column:
    """Digits, small and capital letters permuted each within their kind; all else stays."""
    def step(symbols: str, alphabet: str):
        return lambda now: kind_of(now, symbols, alphabet)

    def kind_of(now: Column, symbols: str, alphabet: str) -> Column:
        kind = F.regexp_replace(now, F.lit(f"[^{symbols}]"), F.lit(""))
        rest = F.regexp_replace(now, F.lit(f"[{symbols}]"), F.lit("_"))
        new = permute_string(key, F.concat(F.lit(name), tweak, rest), kind, alphabet)
        return _let(F.struct(now.alias("now"), new.alias("new")), lambda x: _refill(x["now"], symbols, x["new"]))

    out = value
    for symbols, alphabet in (("0-9", "0123456789"), ("a-z", "abcdefghijklmnopqrstuvwxyz"), ("A-Z", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")):
        out = _let(out, step(symbols, alphabet))
    return out


def _email(key: str, value: Column) -> Column:
    parts = F.struct(F.regexp_extract(value, "^[^@]*", 0).alias("local"), F.regexp_extract(value, "@.*$", 0).alias("domain"))
    return _let(parts, lambda x: F.concat(_letters_and_digits(key, "email", x["local"], F.lower(x["domain"])), x["domain"]))


def _secret(key: str, value: Column) -> Column:
    rest = F.regexp_replace(value, PREFIX, "")
    new = F.when(rest.rlike("^[0-9a-f]+$"), permute_string(key, F.lit("secret"), rest, "0123456789abcdef")).otherwise(_letters_and_digits(key, "secret", rest, F.lit("")))
    return F.concat(F.regexp_extract(value, PREFIX, 0), new)


def pseudonym(key: str, value: Column, before: Column) -> Column:
    """The pseudonym of one matched value; itself if it doesn't validate. before: the text in front, which may name a credential."""
    named = F.substring(before, -48, 48).rlike(rf"(?:{CONTEXT}|\b(?i:bearer) )$")
    whole = lambda kind: value.rlike(f"^(?:{FORMS[kind]})$")
    return (
        F.when(named | value.rlike(f"^(?:{TOKEN})$"), _secret(key, value))
        .when(whole("email"), _email(key, value))
        .when(value.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), _ip(key, value))
        .when(whole("date"), _date(key, value))
        .when(whole("ssn"), _ssn(key, value))
        .when(whole("iban"), _iban(key, value))
        .when(value.rlike("^[0-9]([ -]?[0-9]){12,18}$"), _card(key, value))
        .when(whole("phone"), _phone(key, value))
        .otherwise(value)
    )


def pseudonymise(docs: DataFrame, key: str = "public-demonstration-key", column: str = "text") -> DataFrame:
    """docs with the personal data in column replaced; all columns and rows stay.

    A null text stays null.  A text without a digit, @, : or = is not searched, as no form but a bearer token can match there.
    Only values that validate change; credentials are named by what stands before them.
    """
    text = F.col(column)
    found = F.regexp_extract_all(text, F.lit(f"({PATTERN})"), F.lit(1))
    gaps = F.split(text, PATTERN, -1)
    swapped = _let(F.struct(gaps.alias("gaps"), found.alias("found")), lambda x: F.concat(
        F.element_at(x["gaps"], 1),
        F.array_join(F.transform(F.sequence(F.lit(1), F.size(x["found"])), lambda i: F.concat(_let(F.element_at(x["found"], i), lambda v: pseudonym(key, v, F.element_at(x["gaps"], i))), F.element_at(x["gaps"], i + 1))), ""),
    ))
    some = text.rlike("[0-9@:=]|(?i:bearer)") & text.rlike(PATTERN)
    return docs.withColumn(column, F.when(F.coalesce(some, F.lit(False)), swapped).otherwise(text))
