"""Format-preserving Feistel pseudonyms for personal data, in DataFrame functions only.

Candidates are found by one pattern, in which an IBAN has the length and a phone
number the digits of its country, so that what follows is not taken in. They are
validated by their own rule (Luhn, mod 97,
calendar, octets, ...) and keyed-permuted within their format, so equal values
get equal pseudonyms in all documents and every pseudonym is valid again:

  card    the digits after the scheme's two are permuted, the Luhn digit is computed anew
  iban    the account characters are permuted, the check digits computed anew
  phone   the last ten digits are permuted (country code and layout stay)
  ssn     permuted among the numbers that may be issued
  ip      permuted among all IPv4 addresses
  date    permuted among the days of 1700-2099 (yyyy-mm-dd, dd.mm.yyyy, dd/mm/yyyy)
  email   the local part's letters and digits are permuted, the domain stays
  secret  a long hex string after token/key/password: its hex digits are permuted

A permutation is a Feistel network of eight rounds whose round function is
SHA-256 over key, kind, round and the other half. Layout, letter case and
separators stay; halves are hashed in lower case, so spellings stay linked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertspark.functions.arrays import let

ROUNDS = 8
KINDS = ("email", "iban", "date", "ssn", "phone", "ip", "card", "secret")

_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
# Lengths of the countries' IBANs (registry of SWIFT).
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ DZ ES MD PK RO SA SE SK TN VG YE",
    25: "AO CV LY MZ PT ST", 26: "IR IS TR", 27: "BF BI CF CG CM DJ FR GA GQ GR IT KM MC MG ML MR SM",
    28: "AL AZ BJ BY CI CY DO GT GW HN HU LB MA NE NI PL SN SV TD TG", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Digits after the country code, most first (all codes are free of prefixes of each other).
_PHONE_DIGITS = {
    (10, 10): "1 7 30 52 57 63 90 91 92", (9, 9): "27 31 33 34 41 48 51 56 61 94 212 213 251 254 255 256 351 375 380 420 421 593 598 995",
    (8, 8): "45 47 65 216 370 371 386 502 503 504 505 506 507 852 853 965 968 973 974", (9, 10): "20 44 58 81 84 98", (10, 11): "54 55 86", (8, 9): "32 36 40 66 353 354 357 359 385 886 961 962 966 971 972 977",
    (8, 10): "60 64 82 234 880", (7, 9): "46 352 381 387 389", (7, 8): "372 356 374 591", (6, 11): "39 49", (7, 12): "43 62 358",
}


def _iban(length: int, countries: str) -> str:
    fours, rest = divmod(length - 4, 4)
    return rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}" + (rf" ?[A-Z0-9]{{{rest}}}" if rest else "")


def _phone(least: int, most: int, codes: str) -> str:
    return rf"(?:{codes.replace(' ', '|')})(?:[ .-]?[0-9]){{{least},{most}}}"


_KNOWN_IBAN, _KNOWN_PHONE = ("|".join(" ".join(x.values()).split()) for x in (_IBAN_LENGTHS, _PHONE_DIGITS))
_NUMBERS = {
    "iban": r"(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(_iban(*x) for x in _IBAN_LENGTHS.items()) + rf"|(?!{_KNOWN_IBAN})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)",
    "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "phone": r"\+[0-9]{1,3}[ .-]?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+(?:" + "|".join(_phone(*n, c) for n, c in _PHONE_DIGITS.items()) + rf"|(?!{_KNOWN_PHONE})[0-9](?:[ .-]?[0-9]){{7,14}})(?<![ .-][0-9])(?![0-9])|[0-9]{{3}}[.-][0-9]{{3}}[.-][0-9]{{4}}",
    "ip": r"(?<![0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.[0-9])",
    "card": r"[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){2} [0-9]{1,7}|[0-9]{4}(?:-[0-9]{4}){2}-[0-9]{1,7}",
    "secret": r"[0-9a-f]{32,64}|[0-9A-F]{32,64}",
}
#: Any candidate; numbers neither touch a letter nor a digit.
PATTERN = _EMAIL + r"|(?<![0-9A-Za-z])(?:" + "|".join(_NUMBERS.values()) + r")(?![0-9A-Za-z])"
_SECRET_BEFORE = r"""(?i)(?:token|secret|key|password|passwd|pwd)["']?\s{0,3}[:=]\s{0,3}["']?$"""
_FIRST_DAY, _DAYS = "1700-01-01", (189, 773)  # 189 * 773 days are the 400 years to 2099-12-31


def _hash(key: str, kind: str, round_: Column, other: Column) -> Column:
    inner = F.sha2(F.concat(F.lit(f"{key}|{kind}|"), round_.cast("string"), F.lit("|"), other).cast("binary"), 256)
    return F.sha2(F.concat(F.lit(f"{key}|"), inner).cast("binary"), 256)


def _number(hexits: Column) -> Column:
    return F.conv(hexits, 16, 10).cast("long")


def permuted_number(x: Column, a: int, b: int, key: str, kind: str) -> Column:
    """Feistel permutation of 0 .. a*b-1: x = l*b + r, the halves are shifted in turn by a hash of the other."""
    start = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).cast("long").alias("r"))

    def step(s: Column, i: Column) -> Column:
        left = i % 2 == 0
        h = _number(F.substring(_hash(key, kind, i, F.when(left, s["r"]).otherwise(s["l"]).cast("string")), 1, 15))
        return F.struct(F.when(left, (s["l"] + h % a) % a).otherwise(s["l"]).alias("l"), F.when(left, s["r"]).otherwise((s["r"] + h % b) % b).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * b + s["r"])


def _shifted(s: Column, by: Column, hexits: bool) -> Column:
    """Every letter and digit of ``s`` moved on within its kind by the next four hex digits of ``by``."""

    def one(j: Column) -> Column:
        return let(
            F.struct(F.substr(s, j, F.lit(1)).alias("c"), _number(F.substr(by, F.pmod(j - 1, F.lit(16)) * 4 + 1, F.lit(4))).alias("n")),
            lambda p: _moved(p["c"], p["n"], hexits),
        )

    return F.when(F.length(s) == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), one), ""))


def _moved(c: Column, n: Column, hexits: bool) -> Column:
    if hexits:
        at = F.pmod(F.position(F.lower(c), F.lit("0123456789abcdef")) - 1 + n, F.lit(16))
        new = F.substr(F.lit("0123456789abcdef"), (at + 1).cast("int"), F.lit(1))
        return F.when(c.rlike("[A-F]"), F.upper(new)).otherwise(new)
    turn = lambda first, size: F.chr((F.pmod(F.ascii(c) - first + n, F.lit(size)) + first).cast("long"))
    return F.when(c.rlike("[0-9]"), turn(48, 10)).when(c.rlike("[a-z]"), turn(97, 26)).when(c.rlike("[A-Z]"), turn(65, 26)).otherwise(c)


def permuted_string(s: Column, key: str, kind: str, hexits: bool = False) -> Column:
    """Feistel permutation of the strings with the layout of ``s``: each place keeps its kind (digit, lower, upper, other)."""
    half = lambda v: F.floor(F.length(v) / 2).cast("int")

    def run(v: Column) -> Column:
        start = F.struct(F.substr(v, F.lit(1), half(v)).alias("l"), F.substr(v, half(v) + 1, F.length(v)).alias("r"))
        step = lambda s, i: F.struct(s["r"].alias("l"), let(_hash(key, kind, i, F.lower(s["r"])), lambda h: _shifted(s["l"], h, hexits)).alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["l"], s["r"]))

    return let(s, run)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _refilled(layout: Column, chars: Column, of: str) -> Column:
    """``layout`` with its characters of the class ``of`` replaced, in order, by those of ``chars``."""
    return let(F.struct(layout.alias("m"), chars.alias("d")), lambda p: _refill_struct(p, of))


def _refill_struct(p: Column, of: str) -> Column:
    def one(j: Column) -> Column:
        c = F.substr(p["m"], j, F.lit(1))
        nth = F.length(F.regexp_replace(F.substr(p["m"], F.lit(1), j), f"[^{of}]", ""))
        return F.when(c.rlike(f"[{of}]"), F.substr(p["d"], nth, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(p["m"])), one), "")


def _luhn_sum(payload: Column) -> Column:
    """Luhn sum of the digits before the check digit."""

    def add(s: Column, j: Column) -> Column:
        d = F.ascii(F.substr(payload, F.length(payload) - j, F.lit(1))) - 48
        return s + F.when(j % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(0), F.length(payload) - 1), F.lit(0), add)


def _luhn_digit(payload: Column) -> Column:
    return F.pmod(10 - F.pmod(_luhn_sum(payload), F.lit(10)), F.lit(10)).cast("string")


def _mod97(s: Column) -> Column:
    """The IBAN remainder: letters count as 10 to 35."""

    def add(r: Column, j: Column) -> Column:
        c = F.ascii(F.substr(s, j, F.lit(1)))
        return F.when(c >= 65, (r * 100 + c - 55) % 97).otherwise((r * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), add)


def _day(m: Column) -> Column:
    """The date that a string states, null when there is none."""
    parts = lambda d, mo: F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, mo, 2), F.substring(m, d, 2)).try_cast("date")
    return F.when(m.rlike("^[0-9]{4}-"), m.try_cast("date")).otherwise(F.coalesce(parts(1, 4), parts(4, 1)))


def _day_number(m: Column) -> Column:
    return F.datediff(_day(m), F.lit(_FIRST_DAY).cast("date"))


def _new_date(m: Column, key: str) -> Column:
    day = F.date_add(F.lit(_FIRST_DAY).cast("date"), permuted_number(_day_number(m).cast("long"), *_DAYS, key, "date").cast("int"))
    sep = F.substring(m, 3, 1)
    swapped = F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2)).try_cast("date").isNull()
    part = lambda f: F.date_format(day, f)
    iso, dmy, mdy = part("yyyy-MM-dd"), F.concat_ws("", part("dd"), sep, part("MM"), sep, part("yyyy")), F.concat_ws("", part("MM"), sep, part("dd"), sep, part("yyyy"))
    return F.when(m.rlike("^[0-9]{4}-"), iso).when(swapped, mdy).otherwise(dmy)


def _octets(m: Column) -> Column:
    return F.transform(F.split(m, r"\."), lambda o: o.cast("long"))


def _new_ip(m: Column, key: str) -> Column:
    n = F.aggregate(_octets(m), F.lit(0).cast("long"), lambda s, o: s * 256 + o)
    return let(
        permuted_number(n, 1 << 16, 1 << 16, key, "ip"),
        lambda x: F.concat_ws(".", *[F.pmod(F.shiftright(x, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]),
    )


def _new_ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    index = ((area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1) * 9999 + serial - 1

    def back(x: Column) -> Column:
        s, g, a = x % 9999 + 1, F.floor(x / 9999) % 99 + 1, F.floor(x / (9999 * 99)) + 1
        a = F.when(a >= 666, a + 1).otherwise(a)
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad(g.cast("string"), 2, "0"), F.lpad(s.cast("string"), 4, "0"))

    return let(permuted_number(index, 898 * 99, 9999, key, "ssn"), back)


def _kind(m: Column, before: Column) -> Column:
    """The kind of a candidate that is valid, else null."""
    is_ = lambda k: m.rlike(f"^(?:{_NUMBERS[k]})$")
    plain = F.regexp_replace(m, " ", "")
    d = _digits(m)
    return (
        F.when(m.contains("@"), "email")
        .when(is_("secret") & m.rlike("^[0-9a-fA-F]{32,}$"), F.when(before.rlike(_SECRET_BEFORE), "secret"))
        .when(is_("iban"), F.when(F.length(plain).between(15, 34) & (_mod97(F.concat(F.substr(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1), "iban"))
        .when(is_("date"), F.when(_day_number(m).between(0, _DAYS[0] * _DAYS[1] - 1), "date"))
        .when(is_("ssn"), F.when(~m.rlike("^(?:000|666|9..)-|-00-|-0000$"), "ssn"))
        .when(is_("phone"), F.when(F.length(d).between(8, 15), "phone"))
        .when(is_("ip"), F.when(F.forall(_octets(m), lambda o: o <= 255), "ip"))
        .when(is_("card"), F.when(F.length(d).between(13, 19) & d.rlike("^(?:2[2-7]|[3-6])") & (_luhn_digit(F.substr(d, F.lit(1), F.length(d) - 1)) == F.right(d, F.lit(1))), "card"))
    )


def _pseudonym(m: Column, kind: Column, key: str) -> Column:
    d, plain = _digits(m), F.regexp_replace(m, " ", "")
    payload = F.concat(F.substr(d, F.lit(1), F.lit(2)), permuted_string(F.substr(d, F.lit(3), F.length(d) - 3), key, "card"))
    card = let(payload, lambda p: F.concat(p, _luhn_digit(p)))
    cut = F.greatest(F.length(d) - 10, F.lit(0))
    phone = F.concat(F.substr(d, F.lit(1), cut), permuted_string(F.substr(d, cut + 1, F.lit(10)), key, "phone"))
    country = F.substring(plain, 1, 2)
    iban = let(
        permuted_string(F.substr(plain, F.lit(5), F.length(plain)), key, "iban"),
        lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b),
    )
    at = F.instr(m, "@")
    return (
        F.when(kind == "email", F.concat(permuted_string(F.substr(m, F.lit(1), at - 1), key, "email"), F.substr(m, at, F.length(m))))
        .when(kind == "card", _refilled(m, card, "0-9"))
        .when(kind == "phone", _refilled(m, phone, "0-9"))
        .when(kind == "iban", _refilled(m, iban, "A-Z0-9"))
        .when(kind == "ip", _new_ip(m, key))
        .when(kind == "date", _new_date(m, key))
        .when(kind == "ssn", _new_ssn(m, key))
        .when(kind == "secret", permuted_string(m, key, "secret", hexits=True))
        .otherwise(m)
    )


def pseudonymised(text: Column, key: str) -> Column:
    """struct(text, kinds): the text with every valid candidate replaced, and the kinds in order of place; null for null."""

    def run(p: Column) -> Column:
        marked = F.transform(p["found"], lambda m, i: F.struct(m.alias("m"), _kind(m, F.get(p["gaps"], i)).alias("kind")))
        return let(
            F.struct(p["gaps"].alias("gaps"), marked.alias("marked")),
            lambda q: F.struct(
                F.array_join(
                    F.transform(q["gaps"], lambda g, i: F.concat(g, F.coalesce(let(F.get(q["marked"], i), lambda x: _pseudonym(x["m"], x["kind"], key)), F.lit("")))), ""
                ).alias("text"),
                F.filter(F.transform(q["marked"], lambda x: x["kind"]), lambda k: k.isNotNull()).alias("kinds"),
            ),
        )

    none = F.array().cast("array<string>")
    replaced = let(F.struct(F.split(text, PATTERN, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)).alias("found")), run)
    return F.when(text.rlike("[0-9@]"), replaced).when(text.isNotNull(), F.struct(text.alias("text"), none.alias("kinds")))


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Replace the personal data of every whole text.

    One row per input row: id, text (with pseudonyms), n_<kind> for every kind,
    changed. A null text stays null with counts of 0 and changed false, an empty
    text stays empty. Repeated rows give repeated results, a null id stays null,
    other columns are not read. No shuffle, no Python on the executors.
    """
    if not key:
        raise ValueError("a key is needed: without one anybody can undo the permutation")
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"), pseudonymised(F.col(text_col), key).alias("_p"))
    kinds = F.coalesce(F.col("_p.kinds"), F.array().cast("array<string>"))
    count = lambda k: F.size(F.filter(kinds, lambda x: x == k)).cast("long").alias(f"n_{k}")
    return rows.select(id_col, F.col("_p.text").alias(text_col), *[count(k) for k in KINDS], (F.size(kinds) > 0).alias("changed"))
