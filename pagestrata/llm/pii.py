"""Format-preserving pseudonyms by keyed Feistel permutations, DataFrame functions only.

Validated card numbers, IBANs, IPv4 addresses, telephone numbers, social
security numbers and dates, and e-mail addresses and secrets, are replaced by
values of the same format. Each permutation is one-to-one within its format, so
equal values stay linked across documents and different values stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"

EMAIL = r"(?<![\w.+-])[\w.+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
SECRET = r"(?<!\w)(?i:password|passwd|secret|token|api_?key)\s*[=:]\s*\"?[A-Za-z0-9_\-]{8,}+|(?<!\w)AKIA[A-Z0-9]{16}(?!\w)|(?<!\w)(?:ghp_|sk-)[A-Za-z0-9]{20,}+"
IBAN = r"(?<!\w)[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
IPV4 = r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)"
DATE = r"(?<![\w./-])(?:\d{4}-\d\d-\d\d|\d\d\.\d\d\.\d{4}|\d\d/\d\d/\d{4})(?![\w/-])"
SSN = r"(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-])"
PHONE = r"(?<![\w(])(?:\+?\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{4}(?!\w)|(?<!\w)\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\w)"
CARD = r"(?<![\w-])(?:\d{13,19}|(?:\d{4}[ -]){3}\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])"
# in the order in which they are tried at a place
KINDS = {"email": EMAIL, "secret": SECRET, "iban": IBAN, "ipv4": IPV4, "date": DATE, "ssn": SSN, "phone": PHONE, "card": CARD}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _number(key: str, *parts: Column) -> Column:
    """32 keyed bits from parts, as a long."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), *[p.cast("string") for p in parts]), 256), 1, 8), 16, 10).cast("long")


def permute_text(text: Column, key: str, kind: str, alphabets: tuple[str, ...]) -> Column:
    """A Feistel permutation of strings: in each round every character of one half moves within its alphabet by keyed bits of the other half."""

    def moved(half: Column, other: Column, turn: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            out = c
            for a in reversed(alphabets):
                at = F.instr(F.lit(a), c)
                out = F.when(at > 0, F.substring(F.lit(a), (F.pmod((at - 1).cast("long") + _number(key, F.lit(kind), turn, i, other), F.lit(len(a))) + 1).cast("int"), F.lit(1))).otherwise(out)
            return out

        return F.array_join(F.transform(_chars(half), one), "")

    middle = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), middle).alias("l"), F.substring(text, middle + 1, F.length(text)).alias("r"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda a, t: F.struct(a["r"].alias("l"), moved(a["l"], a["r"], t).alias("r")))
    return F.concat(end["l"], end["r"])


def permute_pair(a: Column, b: Column, many_a: int, many_b: int, key: str, kind: str) -> Column:
    """A Feistel permutation of (a, b) in Z_many_a x Z_many_b: a struct (a, b)."""

    def turn(s: Column, t: Column) -> Column:
        left = F.pmod(s["a"] + _number(key, F.lit(kind), t, F.lit("a"), s["b"]), F.lit(many_a))
        return F.struct(left.alias("a"), F.pmod(s["b"] + _number(key, F.lit(kind), t, F.lit("b"), left), F.lit(many_b)).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), turn)


def _poured(mask: Column, kept: str, value: Column) -> Column:
    """``mask`` with its characters of class ``kept`` replaced in turn by those of ``value``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        return F.when(c.rlike(kept), F.struct(F.concat(s["out"], F.substring(value, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(
            F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))
        )

    return F.aggregate(_chars(mask), start, step)["out"]


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string, whose last digit counts once."""
    twice = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    moved = F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 1, twice(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(moved, F.lit(0), lambda a, x: a + x)


def _bare(x: Column) -> Column:
    return F.regexp_replace(x, "[^A-Za-z0-9]", "")


def card(x: Column, key: str) -> Column:
    """A number with a right Luhn digit becomes another one; others stay."""
    digits = _bare(x)
    body = permute_text(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card", (DIGITS,))
    new = F.concat(body, F.pmod(F.lit(10) - F.pmod(luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string"))
    return F.when(F.pmod(luhn_sum(digits), F.lit(10)) == 0, _poured(x, "[0-9]", new)).otherwise(x)


def mod97(text: Column) -> Column:
    """A string of digits and capitals (A: 10 to Z: 35) as a number modulo 97."""
    value = lambda c: F.instr(F.lit(DIGITS + UPPER), c) - 1
    return F.aggregate(_chars(text), F.lit(0), lambda a, c: F.when(value(c) > 9, F.pmod(a * 100 + value(c), F.lit(97))).otherwise(F.pmod(a * 10 + value(c), F.lit(97))))


def iban(x: Column, key: str) -> Column:
    """An account number with right check digits becomes another of its country; others stay."""
    whole = _bare(x)
    country, body = F.substring(whole, 1, 2), F.substring(whole, F.lit(5), F.length(whole))
    right = mod97(F.concat(body, F.substring(whole, 1, 4))) == 1
    new = permute_text(body, key, "iban", (DIGITS, UPPER))
    check = F.lpad((F.lit(98) - mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    return F.when(right, _poured(x, "[A-Z0-9]", F.concat(country, check, new))).otherwise(x)


def ipv4(x: Column, key: str) -> Column:
    """Four octets up to 255 are permuted as 32 bits; others stay."""
    octets = F.transform(F.split(x, r"\."), lambda o: o.cast("int"))
    packed = F.array_join(F.transform(octets, lambda o: F.lpad(F.lower(F.hex(o)), 2, "0")), "")
    new = permute_text(packed, key, "ipv4", (HEX,))
    back = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(7), F.lit(2)), lambda i: F.conv(F.substring(new, i, F.lit(2)), 16, 10)), ".")
    return F.when(F.forall(octets, lambda o: o <= 255), back).otherwise(x)


def date(x: Column, key: str) -> Column:
    """A real day of 1900 to 2099 becomes another, written alike; others stay."""
    forms = [(r"^\d{4}-", "yyyy-MM-dd"), (r"^\d\d\.", "dd.MM.yyyy"), (r"^\d\d/", "dd/MM/yyyy"), (r"^\d\d/", "MM/dd/yyyy")]
    out = x
    # 73049 days are 17 * 4297
    for pattern, form in reversed(forms):
        day = F.try_to_timestamp(x, F.lit(form)).cast("date")
        n = F.datediff(day, F.lit("1900-01-01").cast("date")).cast("long")
        new = permute_pair(F.floor(n / 4297), F.pmod(n, F.lit(4297)), 17, 4297, key, "date")
        back = F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), (new["a"] * 4297 + new["b"]).cast("int")), form)
        ok = x.rlike(pattern) & day.isNotNull() & n.between(0, 73048) & (F.date_format(day, form) == x)
        out = F.when(ok, back).otherwise(out)
    return out


def ssn(x: Column, key: str) -> Column:
    """Area 001 to 899 without 666, group from 01, serial from 0001; others stay."""
    area, group, serial = F.substring(x, 1, 3).cast("long"), F.substring(x, 5, 2).cast("long"), F.substring(x, 8, 4).cast("long")
    ok = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    new = permute_pair(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")
    new_area = new["a"] + F.when(new["a"] >= 665, 2).otherwise(1)
    three = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return F.when(ok, F.concat_ws("-", three(new_area, 3), three(F.floor(new["b"] / 9999) + 1, 2), three(F.pmod(new["b"], F.lit(9999)) + 1, 4))).otherwise(x)


def phone(x: Column, key: str) -> Column:
    """All digits but a country code's are permuted; 8 to 15 digits make a number, others stay."""
    code = F.regexp_extract(x, r"^\+?\d{1,3}(?=[ .(-])", 0)
    rest = F.substring(x, F.length(code) + 1, F.length(x))
    digits = _bare(rest)
    ok = F.length(_bare(x)).between(8, 15)
    return F.when(ok, F.concat(code, _poured(rest, "[0-9]", permute_text(digits, key, "phone", (DIGITS,))))).otherwise(x)


def email(x: Column, key: str) -> Column:
    """Letters and digits before the last dot are permuted each within its kind."""
    end = F.regexp_extract(x, r"\.[A-Za-z0-9-]+$", 0)
    return F.concat(permute_text(F.substring(x, F.lit(1), F.length(x) - F.length(end)), key, "email", (DIGITS, LOWER, UPPER)), end)


def secret(x: Column, key: str) -> Column:
    """What follows the name or prefix is permuted; hexadecimal values stay hexadecimal."""
    lead = F.regexp_extract(x, r"^(?:AKIA|ghp_|sk-|\w+\s*[=:]\s*\"?)", 0)
    value = F.substring(x, F.length(lead) + 1, F.length(x))
    return F.concat(lead, F.when(value.rlike("^[0-9a-f]+$"), permute_text(value, key, "hex", (HEX,))).otherwise(permute_text(value, key, "secret", (DIGITS, LOWER, UPPER))))


def pseudonym(x: Column, kind: Column, key: str) -> Column:
    rules = {"email": email, "secret": secret, "iban": iban, "ipv4": ipv4, "date": date, "ssn": ssn, "phone": phone, "card": card}
    out = x
    for name in reversed(list(KINDS)):
        out = F.when(kind == name, rules[name](x, key)).otherwise(out)
    return out


def kind_of(x: Column) -> Column:
    """Which kind a match of ANY is: the first whose pattern has it whole."""
    out = F.lit("none")
    for name, pattern in reversed(list(KINDS.items())):
        out = F.when(x.rlike(rf"\A(?:{pattern})\z"), F.lit(name)).otherwise(out)
    return out


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with replaced values in ``text``, ``replaced`` (int) and ``kinds`` (array, the kind of each in order).

    A value that looks like a number or date of a kind but does not validate
    stays; where two kinds match at a place the first of KINDS counts. Null
    texts stay null, with 0 and no kinds; empty ones stay empty. Rows are
    independent, whatever their ids, so repeated rows get equal results, and a
    text of any length is one row's work. An empty table gives an empty table.
    Columns named replaced or kinds are replaced, others pass through, whatever
    their names. The key is a secret of the caller.
    """
    columns = [c for c in docs.columns if c.lower() not in {"replaced", "kinds"}]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    text = F.col("row.text")
    has = text.isNotNull() & text.rlike(ANY)
    values = F.when(has, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    named = F.transform(values, lambda x: F.struct(x.alias("old"), kind_of(x).alias("kind")))
    changed = F.transform("named", lambda s: F.struct(s["old"].alias("old"), s["kind"].alias("kind"), pseudonym(s["old"], s["kind"], key).alias("new")))
    first = packed.withColumn("named", named).withColumn("changed", changed)
    gaps = F.split(text, ANY, -1)
    joined = F.array_join(F.flatten(F.zip_with(gaps, "changed", lambda g, c: F.array(F.coalesce(g, F.lit("")), F.coalesce(c["new"], F.lit(""))))), "")
    real = F.filter("changed", lambda c: c["new"] != c["old"])
    after = [F.when(F.size("changed") > 0, joined).otherwise(text).alias("text") if c == "text" else F.col("row")[c].alias(c) for c in columns]
    return first.select(*after, F.size(real).alias("replaced"), F.transform(real, lambda c: c["kind"]).alias("kinds"))
