"""Format-preserving Feistel pseudonyms, with Spark SQL expressions only.

A value is a list of digits in mixed radix: letters, digits, octets, or the parts of a
day number.  A Feistel network over the two halves of the list adds a keyed hash of one
half to the other, place by place, so every value of a format maps to one other of the
same format and equal values stay equal in all documents.  Values are validated first:
card numbers by their check digit, which is made right again afterwards, addresses by
their octets, dates by the calendar.  What is not valid stays as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.functions.names import spare

ROUNDS = 8

#: Patterns of each kind, tried in this order at a place of the text.  Each takes a bounded number of steps from a
#: place, but for the name of an e-mail address, which is tried only where a run of its signs begins, and a secret,
#: which is tried only after its name.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?<=[A-Za-z0-9])@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,30}\.[A-Za-z]{2,63}"
SECRET = r"(?<=(?i:token|secret|password|api_key|apikey)\x20{0,2}[=:]\x20{0,2}[\x22']?)(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![0-9A-Za-z])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-]|\.[0-9])"
IP = r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])"
PHONE = r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9A-Za-z+.-])\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,5}(?![0-9])|(?<![0-9A-Za-z.-])(?:\([0-9]{3}\) |[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9]|[.-][0-9])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
CARD = r"(?<![0-9A-Za-z.-])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3})(?![0-9A-Za-z]|[.-][0-9])"
ANY = "|".join(f"(?:{p})" for p in (EMAIL, SECRET, DATE, IP, SSN, PHONE, CARD))

#: What a text with a value of any kind has: a digit, the sign of an address, or the name of a secret.
MAY = r"[0-9@]|(?i:token|secret|password|api_key|apikey)\x20{0,2}[=:]"

#: Characters that move, within letters of a case and digits; a secret's are hexadecimal.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
HEX = "0123456789abcdef"
#: Days of a whole calendar cycle, 1800-01-01 to 2199-12-31, which are 189 times 773.
CYCLE_START, DAY_RADIX = "1800-01-01", (189, 773)
#: How dates are written; MM/dd is the only reading of slashes.
DATE_FORMS = {"[0-9]{4}-[0-9]{2}-[0-9]{2}": "yyyy-MM-dd", r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}": "dd.MM.yyyy", "[0-9]{2}/[0-9]{2}/[0-9]{4}": "MM/dd/yyyy"}
#: Valid areas of a social security number are 001-665 and 667-899.
SSN_RADIX = (898, 99, 9999)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shifts(key: Column, turn: Column, radix: Column, other: Column, count: Column) -> Column:
    """``count`` numbers below 65536 that depend on the key, the turn, the format and the other half."""
    label = F.concat_ws("|", turn.cast("string"), F.array_join(radix.cast("array<string>"), ","), F.array_join(other.cast("array<string>"), ","))
    # the label is as long as the value, so its digest stands for it in each block
    blocks = let(
        F.sha2(label.cast("binary"), 512),
        lambda tag: F.transform(F.sequence(F.lit(0), F.floor((count - 1) / 32).cast("int")), lambda b: F.sha2(F.concat_ws("\n", key, b.cast("string"), tag, key).cast("binary"), 512)),
    )
    numbers = F.transform(blocks, lambda text: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substr(text, 4 * i + 1, F.lit(4)), 16, 10).cast("int")))
    return F.slice(F.flatten(numbers), F.lit(1), count)


def _added(own: Column, radix: Column, shifts: Column) -> Column:
    return F.transform(own, lambda v, i: F.pmod(v + F.get(shifts, i), F.get(radix, i)).cast("int"))


def feistel(values: Column, radix: Column, key: Column) -> Column:
    """The list of at least two numbers, each below its radix, permuted within its format.

    In a list of one number the key alone shifts it.
    """
    size = F.size(values)
    half = F.floor(size / 2).cast("int")
    left_radix, right_radix = F.slice(radix, F.lit(1), half), F.slice(radix, half + 1, size - half)
    start = F.struct(F.slice(values, F.lit(1), half).alias("own"), F.slice(values, half + 1, size - half).alias("other"))

    def turn(state: Column, k: Column) -> Column:
        # the halves change places after each turn
        own_radix = F.when(k % 2 == 1, left_radix).otherwise(right_radix)
        shifts = _shifts(key, k, radix, state["other"], F.size(state["own"]))
        added = let(own_radix, lambda r: let(shifts, lambda s: _added(state["own"], r, s)))
        return F.struct(state["other"].alias("own"), added.alias("other"))

    mixed = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["own"], s["other"]))
    alone = let(_shifts(key, F.lit(0), radix, F.array().cast("array<int>"), size), lambda s: _added(values, radix, s))
    return F.when(size < 2, alone).otherwise(mixed)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _luhn(digits: Column) -> Column:
    """Check sum of a string of digits, the last one counting single."""
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    parts = F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(doubled(c.cast("int"))))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x)


def kind_of(found: Column) -> Column:
    """Kind of a found value; null if it fails validation."""
    octet = lambda p: (p.cast("int") < 256) & ((F.length(p) == 1) | ~p.startswith("0"))
    ssn = ~found.rlike("^(?:000|666|9)") & ~found.rlike("-00-|-0000$")
    return (
        F.when(found.contains("@"), "email")
        .when(found.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$"), "secret")
        .when(found.rlike(f"^(?:{'|'.join(DATE_FORMS)})$"), F.when(_day(found).between(0, DAY_RADIX[0] * DAY_RADIX[1] - 1), "date"))
        .when(found.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"), F.when(F.forall(F.split(found, r"\."), octet), "ip"))
        .when(found.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(ssn, "ssn"))
        .when(found.rlike("^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})$"), F.when(_luhn(F.regexp_replace(found, "[ -]", "")) % 10 == 0, "card"))
        .otherwise("phone")
    )


def _form(found: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, form in DATE_FORMS.items():
        out = F.when(found.rlike(f"^{pattern}$"), form).otherwise(out)
    return out


def _day(found: Column) -> Column:
    """Days since the start of the cycle; null for a day that no calendar has."""
    day = F.coalesce(*(F.when(found.rlike(f"^{p}$"), F.try_to_timestamp(found, F.lit(form))) for p, form in DATE_FORMS.items()))
    return F.datediff(day.cast("date"), F.lit(CYCLE_START).cast("date"))


def _moving(found: Column, kind: Column) -> Column:
    """The characters of which a value's numbers are made: not a domain, a country code or a check digit."""
    return (
        F.when(kind == "email", F.substring_index(found, "@", 1))
        .when(kind == "card", F.regexp_replace(F.regexp_replace(found, "[ -]", ""), ".$", ""))
        .when(kind == "phone", F.regexp_replace(found, r"^\+[0-9]{1,3}[ .-]", ""))
        .otherwise(found)
    )


def _numbers(found: Column, kind: Column, moving: Column) -> Column:
    """Numbers and their radix: one of each character, or of the parts of an address, a day or a registration.

    A character that does not move is a 0 of radix 1.
    """
    place = lambda c: F.instr(F.lit(ALPHABET), c) - 1
    pair = lambda v, r: F.struct(v.cast("int").alias("v"), r.cast("int").alias("r"))
    chars = F.transform(
        _chars(moving),
        lambda c: F.when(kind == "secret", pair(F.instr(F.lit(HEX), F.lower(c)) - 1, F.lit(16)))
        .when(place(c) < 0, pair(F.lit(0), F.lit(1)))
        .when(place(c) < 52, pair(place(c) % 26, F.lit(26)))
        .otherwise(pair(place(c) - 52, F.lit(10))),
    )
    octets = F.transform(F.split(found, r"\."), lambda p: pair(p, F.lit(256)))
    area = F.substr(found, F.lit(1), F.lit(3)).cast("int")
    day = let(_day(found), lambda n: F.array(pair(F.floor(n / DAY_RADIX[1]), F.lit(DAY_RADIX[0])), pair(n % DAY_RADIX[1], F.lit(DAY_RADIX[1]))))
    parts = (area - F.when(area > 666, 2).otherwise(1), F.substr(found, F.lit(5), F.lit(2)).cast("int") - 1, F.substr(found, F.lit(8), F.lit(4)).cast("int") - 1)
    ssn = F.array(*(pair(p, F.lit(r)) for p, r in zip(parts, SSN_RADIX)))
    return F.when(kind == "ip", octets).when(kind == "date", day).when(kind == "ssn", ssn).otherwise(chars)


def _written(found: Column, kind: Column, moving: Column, radix: Column, new: Column) -> Column:
    """The new numbers in the format of the value."""

    def sign(c: Column, i: Column) -> Column:
        at = F.get(new, i) + 1
        start = F.when(F.get(radix, i) == 10, 52).when(c.rlike("[A-Z]"), 26).otherwise(0)
        return F.when(kind == "secret", F.substr(F.lit(HEX), at, F.lit(1))).when(F.get(radix, i) == 1, c).otherwise(F.substr(F.lit(ALPHABET), start + at, F.lit(1)))

    text = F.array_join(F.transform(_chars(moving), sign), "")
    n = lambda k: F.get(new, F.lit(k))
    pad = lambda c, k: F.lpad(c.cast("string"), k, "0")
    day = F.date_add(F.lit(CYCLE_START).cast("date"), n(0) * DAY_RADIX[1] + n(1))
    date = F.coalesce(*(F.when(_form(found) == form, F.date_format(day, form)) for form in DATE_FORMS.values()))
    ssn = F.concat_ws("-", pad(n(0) + F.when(n(0) >= 665, 2).otherwise(1), 3), pad(n(1) + 1, 2), pad(n(2) + 1, 4))
    card = let(text, lambda t: F.concat(t, F.pmod(-_luhn(F.concat(t, F.lit("0"))), F.lit(10)).cast("string")))
    card = F.when(found.rlike("[ -]"), let(card, lambda t: F.regexp_replace(t, "(....)(?=.)", F.concat(F.lit("$1"), F.substr(found, F.lit(5), F.lit(1)))))).otherwise(card)
    return (
        F.when(kind == "email", F.concat(text, F.lit("@"), F.substring_index(found, "@", -1)))
        .when(kind == "phone", F.concat(F.regexp_extract(found, r"^(?:\+[0-9]{1,3}[ .-])?", 0), text))
        .when(kind == "card", card)
        .when(kind == "ip", F.array_join(new.cast("array<string>"), "."))
        .when(kind == "date", date)
        .when(kind == "ssn", ssn)
        .when(found.rlike("[A-F]"), F.upper(text))
        .otherwise(text)
    )


def pseudonym(found: Column, key: str) -> Column:
    """Kind of a found value and its pseudonym in its own format; both null if it is not valid."""

    def whole(kind: Column) -> Column:
        keyed = F.concat_ws("|", F.lit(key), kind)

        def moved(x: Column) -> Column:
            written = lambda new: _written(found, kind, x["moving"], x["r"], new)
            return let(feistel(x["v"], x["r"], keyed), written)

        # both lists are made once: a field of an array of structs is a new array wherever it is named
        both = lambda m: let(_numbers(found, kind, m), lambda n: F.struct(m.alias("moving"), n["v"].alias("v"), n["r"].alias("r")))
        start = let(_moving(found, kind), both)
        return F.struct(kind.alias("kind"), F.when(kind.isNotNull(), let(start, moved)).alias("pseudonym"))

    return let(kind_of(found), whole)


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with the personal values of ``text`` replaced, and a column ``pii`` of what was replaced.

    ``pii`` lists ``kind`` and ``pseudonym`` of each value in the order of the text (a
    column of that name is replaced).  E-mail addresses keep their domain, of up to 32
    labels; values that fail validation stay.  A null text stays null, with an empty list.
    Row by row, with SQL expressions only: no shuffle, steps in proportion to the text,
    and all other columns, whatever their names, and repeated rows are kept.
    """
    found, gaps, new = spare(docs.columns, "_found", "_gaps", "_new")
    whole = F.col(text)
    none = F.array().cast("array<string>")
    may = whole.rlike(MAY)
    marked = docs.withColumns(
        {
            found: F.when(may, F.regexp_extract_all(whole, F.lit(ANY), F.lit(0))).otherwise(none),
            gaps: F.when(may, F.split(whole, ANY, -1)).otherwise(F.array(whole)),
        }
    )
    empty = F.array().cast("array<struct<kind:string,pseudonym:string>>")
    marked = marked.withColumn(new, F.when(F.size(found) > 0, F.transform(found, lambda m: pseudonym(m, key))).otherwise(empty))
    texts = F.zip_with(found, new, lambda old, n: F.coalesce(n["pseudonym"], old))
    joined = F.array_join(F.flatten(F.zip_with(gaps, texts, lambda g, n: F.array(g, F.coalesce(n, F.lit(""))))), "")
    listed = F.filter(new, lambda n: n["kind"].isNotNull())
    return marked.withColumns({text: F.when(F.size(found) > 0, joined).otherwise(whole), "pii": listed}).drop(found, gaps, new)
