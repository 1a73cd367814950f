"""PII: format-preserving Feistel pseudonyms. Native.

Validated values are replaced by a keyed permutation of their own format, so equal values stay linked
across documents and no two values merge:

  e-mail local parts        letters and digits, class by class; the domain stays
  phone numbers             all digits after the country code; separators stay; North American ones with or
                            without +1, others of 8-15 digits after a +
  payment cards             Luhn-valid 13-19 digits, unbroken or in groups of 4 or of 4-6-5 and 4-6-4; first
                            digit stays, check digit is recomputed
  social security numbers   valid ddd-dd-dddd; walked on until valid again
  IPv4 addresses            the 32-bit number
  dates                     valid, 1920-01-01 to 2099-06-06 (65,536 days), in the written layout
  access keys, tokens       AKIA + 16, and 16 characters or more after token=, secret=, api_key=, password=: letters
                            and digits move, in blocks of 64; of _+/=.~- each stays

Cases: a null text stays null with 0 pseudonyms; an empty text stays empty; a document without values is
returned byte for byte; rows and ids pass through as they are, repeated or null; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
EMAIL = r"(?<![\p{L}0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+)+"
KEY = r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
TOKEN = r"(?<![\p{L}])(?i:token|secret|api_key|apikey|password) ?[=:] ?[\"']?(?:(?=[A-Za-z_+/=.~-]*[0-9])[A-Za-z0-9][A-Za-z0-9_+/=.~-]{15,}+|[A-Za-z0-9]{16}[A-Za-z0-9_+/=.~-]*+)"
PHONE = r"(?:(?<![0-9+])\+1[ .-]?|(?<![0-9+(]))\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9+])\+[0-9]{8,15}+|(?<![0-9.-])(?:\+?1[ .-])?[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9.-][0-9]|[0-9])|(?<![0-9+])\+[0-9](?:[ .-]?\(?[0-9]\)?){7,14}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
DATE = r"(?<![0-9.-])(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4})(?![0-9-])"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\3[0-9]{4}\3[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\4[0-9]{4,5})(?![0-9])"
#: Few characters can start a number: the test before their alternatives keeps the scan short.
NUMBER = rf"(?=[0-9+(])(?:{'|'.join([PHONE, SSN, DATE, IPV4, CARD])})"
PATTERN = "|".join([EMAIL, KEY, TOKEN, NUMBER])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _round(key: str, kind: str, k: Column, other: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}|{kind}|"), k.cast("string"), F.lit("|"), F.lower(other)), 512)


def _turn(x: Column, digest: Column, hexadecimal: bool = False) -> Column:
    """Every letter and digit moved within its class (or among the 16 hex digits) by one byte of the digest."""

    def one(j: Column) -> Column:
        by = F.conv(F.substr(digest, 2 * j - 1, F.lit(2)), 16, 10).cast("int")
        if hexadecimal:
            return F.lower(F.conv(((F.conv(F.substr(x, j, F.lit(1)), 16, 10).cast("int") + by) % 16).cast("string"), 10, 16))
        code = F.ascii(F.substr(x, j, F.lit(1)))
        step = lambda first, n: F.chr(((code - first + by) % n + first).cast("long"))
        return F.when(code.between(48, 57), step(48, 10)).when(code.between(97, 122), step(97, 26)).when(code.between(65, 90), step(65, 26)).otherwise(F.substr(x, j, F.lit(1)))

    return F.when(F.length(x) == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(x)), one), ""))


def permute(s: Column, key: str, kind: str) -> Column:
    """Feistel network over a string of letters and digits: the halves move each other in turn."""

    def step(state: Column, k: Column) -> Column:
        left, right = state["l"], state["r"]
        even = k % 2 == 0
        moved = _let(_round(key, kind, k, F.when(even, right).otherwise(left)), lambda h: _turn(F.when(even, left).otherwise(right), h, kind == "hex"))
        return _let(moved, lambda m: F.struct(F.when(even, m).otherwise(left).alias("l"), F.when(even, right).otherwise(m).alias("r")))

    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substr(s, F.lit(1), half).alias("l"), F.substr(s, half + 1, F.length(s)).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda z: F.concat(z["l"], z["r"]))


def permute_number(v: Column, bits: int, key: str, kind: str) -> Column:
    """Feistel network over numbers below 2 ** bits (even bits)."""
    half = 1 << (bits // 2)

    def step(state: Column, k: Column) -> Column:
        f = F.conv(F.substring(_round(key, kind, k, state["r"].cast("string")), 1, 8), 16, 10).cast("long")
        return F.struct(state["r"].alias("l"), ((state["l"] + f) % half).alias("r"))

    v = v.cast("long")
    start = F.struct(F.floor(v / half).cast("long").alias("l"), (v % half).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda z: z["l"] * half + z["r"])


def _fill(template: Column, chars: Column) -> Column:
    """template with its digits replaced, in order, by chars."""
    parts = F.regexp_extract_all(template, F.lit("[^0-9]|[0-9]"), F.lit(0))

    def filled(c: Column) -> Column:
        step = lambda st, ch: F.when(ch.rlike("[0-9]"), F.struct(F.concat(st["s"], F.substr(c, st["i"] + 1, F.lit(1))).alias("s"), (st["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(st["s"], ch).alias("s"), st["i"].alias("i")))
        return F.aggregate(parts, F.struct(F.lit("").alias("s"), F.lit(0).alias("i")), step, lambda z: z["s"])

    return _let(chars, filled)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn_sum(d: Column) -> Column:
    def add(total: Column, j: Column) -> Column:
        x = F.substr(d, j, F.lit(1)).cast("int")
        y = F.when((F.length(d) - j) % 2 == 1, 2 * x - F.when(x > 4, 9).otherwise(0)).otherwise(x)
        return total + y

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add)


def _card(m: Column, key: str) -> Column:
    def of(d: Column) -> Column:
        body = F.concat(F.substr(d, F.lit(1), F.lit(1)), permute(F.substr(d, F.lit(2), F.length(d) - 2), key, "card"))
        return _let(body, lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))

    return _let(_digits(m), lambda d: F.when(luhn_sum(d) % 10 == 0, _fill(m, of(d))).otherwise(m))


def valid_ssn(d: Column) -> Column:
    return ~d.rlike("^(?:000|666|9)|^...00|0000$")


def _ssn(m: Column, key: str) -> Column:
    """Walk the permutation's cycle to the next valid number; from a valid one that always ends."""
    step = lambda st, _: F.when(st["ok"], st).otherwise(_let(permute(st["d"], key, "ssn"), lambda d: F.struct(d.alias("d"), valid_ssn(d).alias("ok"))))
    walked = lambda d: F.aggregate(F.sequence(F.lit(1), F.lit(32)), F.struct(d.alias("d"), F.lit(False).alias("ok")), step, lambda z: z["d"])
    return _let(_digits(m), lambda d: F.when(valid_ssn(d), _fill(m, walked(d))).otherwise(m))


def _ip(m: Column, key: str) -> Column:
    number = F.aggregate(F.split(m, r"\."), F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))
    octet = lambda v, k: (F.floor(v / (256**k)) % 256).cast("string")
    return _let(permute_number(number, 32, key, "ip"), lambda v: F.concat_ws(".", octet(v, 3), octet(v, 2), octet(v, 1), octet(v, 0)))


DAY0 = "1920-01-01"


def _date(m: Column, key: str) -> Column:
    """yyyy-mm-dd, or dd-mm-yyyy, or (when only that is a date) mm-dd-yyyy, with - / or . between."""

    def moved(day: Column) -> Column:
        k = F.datediff(day, F.lit(DAY0).cast("date"))
        new = F.date_add(F.lit(DAY0).cast("date"), permute_number(k, 16, key, "date").cast("int"))
        return F.when(k.between(0, 65535), new)

    def of(d: Column) -> Column:
        part = lambda a, n: F.substr(d, F.lit(a), F.lit(n))
        as_day = lambda y, mo, dd: F.try_to_timestamp(F.concat_ws("-", y, mo, dd), F.lit("yyyy-MM-dd")).cast("date")
        ymd = as_day(part(1, 4), part(5, 2), part(7, 2))
        dmy = as_day(part(5, 4), part(3, 2), part(1, 2))
        mdy = as_day(part(5, 4), part(1, 2), part(3, 2))
        fmt = lambda day, f: _let(moved(day), lambda x: F.when(x.isNotNull(), _fill(m, F.date_format(x, f))).otherwise(m))
        first = m.rlike("^[0-9]{4}")
        return F.when(first & ymd.isNotNull(), fmt(ymd, "yyyyMMdd")).when(~first & dmy.isNotNull(), fmt(dmy, "ddMMyyyy")).when(~first & mdy.isNotNull(), fmt(mdy, "MMddyyyy")).otherwise(m)

    return _let(_digits(m), of)


def _phone(m: Column, key: str) -> Column:
    """The country code stays: the digits before the first separator, or of an international number whose
    code stands unbroken before the rest, the first two (one after +1)."""
    d = _digits(m)
    keep = F.when(m.rlike(r"^\+[0-9]{1,3}[^0-9]"), F.length(F.regexp_extract(m, r"^\+([0-9]+)", 1))).when(m.rlike(r"^\+[0-9]{4}") & ~m.rlike(r"^\+1[0-9]{10}$"), 2).otherwise(F.when(F.length(d) == 11, 1).otherwise(0))
    return _let(F.struct(d.alias("d"), keep.alias("k")), lambda s: _fill(m, F.concat(F.substr(s["d"], F.lit(1), s["k"]), permute(F.substr(s["d"], s["k"] + 1, F.length(s["d"])), key, "phone"))))


def _token(x: Column, key: str) -> Column:
    """A digest moves the halves of 64 characters: longer values go block by block."""
    blocks = F.regexp_extract_all(x, F.lit(".{1,64}"), F.lit(0))
    of = lambda kind: F.array_join(F.transform(blocks, lambda b: permute(b, key, kind)), "")
    return F.when(x.rlike("^[0-9a-f]+$"), of("hex")).otherwise(of("token"))


#: The name of a secret with what stands before its value, and the value.
HEAD = r"^([A-Za-z_]+ ?[=:] ?[\"']?)(.*)$"


def pseudonym(m: Column, key: str) -> Column:
    """The replacement of one matched value (unchanged where it doesn't validate)."""
    local = F.substring_index(m, "@", 1)
    head = F.regexp_extract(m, HEAD, 1)
    tail = F.regexp_extract(m, HEAD, 2)
    return (
        F.when(m.contains("@"), F.concat(permute(local, key, "mail"), F.substr(m, F.length(local) + 1, F.length(m))))
        .when(m.rlike("^AKIA[A-Z0-9]{16}$"), F.concat(F.lit("AKIA"), permute(F.substr(m, F.lit(5), F.lit(16)), key, "key")))
        .when(m.rlike("^[A-Za-z]"), F.concat(head, _token(tail, key)))
        .when(m.rlike(rf"^{IPV4}$"), _ip(m, key))
        .when(m.rlike(rf"^{SSN}$"), _ssn(m, key))
        .when(m.rlike(rf"^{DATE}$"), _date(m, key))
        .when(m.rlike(r"^[0-9 -]+$") & (F.length(_digits(m)) >= 13), _card(m, key))
        .otherwise(_phone(m, key))
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, text, n_pseudonyms (values that changed) for every row; no shuffle. Whoever has the key can undo
    the pseudonyms: keep it out of source and logs."""
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.regexp_extract_all(F.col(text_col), F.lit(PATTERN), F.lit(0)).alias("m"))
    some = F.size("m") > 0
    new = F.when(some, F.transform("m", lambda m: pseudonym(m, key)))
    changed = F.size(F.filter(F.zip_with("m", "p", lambda a, b: a != b), lambda x: x))
    between = F.split(F.col("text"), PATTERN, -1)
    spliced = F.array_join(F.zip_with(between, F.concat("p", F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    out = found.withColumn("p", new)
    return out.select("doc_id", F.when(some, spliced).otherwise(F.col("text")).alias("text"), F.when(some, changed).otherwise(F.lit(0)).cast("long").alias("n_pseudonyms"))
