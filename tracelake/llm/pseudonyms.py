"""PII: keyed format-preserving pseudonyms by a Feistel network, in SQL functions only.

A value is a row of symbols, each with its own radix (a digit 10, a letter 26, an
octet 256, a date two symbols of 270).  The network halves the row; in each round
the symbols of one half move on, modulo their radix, by a keyed hash of the other
half.  That permutes all values of the format, so equal values stay equal
everywhere and different ones stay different, and nobody without the key can tell
which was which.

Values are first validated: card numbers by their check digit, which is made anew;
IBANs by theirs; octets by their range; dates by the calendar; social security
numbers by the areas, groups and serials that are given out; telephone numbers by
how many digits they have.  What does not validate stays as it is.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.session import table

ROUNDS = 8
#: A date's days are counted from here; 270 * 270 days at a time are permuted among each other.
EPOCH, SIDE = "1900-01-01", 270

#: In order: at one place the first that matches counts.
FORMATS = {
    "secret": r"""(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b["']?\s{0,3}[=:]\s{0,3}["'][^"'\s]{8,}["'])""",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9/-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])|(?<![0-9A-Za-z])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
PATTERN = "|".join(FORMATS.values())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value evaluated once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def feistel(symbols: Column, radices: Column, key: str, tag: str) -> Column:
    """The permuted symbols; tag keeps formats apart."""

    def network(rad: Column, half: Column) -> Column:
        def round_(s: Column, r: Column) -> Column:
            other = F.when(r % 2 == 1, F.slice(s, half + 1, F.size(s) - half)).otherwise(F.slice(s, F.lit(1), half))
            seen = F.concat_ws("|", F.lit(key), F.lit(tag), r.cast("string"), F.array_join(other.cast("array<string>"), ","))

            def move(seed: Column) -> Column:
                def shift(i: Column) -> Column:
                    return F.conv(F.substring(F.sha2(F.concat_ws("|", seed, i.cast("string")), 256), 1, 13), 16, 10).cast("bigint")

                moves = lambda i: (F.get(rad, i) > 1) & ((i < half) == (r % 2 == 1))
                return F.transform(s, lambda x, i: F.when(moves(i), F.pmod(x + F.pmod(shift(i), F.get(rad, i)), F.get(rad, i))).otherwise(x))

            return let(seen, move)

        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), symbols.cast("array<bigint>"), round_)

    return let(radices.cast("array<bigint>"), lambda rad: let(F.floor(F.size(rad) / 2).cast("int"), lambda half: network(rad, half)))


def chars(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))


def lettered(value: Column, kept: int, key: str, tag: str, letters: int = 26) -> Column:
    """ASCII letters (the first `letters` of them) and digits after the first `kept` characters permuted, each within its class."""
    base = lambda c: F.when(c.rlike("^[0-9]$"), 48).when(c.rlike("^[a-z]$"), 97).otherwise(65)

    def with_chars(cs: Column) -> Column:
        radix = F.transform(cs, lambda c, i: F.when((i < kept) | ~c.rlike("^[0-9A-Za-z]$"), 1).when(c.rlike("^[0-9]$"), 10).otherwise(letters))

        def with_radix(rad: Column) -> Column:
            symbols = F.transform(cs, lambda c, i: F.when(F.get(rad, i) == 1, 0).otherwise(F.ascii(c) - base(c)))
            return let(feistel(symbols, rad, key, tag), lambda moved: F.array_join(F.transform(cs, lambda c, i: F.when(F.get(rad, i) == 1, c).otherwise(F.char(F.get(moved, i) + base(c)))), ""))

        return let(radix, with_radix)

    return let(chars(value), with_chars)


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def moved_digits(digits: Column, key: str, tag: str) -> Column:
    symbols = F.transform(chars(digits), lambda c: c.cast("int"))
    return let(symbols, lambda s: F.array_join(feistel(s, F.transform(s, lambda _: F.lit(10)), key, tag).cast("array<string>"), ""))


def refilled(value: Column, digits: Column) -> Column:
    """value with its digits replaced, in order."""
    nth = lambda v, i: F.length(only_digits(F.substr(v, F.lit(1), i + 1)))
    return let(digits, lambda d: F.array_join(F.transform(chars(value), lambda c, i: F.when(c.rlike("^[0-9]$"), F.substr(d, nth(value, i), F.lit(1))).otherwise(c)), ""))


def luhn(digits: Column, doubled_from_right: int) -> Column:
    """The Luhn sum; the digit at this place from the right (0 or 1), and every second after it, counts double."""

    def add(total: Column, x: Column) -> Column:
        twice = F.when(x["d"] * 2 > 9, x["d"] * 2 - 9).otherwise(x["d"] * 2)
        return total + F.when(x["i"] % 2 == doubled_from_right, twice).otherwise(x["d"])

    places = F.transform(F.reverse(chars(digits)), lambda c, i: F.struct(c.cast("int").alias("d"), i.alias("i")))
    return F.aggregate(places, F.lit(0), add)


def card(value: Column, key: str) -> Column:
    checked = lambda p: F.concat(p, F.pmod(10 - luhn(p, 0) % 10, F.lit(10)).cast("string"))
    moved = lambda d: let(moved_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, "card"), checked)
    return let(only_digits(value), lambda d: F.when(luhn(d, 1) % 10 == 0, refilled(value, moved(d))).otherwise(value))


def mod97(text: Column) -> Column:
    """An IBAN's remainder, its first four characters moved to the end and letters read as 10 to 35."""
    turned = F.concat(F.substr(text, F.lit(5)), F.substr(text, F.lit(1), F.lit(4)))
    step = lambda t, c: F.when(c.rlike("^[0-9]$"), (t * 10 + F.ascii(c) - 48) % 97).otherwise((t * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(chars(turned), F.lit(0), step)


def iban(value: Column, key: str) -> Column:
    def checked(moved: Column) -> Column:
        zero = F.concat(F.substr(moved, F.lit(1), F.lit(2)), F.lit("00"), F.substr(moved, F.lit(5)))
        return F.concat(F.substr(moved, F.lit(1), F.lit(2)), F.lpad((98 - mod97(zero)).cast("string"), 2, "0"), F.substr(moved, F.lit(5)))

    nth = lambda i: F.length(F.regexp_replace(F.substr(value, F.lit(1), i + 1), " ", ""))
    spaced = lambda whole: F.array_join(F.transform(chars(value), lambda c, i: F.when(c == " ", c).otherwise(F.substr(whole, nth(i), F.lit(1)))), "")
    plain = F.regexp_replace(value, " ", "")
    return let(plain, lambda p: F.when(mod97(p) == 1, let(let(lettered(p, 4, key, "iban"), checked), spaced)).otherwise(value))


def ip(value: Column, key: str) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda o: o.cast("int"))
    moved = lambda o: F.array_join(feistel(o, F.transform(o, lambda _: F.lit(256)), key, "ip").cast("array<string>"), ".")
    return let(octets, lambda o: F.when(F.forall(o, lambda x: x <= 255), moved(o)).otherwise(value))


def date(value: Column, key: str) -> Column:
    """The date in its own format, years of four digits, days and months of one or two; of two readings of 03/04/2020 the month comes first."""
    side = F.lit(SIDE)
    epoch = F.lit(EPOCH).cast("date")

    def moved(n: Column) -> Column:
        two = lambda k: feistel(F.array(F.floor(k / SIDE).cast("int"), F.pmod(k, side)), F.array(side, side), key, "date")
        inside = F.pmod(n, F.lit(SIDE * SIDE))
        return let(let(inside, two), lambda t: F.date_add(epoch, (n - inside + F.get(t, F.lit(0)) * SIDE + F.get(t, F.lit(1))).cast("int")))

    def read(form: str) -> Column:
        return F.struct(F.try_to_timestamp(value, F.lit(form)).cast("date").alias("day"), F.lit(form).alias("form"))

    padded = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd/MM/yyyy", "dd.MM.yyyy")
    forms = padded + tuple(f.replace("MM", "M").replace("dd", "d") for f in padded)
    first = F.get(F.filter(F.array(*map(read, forms)), lambda x: x["day"].isNotNull()), F.lit(0))

    def shown(x: Column) -> Column:
        by_form = lambda d: reduce(lambda rest, form: F.when(x["form"] == form, F.date_format(d, form)).otherwise(rest), forms, value)
        return let(let(F.date_diff(x["day"], epoch), moved), by_form)

    return let(first, lambda x: F.when(x.isNull(), value).otherwise(shown(x)))


def secret(value: Column, key: str) -> Column:
    inner = lambda h: F.substr(value, F.length(h) + 1, F.length(value) - F.length(h) - 1)
    head = F.regexp_extract(value, r"""^([^=:]*[=:]\s*["'])""", 1)
    moved = lambda b: F.when(b.rlike("^[0-9a-f]+$"), lettered(b, 0, key, "hex", 6)).otherwise(lettered(b, 0, key, "secret"))
    return let(head, lambda h: F.concat(h, let(inner(h), moved), F.substr(value, F.length(value), F.lit(1))))


def email(value: Column, key: str) -> Column:
    """Local part and domain each by itself, so that one domain's addresses stay together; the last label stays."""
    local, domain = F.substring_index(F.lower(value), "@", 1), F.substring_index(F.lower(value), "@", -1)
    top = F.substring_index(domain, ".", -1)
    host = lambda d: F.substr(d, F.lit(1), F.length(d) - F.length(top))
    return F.concat(lettered(local, 0, key, "email"), F.lit("@"), lettered(host(domain), 0, key, "domain"), top)


def phone(value: Column, key: str) -> Column:
    """Numbers of 7 to 15 digits, as the international numbering plan has them; which of them are in use it does not say."""
    code = F.regexp_extract(value, r"^(\+[0-9]{1,3}(?![0-9]))", 1)  # a country code that stands apart stays
    rest = F.substr(value, F.length(code) + 1)
    moved = F.concat(code, refilled(rest, moved_digits(only_digits(rest), key, "phone")))
    return F.when(F.length(only_digits(value)).between(7, 15), moved).otherwise(value)


def ssn(value: Column, key: str) -> Column:
    """Areas but 000, 666 and 900 on, groups but 00 and serials but 0000 are valid, and are permuted among each other."""

    def moved(parts: Column) -> Column:
        area, group, serial = (F.get(parts, F.lit(i)) for i in range(3))
        symbols = F.array(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1)
        back = lambda a: F.when(a >= 665, a + 2).otherwise(a + 1)
        shown = lambda m: F.format_string("%03d-%02d-%04d", back(F.get(m, F.lit(0))), F.get(m, F.lit(1)) + 1, F.get(m, F.lit(2)) + 1)
        valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
        return F.when(valid, let(feistel(symbols, F.array(*map(F.lit, (898, 99, 9999))), key, "ssn"), shown)).otherwise(value)

    return let(F.transform(F.split(value, "-"), lambda p: p.cast("int")), moved)


KINDS = {"secret": secret, "email": email, "ip": ip, "date": date, "iban": iban, "phone": phone, "ssn": ssn, "card": card}


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one found value, by the first format that it has as a whole."""
    return reduce(lambda rest, kind: F.when(value.rlike(f"^(?:{FORMATS[kind]})$"), KINDS[kind](value, key)).otherwise(rest), list(KINDS)[::-1], value)


def pseudonymised(text: Column, key: str) -> tuple[Column, Column, Column]:
    """found values, their pseudonyms, and the parts of the text around them."""
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    return found, F.transform(found, lambda v: pseudonym(v, key)), F.split(text, PATTERN, -1)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with text replaced, and n_found and n_changed: values in a known format, and those that validated.

    docs: text and any other columns, which stay.  A null text stays null, with
    no values; an empty one stays empty.  Repeated rows give equal rows, an empty
    table gives none.  Columns named n_found and n_changed are replaced; every
    other name may occur, but for __found, __parts and __moved.  A text of any
    length is one expression's value.
    """
    candidate = F.col("text").rlike(r"[0-9][0-9./ -]*[0-9]|@|[=:]\s{0,3}[\"']")
    found, moved, parts = pseudonymised(F.col("text"), key)
    # each step is a projection of its own row: no shuffle, and the expensive parts run only where something may be found
    cut = docs.withColumn("__found", F.when(candidate, found)).withColumn("__parts", F.when(F.size("__found") > 0, parts))
    new = cut.withColumn("__moved", F.when(F.size("__found") > 0, F.transform("__found", lambda v: pseudonym(v, key))))
    joined = F.array_join(F.flatten(F.zip_with("__parts", "__moved", lambda p, m: F.array(p, F.coalesce(m, F.lit(""))))), "")
    return (
        new.withColumn("text", F.when(F.size("__found") > 0, joined).otherwise(F.col("text").cast("string")))
        .withColumn("n_found", F.when(F.size("__found") > 0, F.size("__found")).otherwise(0).cast("long"))
        .withColumn("n_changed", F.when(F.size("__found") > 0, F.size(F.filter(F.zip_with("__found", "__moved", lambda f, m: f != m), lambda x: x))).otherwise(0).cast("long"))
        .drop("__found", "__parts", "__moved")
    )


def session_key(spark: SparkSession) -> str:
    """The key that the session sets as tracelake.pseudonym.key; the one used without it is no secret."""
    return spark.conf.get("tracelake.pseudonym.key", "no secret")


def op3_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"), session_key(spark)).select("doc_id", "text", "n_found", "n_changed")


QUERIES = {"op3_feistel_pseudonyms": op3_feistel_pseudonyms}
ORACLES: dict[str, str] = {}
