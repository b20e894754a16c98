"""Format-preserving pseudonyms for personal data, in SQL expressions only.

Values that are found and validated are permuted within their own format by keyed Feistel networks, so that equal values
get equal pseudonyms in all documents, different values different ones, and what holds of the form of a value still
holds: length, punctuation, letter case, check digits, calendar.

* **Characters** (`permute`): the text is cut in two halves, and in each round every character of one half moves within
  its class (digit, lower or upper letter, or hexadecimal) by a keyed hash of the other half. Used for payment cards
  (13 to 19 digits with a right Luhn digit, which is made anew), IBANs (right remainder; account digits and letters
  move, check digits are made anew), telephone numbers in international form (the country code stays), e-mail addresses
  (local part; the domain stays), access keys and quoted or assigned secrets.
* **Numbers** (`permute_number`): alternating addition modulo two factors of the number of values, a permutation of
  exactly that many. Used for dates (400 Gregorian years), IPv4 addresses and US social security numbers. Dates that
  begin with two digits are read day first; those that are no date so are read month first and move among their like,
  the dates after the twelfth of a month, so that the two kinds never meet.

What fails its validation stays as it is. There is no shuffle and no state; the key must be kept secret by the caller.

Defined cases: null texts stay null, empty ones empty; repeated rows get the same result. Columns of the input are kept, but
for one named like the added one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.store import free_name, without

ROUNDS = 8
#: A half's hash stream has a block for each so many characters; the seed of a half of more than LONG is hashed first.
BLOCK, LONG = 32, 128
FIRST_YEAR, DAYS = 1800, 146_097  # 400 years from then, of 189 * 773 days
LATE_DAYS = 88_497  # of these after the twelfth of a month, 9833 * 9

# Fixed formats, in order of precedence.
FORMATS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "ipv4": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9/.-])(?:(?:1[89]|2[01])[0-9]{2}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2(?:1[89]|2[01])[0-9]{2})(?![0-9]|[-/.][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "card": r"(?<![0-9.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9]|[-.][0-9])",
    "access": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?i:(?<![a-z0-9])(?:password|passwd|secret|token|api_?key)[\"']?[ ]?[=:][ ]?[\"']?)[A-Za-z0-9_+/.~-]{6,}+|\"[0-9a-f]{32,}+\"",
}
#: No format begins inside a word, which one look back settles for most places of a text.
PATTERN = "(?<![A-Za-z0-9])(?:" + "|".join(FORMATS.values()) + ")"
#: Every format has one of these characters.
SIGNS = r"[0-9@=:\"]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _move(char: Column, by: Column, hexes: Column) -> Column:
    """A character moved within its class."""
    code = F.ascii(char)

    def within(first: str, size: int) -> Column:
        return F.char(F.lit(ord(first)) + (code - ord(first) + by) % size)

    digit, low, high = (char.between(a, b) for a, b in ("09", "az", "AZ"))
    place = F.when(digit, code - 48).otherwise(code - 87)
    return (
        F.when(hexes & (digit | low), F.substring(F.lit("0123456789abcdef"), (place + by) % 16 + 1, F.lit(1)))
        .when(digit, within("0", 10)).when(low, within("a", 26)).when(high, within("A", 26)).otherwise(char)
    )


def permute(value: Column, key: str, hexes: bool | Column = False) -> Column:
    """The keyed permutation of all strings of the same length and classes of characters; of all strings of lower-case
    hexadecimal digits, if `hexes`."""
    hexes = F.lit(hexes) if isinstance(hexes, bool) else hexes

    def round_(s: Column, k: Column) -> Column:
        def block(chars: Column, stream: Column) -> Column:
            byte = lambda i: F.conv(F.substring(stream, i * 2 - 1, F.lit(2)), 16, 10).cast("int")
            return F.array_join(F.transform(F.sequence(F.lit(1), F.length(chars)), lambda i: let(
                F.substring(chars, i, F.lit(1)), lambda char: let(byte(i), lambda by: _move(char, by, s["h"])))), "")

        def moved(seed: Column) -> Column:
            return F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.length(s["a"]) - 1) / BLOCK).cast("int")), lambda i: let(
                F.substring(s["a"], i * BLOCK + 1, F.lit(BLOCK)), lambda chars: let(
                    F.sha2(F.concat(seed, F.lit("|"), i.cast("string")), 256), lambda stream: block(chars, stream)))), "")

        seed = F.concat_ws("|", F.lit(key), k.cast("string"), s["n"].cast("string"), s["b"])
        seed = F.when(F.length(s["a"]) > LONG, F.sha2(seed, 256)).otherwise(seed)
        return F.struct(s["b"].alias("a"), F.when(F.length(s["a"]) == 0, s["a"]).otherwise(let(seed, moved)).alias("b"), s["h"].alias("h"), s["n"].alias("n"))

    def whole(v: Column) -> Column:
        half = F.floor(F.length(v) / 2).cast("int")
        start = F.struct(F.substring(v, F.lit(1), half).alias("a"), F.substring(v, half + 1, F.length(v)).alias("b"), hexes.alias("h"), F.length(v).alias("n"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_, lambda s: F.concat(s["a"], s["b"]))

    return let(value, whole)


def permute_number(value: Column, high: int, low: int, key: str) -> Column:
    """The keyed permutation of the whole numbers from 0 to high * low - 1."""
    def draw(k: Column, side: str, other: Column) -> Column:
        seed = F.concat_ws("|", F.lit(key), F.lit(side), k.cast("string"), other.cast("string"))
        return F.conv(F.substring(F.sha2(seed, 256), 1, 13), 16, 10).cast("long")

    def round_(s: Column, k: Column) -> Column:
        return let((s["a"] + draw(k, "a", s["b"])) % high, lambda a: F.struct(a.alias("a"), ((s["b"] + draw(k, "b", a)) % low).alias("b")))

    def whole(v: Column) -> Column:
        start = F.struct(F.floor(v / low).cast("long").alias("a"), (v % low).cast("long").alias("b"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, round_, lambda s: s["a"] * low + s["b"])

    return let(value, whole)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _fill(form: Column, digits: Column) -> Column:
    """`form` with its digits replaced, in order."""
    def with_digits(new: Column) -> Column:
        def at(i: Column) -> Column:
            char = F.substring(form, i, F.lit(1))
            return F.when(char.between("0", "9"), F.substring(new, F.length(_digits(F.substring(form, F.lit(1), i))), F.lit(1))).otherwise(char)

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), at), "")

    return let(digits, with_digits)


def luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""
    def of(turned: Column) -> Column:
        def add(total: Column, i: Column) -> Column:
            return let(F.substring(turned, i, F.lit(1)).cast("int"), lambda d: total + F.when(
                i % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))

        return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) % 10

    return let(F.reverse(digits), of)


def mod97(iban: Column) -> Column:
    """The remainder of an IBAN: its first four characters at the end, letters as 10 to 35."""
    def of(turned: Column) -> Column:
        def add(rest: Column, i: Column) -> Column:
            char = F.substring(turned, i, F.lit(1))
            return F.when(char.between("0", "9"), (rest * 10 + F.ascii(char) - 48) % 97).otherwise((rest * 100 + F.ascii(char) - 55) % 97)

        return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add)

    return let(iban, lambda v: let(F.concat(F.substring(v, F.lit(5), F.length(v)), F.substring(v, 1, 4)), of))


def _card(value: Column, key: str) -> Column:
    def with_body(body: Column) -> Column:
        return _fill(value, F.concat(body, ((10 - luhn(F.concat(body, F.lit("0")))) % 10).cast("string")))

    return let(_digits(value), lambda digits: F.when(
        luhn(digits) == 0, let(permute(F.substring(digits, F.lit(1), F.length(digits) - 1), key), with_body)).otherwise(value))


def _iban(value: Column, key: str) -> Column:
    country = F.substring(value, 1, 2)

    def with_account(account: Column) -> Column:
        return F.concat(country, F.lpad((98 - mod97(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0"), account)

    return F.when(mod97(value) == 1, let(permute(F.substring(value, F.lit(5), F.length(value)), key), with_account)).otherwise(value)


def _ipv4(value: Column, key: str) -> Column:
    def of(parts: Column) -> Column:
        number = F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n * 256 + p)
        out = let(permute_number(number, 1 << 16, 1 << 16, key), lambda new: F.concat_ws(
            ".", *(F.pmod(F.shiftright(new, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0))))
        return F.when(F.forall(parts, lambda p: p <= 255), out).otherwise(value)

    return let(F.transform(F.split(value, r"\."), lambda p: p.cast("long")), of)


def _late(day: Column, key: str) -> Column:
    """The keyed permutation of the days after the twelfth of a month, numbered in order."""
    first = F.to_date(F.lit(f"{FIRST_YEAR}-01-01"))
    start = lambda m: F.datediff(F.add_months(first, m), first) - m * 12  # noqa: E731  # such days before month m
    month = (F.year(day) - FIRST_YEAR) * 12 + F.month(day) - 1

    def shown(new: Column) -> Column:
        about = F.floor(new * 4800 / LATE_DAYS).cast("int")
        fits = F.filter(F.sequence(about - 2, about + 2), lambda m: start(m) <= new)
        return let(F.array_max(fits), lambda m: F.date_add(F.add_months(first, m), (new - start(m) + 12).cast("int")))

    return let(permute_number((start(month) + F.day(day) - 13).cast("long"), 9833, 9, key), shown)


def _date(value: Column, key: str) -> Column:
    first = F.to_date(F.lit(f"{FIRST_YEAR}-01-01"))
    year_first = value.rlike("^[0-9]{4}")
    one, two, year = F.substring(value, 1, 2), F.substring(value, 4, 2), F.substring(value, 7, 4)

    def read(*parts: Column) -> Column:
        return F.try_to_date(F.concat_ws("-", *parts), "yyyy-MM-dd")

    def of(mark: Column) -> Column:
        def shown(day: Column, form: str) -> Column:
            return F.replace(F.date_format(day, form), F.lit("-"), mark)

        def any_day(form: str) -> Callable[[Column], Column]:
            return lambda day: shown(F.date_add(first, permute_number(F.datediff(day, first).cast("long"), 189, 773, key).cast("int")), form)

        def found(days: Column) -> Column:
            return (F.when(days["iso"].isNotNull(), let(days["iso"], any_day("yyyy-MM-dd")))
                    .when(days["day"].isNotNull(), let(days["day"], any_day("dd-MM-yyyy")))
                    .when(days["month"].isNotNull(), let(days["month"], lambda day: shown(_late(day, key), "MM-dd-yyyy"))).otherwise(value))

        iso = F.when(year_first, F.try_to_date(F.replace(value, mark, F.lit("-")), "yyyy-MM-dd"))
        return let(F.struct(iso.alias("iso"), F.when(~year_first, read(year, two, one)).alias("day"), F.when(~year_first, read(year, one, two)).alias("month")), found)

    return let(F.when(year_first, F.substring(value, 5, 1)).otherwise(F.substring(value, 3, 1)), of)


def _ssn(value: Column, key: str) -> Column:
    area, group, serial = (F.substring(value, *x).cast("long") for x in ((1, 3), (5, 2), (8, 4)))
    right = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    number = (area - F.when(area > 666, 2).otherwise(1)) * (99 * 9999) + (group - 1) * 9999 + serial - 1

    def shown(new: Column) -> Column:
        place = F.floor(new / (99 * 9999))
        return F.concat_ws("-", F.lpad((place + F.when(place >= 665, 2).otherwise(1)).cast("string"), 3, "0"),
                           F.lpad((F.floor(new / 9999) % 99 + 1).cast("string"), 2, "0"), F.lpad((new % 9999 + 1).cast("string"), 4, "0"))

    return F.when(right, let(permute_number(number, 898, 99 * 9999, key), shown)).otherwise(value)


def _phone(value: Column, key: str) -> Column:
    # The country code is what stands before the first mark, or one digit.
    def of(country: Column) -> Column:
        return let(F.substring(value, F.length(country) + 1, F.length(value)), lambda rest: F.concat(country, _fill(rest, permute(_digits(rest), key))))

    return let(F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[ .(-])|^\+[0-9]", 0), of)


def _email(value: Column, key: str) -> Column:
    return F.concat(permute(F.substring_index(value, "@", 1), key), F.lit("@"), F.substring_index(value, "@", -1))


def _secret(value: Column, key: str) -> Column:
    quoted = value.startswith('"')
    tail = F.when(quoted, F.regexp_extract(value, "[0-9a-f]+", 0)).otherwise(
        F.regexp_extract(value, r"[=:][ ]?[\"']?([A-Za-z0-9_+/.~-]+)$", 1))
    end = F.when(quoted, F.lit('"')).otherwise(F.lit(""))
    return let(tail, lambda t: F.concat(F.substring(value, F.lit(1), F.length(value) - F.length(t) - F.length(end)), permute(t, key, quoted), end))


RULES = {"email": _email, "ipv4": _ipv4, "date": _date, "ssn": _ssn, "phone": _phone, "iban": _iban, "card": _card,
         "access": lambda v, key: F.concat(F.substring(v, 1, 4), permute(F.substring(v, 5, 16), key)), "secret": _secret}


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one found value; the first format that it has as a whole decides."""
    out = None
    for name, rule in RULES.items():
        whole, new = value.rlike(f"^(?:{FORMATS[name]})$"), rule(value, f"{key}|{name}")
        out = F.when(whole, new) if out is None else out.when(whole, new)
    return out.otherwise(value)


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """`docs` with its texts rewritten and `n_found`, the number of values of any format (valid or not) in the text."""
    docs, text = without(docs, "n_found"), F.col(text_col)
    none = F.array().cast("array<string>")
    found = F.when(text.rlike(SIGNS), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(none)
    # The finds are their own projection, so that they are worked out once.
    name = free_name(docs, "__found")
    new = F.array_join(F.zip_with(
        F.split(text, PATTERN, -1), F.transform(name, lambda m: pseudonym(m, key)), lambda part, m: F.concat(part, F.coalesce(m, F.lit("")))), "")
    met = docs.withColumn(name, found)
    return met.withColumns({text_col: F.when(F.size(name) > 0, new).otherwise(text), "n_found": F.coalesce(F.size(name), F.lit(0))}).drop(name)
