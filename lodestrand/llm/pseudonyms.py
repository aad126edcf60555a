"""Format-preserving pseudonyms for personal data: keyed Feistel permutations, in SQL expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.common import fresh, named

#: What is looked for, in order of precedence where two begin at one place.
PATTERNS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "secret": r"(?<![0-9A-Za-z])(?=[0-9A-Fa-f]{0,63}[0-9])[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d/-]|\.\d)",
    "address": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]?\d{4}(?!\d)|(?<![\d+])\+\d{10,13}(?!\d)|(?<![\d+])\+(?:\d\)?[ ./-]?\(?){7,14}\d(?!\d)",
    # A point between digits is a decimal one if the number before it, or what follows it, is too short for a number of this kind.
    "number": r"(?<!\d)(?<!(?<!\d)\d{1,12}\.)(?:\d{13,19}|\d{4}([ -])(?:\d{4}\1\d{4}\1\d{1,7}|\d{6}\1\d{4,5}))(?!\d|\.\d{1,12}(?!\d))",
}
#: Formats of dates, by where their separators stand. Each is permuted within itself.
DATES = {r"^\d{4}-": "yyyy-MM-dd", r"^\d{4}/": "yyyy/MM/dd", r"^\d{2}\.": "dd.MM.yyyy", r"^\d{2}/": "MM/dd/yyyy"}
#: Dates are permuted among the 146,097 days from 1800 to 2199: 27 times 5,411.
FIRST_DAY, DAY_RADIX = "1800-01-01", (27, 5411)
ROUNDS = 10


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, domain: Column, inverse: bool = False) -> Column:
    """struct(a, b): the pair (left, right) permuted among left_size times right_size pairs.

    An unbalanced Feistel network: rounds in turn add a keyed hash of one half to the other, modulo
    its size, which can be undone whatever the hash. ``domain`` separates kinds of values.
    """

    def mixed(other: Column, r: Column) -> Column:
        word = F.sha2(F.concat_ws("|", F.lit(key), domain, r.cast("string"), other.cast("string")), 256)
        return F.conv(F.substring(word, 1, 15), 16, 10).cast("bigint")

    def step(s: Column, r: Column) -> Column:
        sign = F.lit(-1 if inverse else 1).cast("bigint")
        a = F.pmod(s["a"] + sign * F.pmod(mixed(s["b"], r), left_size), left_size)
        b = F.pmod(s["b"] + sign * F.pmod(mixed(s["a"], r), right_size), right_size)
        return F.when(r % 2 == 0, F.struct(a.alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), b.alias("b")))

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, F.struct(left.cast("bigint").alias("a"), right.cast("bigint").alias("b")), step)


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("bigint")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def permute_digits(digits: Column, key: str, kind: str, inverse: bool = False) -> Column:
    """A string of 2 to 19 digits, permuted among all strings of its length."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    v = n - u
    a, b = F.substring(digits, F.lit(1), u).cast("bigint"), F.substring(digits, u + 1, v).cast("bigint")
    moved = feistel(a, b, _power(u), _power(v), key, F.concat(F.lit(kind), n.cast("string")), inverse)
    return let(moved, lambda m: F.concat(F.lpad(m["a"].cast("string"), u, "0"), F.lpad(m["b"].cast("string"), v, "0")))


def check_digit(payload: Column) -> Column:
    """The Luhn check digit of a string of digits, as a number."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(payload, F.length(payload) + 1 - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(payload)), F.lit(0), add)
    return F.pmod(-total, F.lit(10))


def refill(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, one after another, by those of ``digits``."""

    def at(i: Column, digits: Column) -> Column:
        c = F.substring(shape, i, F.lit(1))
        nth = F.length(_digits(F.substring(shape, F.lit(1), i)))
        return F.when(c.between("0", "9"), F.substring(digits, nth, F.lit(1))).otherwise(c)

    return let(digits, lambda d: F.concat_ws("", F.transform(F.sequence(F.lit(1), F.length(shape)), lambda i: at(i, d))))


def pseudonym(value: Column, kind: Column, key: str, inverse: bool = False) -> Column:
    """What stands for a value of a kind: of the same format, and the same wherever the value stands.

    Numbers that pass the Luhn check stay valid ones, others stay others of their length (a
    permutation each); dates stay dates from 1800 to 2199, IPv4 addresses addresses, and phone
    numbers keep their country code (what a separator ends, else all but ten digits). Values that don't validate (a 13th month, an octet of 300) are left as they
    are, but for their digits, which are permuted. E-mail names and hexadecimal secrets become keyed hashes of
    fixed or equal length, which only ``inverse`` can't undo.
    """
    digits = _digits(value)
    n = F.length(digits)
    plain = refill(value, F.when(n.between(2, 19), permute_digits(digits, key, "digits", inverse)).otherwise(digits))
    payload = F.substring(digits, F.lit(1), n - 1)
    # The last digit stays as far from the right check digit as it was: valid numbers stay valid, others don't become so.
    off = F.substring(digits, n, F.lit(1)).cast("int") - check_digit(payload)
    number = refill(value, let(permute_digits(payload, key, "luhn", inverse), lambda new: F.concat(new, F.pmod(check_digit(new) + off, F.lit(10)).cast("string"))))
    ended = F.length(F.regexp_extract(value, r"^\+(\d{1,3})[ ./(-]", 1))
    code = F.when(ended > 0, ended).otherwise(F.greatest(n - 10, F.lit(0)))
    phone = refill(value, F.concat(F.substring(digits, F.lit(1), code), permute_digits(F.substring(digits, code + 1, n), key, "phone", inverse)))
    octets = F.transform(F.split(value, r"\."), lambda x: x.try_cast("int"))
    moved = feistel(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], F.lit(65536).cast("bigint"), F.lit(65536).cast("bigint"), key, F.lit("address"), inverse)
    address = let(moved, lambda m: F.concat_ws(".", *[x.cast("string") for x in (F.floor(m["a"] / 256), m["a"] % 256, F.floor(m["b"] / 256), m["b"] % 256)]))
    def shown(form: str):
        return lambda m: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (m["a"] * DAY_RADIX[1] + m["b"]).cast("int")), form)

    date = None
    for shape, form in DATES.items():
        parsed = F.to_date(F.try_to_timestamp(value, F.lit(form)))
        day = F.datediff(parsed, F.lit(FIRST_DAY).cast("date"))
        x, y = (F.lit(r).cast("bigint") for r in DAY_RADIX)
        moved = feistel(F.floor(day / DAY_RADIX[1]), F.pmod(day, F.lit(DAY_RADIX[1])), x, y, key, F.lit(form), inverse)
        out = let(moved, shown(form))
        out = F.when(day.between(0, DAY_RADIX[0] * DAY_RADIX[1] - 1), out).otherwise(plain)
        date = F.when(value.rlike(shape), out) if date is None else date.when(value.rlike(shape), out)
    hashed = F.concat(F.sha2(F.concat(F.lit(f"{key}|secret|"), F.lower(value)), 256))
    name = F.concat(F.lit("u"), F.substring(F.sha2(F.concat(F.lit(f"{key}|email|"), F.lower(value)), 256), 1, 15), F.lit("@"), F.substring_index(value, "@", -1))
    return (
        F.when(kind == "email", name)
        .when(kind == "secret", F.substring(hashed, F.lit(1), F.length(value)))
        .when(kind == "date", date)
        .when(kind == "address", F.when(F.forall(octets, lambda x: x < 256), address).otherwise(plain))
        .when(kind == "phone", phone)
        .when(kind == "number", number)
        .otherwise(plain)
    )


def kind_of(value: Column) -> Column:
    """The first kind whose whole pattern a found value matches."""
    out = None
    for kind, pattern in PATTERNS.items():
        hit = value.rlike(rf"^(?:{pattern})$")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with personal data in the text column replaced, and how many values were in ``__replaced``.

    One alternation of all patterns finds the values; what lies between them is kept. The same value
    gives the same pseudonym in every document, so records stay linked; who has no key can't go
    back. All expressions run in the JVM, row by row, without a shuffle. Null texts stay null, empty ones empty,
    repeated rows stay, an empty table gives no rows, and texts may be of any length. All columns of docs stay
    whatever their names: if one is called ``__replaced``, ours gets an underscore more.
    """
    every = _alternation()
    text, held, count = named(text_col), fresh(docs, "__hits"), fresh(docs, "__replaced")
    # Every kind of value has a digit or an @: texts without one needn't be searched.
    hits = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(every), F.lit(0))).otherwise(F.array().cast("array<string>"))
    between = F.split(text, every, -1)
    # Not a lambda over both arrays' zip: each hit is computed once, from its own value.
    new = F.transform(named(held), lambda v: let(kind_of(v), lambda kind: pseudonym(v, kind, key)))
    rows = docs.withColumn(held, hits)
    joined = F.concat_ws("", F.flatten(F.transform(F.arrays_zip(between.alias("b"), F.concat(new, F.array(F.lit(""))).alias("n")), lambda z: F.array(z["b"], z["n"]))))
    rows = rows.withColumn(text_col, F.when(F.size(named(held)) > 0, joined).otherwise(text))
    return rows.withColumn(count, F.greatest(F.size(named(held)), F.lit(0)).cast("bigint")).drop(held)


def _alternation() -> str:
    """All patterns in one; those of numbers behind a look at the first character, which rules out most places.

    The only group that is referred back to gets a name.
    """
    named = {k: p.replace("([ -])", "(?<gap>[ -])").replace(r"\1", r"\k<gap>") for k, p in PATTERNS.items()}
    words = [named.pop(k) for k in ("email", "secret")]
    return "|".join([*words, f"(?=[0-9+(])(?:{'|'.join(named.values())})"])
