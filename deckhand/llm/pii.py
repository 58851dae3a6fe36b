"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

A text is cut at what looks like personal data; each piece is validated, and what passes is replaced by
another value of the same format. Numbers and dates go through a keyed Feistel network over exactly the
values that their format allows, so the replacement is valid again, two values never meet in one, and
equal values stay equal across documents, however they are punctuated:

- payment cards: the Luhn check must hold; first digit and length stay, the check digit is made anew;
- telephone numbers: of the North American plan, with valid area and exchange codes; any others with a
  country code, which stays, as does their first digit;
- social security numbers: valid area, group and serial number; IPv4 addresses: all 2^32;
- dates: a day of the same century.

Names in mail addresses and secrets have no such order; they get letters of a keyed hash.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deckhand.llm import common

ROUNDS = 8
#: The setting that holds the key of a corpus. Its name has "secret" in it, so that Spark redacts it where it lists settings.
KEY_SETTING = "spark.deckhand.pii.secret"

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
FORMATS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,6}\.[A-Za-z]{2,24}",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64}|(?i:password|passwd|secret|token|api_?key) ?[=:] ?\"?[A-Za-z0-9_+/=-]{8,128})(?![A-Za-z0-9])",
    "ipv4": rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9-])[12][0-9]{3}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9]|-[0-9])|(?<![0-9./])(?:0[1-9]|[12][0-9]|3[01])([./])(?:0[1-9]|[12][0-9]|3[01])\1[12][0-9]{3}(?![0-9]|[./][0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "intl": r"(?<![0-9A-Za-z+])\+[1-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{1,4}\)?){2,6}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z-])[1-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]|-[0-9])",
}
#: A number of the North American plan with its country code, of which "phone" has the usual ways to write it.
NORTH_AMERICAN = r"^1[2-9][0-9]{2}[2-9][0-9]{6}$"
#: Country codes, which no other begins with: of one digit, the assigned ones of two, else three.
COUNTRY = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: What all formats need at least; the check that most texts end with.
HINT = r"[0-9@]|AKIA|gh[pousr]_|sk-|(?i:password|passwd|secret|token|api_?key)"
#: Groups in it are all non-capturing but the one in "date".
ANY = "|".join(f"(?:{p})" for p in FORMATS.values())


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def number(x: Column) -> Column:
    return x.cast("long")


def padded(x: Column, width: int | Column) -> Column:
    return F.lpad(x.cast("string"), width, "0")


def mixed(key: str, salt: Column, i: Column, x: Column) -> Column:
    """A number below 2^52 that depends on the key, the format, the round and the half."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(key), salt, i.cast("string"), x.cast("string")), 256), 1, 13), 16, 10).cast("long")


def domain(salt: Column | str, left: Column, right: Column, a: Column | int, b: Column | int) -> Column:
    """A value as a pair left < a, right < b of a format; values of different formats are permuted apart."""
    as_column = lambda x: F.lit(x) if isinstance(x, (int, str)) else x
    long = lambda x, name: as_column(x).cast("long").alias(name)
    return F.struct(as_column(salt).alias("salt"), long(left, "l"), long(right, "r"), long(a, "a"), long(b, "b"))


def feistel(key: str, d: Column) -> Column:
    """A keyed permutation of a domain's pairs: each round adds a function of one half to the other."""

    def step(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        f = mixed(key, d["salt"], i, F.when(odd, s["r"]).otherwise(s["l"]))
        return F.struct(
            F.when(odd, F.pmod(s["l"] + f, d["a"])).otherwise(s["l"]).alias("l"),
            F.when(odd, s["r"]).otherwise(F.pmod(s["r"] + f, d["b"])).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(d["l"].alias("l"), d["r"].alias("r")), step)


def domain_of_digits(salt: Column, d: Column) -> Column:
    """All strings of as many digits, two at least and 30 at most."""
    n = F.length(d)
    half = F.floor(n / 2).cast("int")
    power = lambda k: F.pow(F.lit(10.0), k).cast("long")
    return domain(F.concat(salt, n.cast("string")), number(F.substr(d, F.lit(1), half)), number(F.substr(d, half + 1)), power(half), power(n - half))


def digits_of(x: Column) -> Column:
    """A pair as digits, as many as its domain has."""
    width = lambda k: F.length(x["d"][k].cast("string")) - 1
    return F.concat(padded(x["p"]["l"], width("a")), padded(x["p"]["r"], width("b")))


def luhn_sum(d: Column) -> Column:
    """Of all digits, where the last one counts once."""
    n = F.length(d)

    def add(total: Column, i: Column) -> Column:
        x = F.substr(d, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return total + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def laid_out(shape: Column, d: Column) -> Column:
    """The shape with its digits replaced by those of d, in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(s: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        return F.struct(
            F.concat(s["out"], F.when(is_digit, F.substr(d, s["k"], F.lit(1))).otherwise(c)).alias("out"),
            (s["k"] + is_digit.cast("int")).alias("k"),
        )

    return F.aggregate(F.regexp_extract_all(shape, F.lit("(?s)(.)"), F.lit(1)), start, step)["out"]


def token(key: str, kind: str, value: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), value), 256)


def date_of(m: Column) -> Column:
    """Year first; else month first, or day first where only that is a date. Null if neither is."""
    iso = F.try_to_timestamp(m, F.lit("yyyy-MM-dd"))
    plain = F.translate(m, ".", "/")
    month_first, day_first = F.try_to_timestamp(plain, F.lit("MM/dd/yyyy")), F.try_to_timestamp(plain, F.lit("dd/MM/yyyy"))
    return F.when(m.rlike("^[0-9]{4}"), iso).when(m.contains("."), day_first).otherwise(F.coalesce(month_first, day_first)).cast("date")


def domain_of_date(m: Column) -> Column:
    """Centuries have 36525 = 75 x 487 days if their first year is a leap year, else 36524 = 92 x 397."""
    day = date_of(m)
    century = F.floor(F.year(day) / 100).cast("int")
    leap = century % 4 == 0
    n, b = F.datediff(day, F.make_date(century * 100, F.lit(1), F.lit(1))), F.when(leap, 487).otherwise(397)
    return domain(F.concat(F.lit("date"), century.cast("string")), F.floor(n / b), n % b, F.when(leap, 75).otherwise(92), b)


def new_date(x: Column) -> Column:
    m = x["m"]
    first = F.make_date(F.substr(x["d"]["salt"], F.lit(5)).cast("int") * 100, F.lit(1), F.lit(1))
    moved = F.date_add(first, (x["p"]["l"] * x["d"]["b"] + x["p"]["r"]).cast("int"))
    month_first = ~m.contains(".") & F.try_to_timestamp(m, F.lit("MM/dd/yyyy")).isNotNull()
    form = F.when(m.rlike("^[0-9]{4}"), "yyyy-MM-dd").when(m.contains("."), "dd.MM.yyyy").when(month_first, "MM/dd/yyyy").otherwise("dd/MM/yyyy")
    return F.call_function("date_format", moved, form)


def domain_of_ipv4(m: Column) -> Column:
    o = F.split(m, r"\.")
    return domain("ipv4", number(o[0]) * 256 + number(o[1]), number(o[2]) * 256 + number(o[3]), 65536, 65536)


def new_ipv4(x: Column) -> Column:
    return F.concat_ws(".", *((F.floor(x["p"][k] / 256) if high else x["p"][k] % 256).cast("string") for k in "lr" for high in (True, False)))


def domain_of_ssn(m: Column) -> Column:
    """898 areas (666 isn't one), 99 groups, 9999 serial numbers."""
    area, group, serial = (number(F.split(m, "-")[k]) for k in range(3))
    rank = F.when(area > 666, area - 2).otherwise(area - 1)
    return domain("ssn", rank * 99 + group - 1, serial - 1, 898 * 99, 9999)


def new_ssn(x: Column) -> Column:
    rank = F.floor(x["p"]["l"] / 99)
    area = F.when(rank >= 665, rank + 2).otherwise(rank + 1)
    return F.concat_ws("-", padded(area, 3), padded(x["p"]["l"] % 99 + 1, 2), padded(x["p"]["r"] + 1, 4))


def domain_of_phone(m: Column) -> Column:
    """Area and exchange from 200 to 999, four more digits."""
    local = F.substring(digits(m), -10, 10)
    area, exchange = number(F.substring(local, 1, 3)) - 200, number(F.substring(local, 4, 3)) - 200
    return domain("phone", area * 800 + exchange, number(F.substring(local, 7, 4)), 640_000, 10_000)


def new_phone(x: Column) -> Column:
    d, out = digits(x["m"]), x["p"]
    new = F.concat((F.floor(out["l"] / 800) + 200).cast("string"), (out["l"] % 800 + 200).cast("string"), padded(out["r"], 4))
    return laid_out(x["m"], F.concat(F.substr(d, F.lit(1), F.length(d) - 10), new))


def kept_of_intl(m: Column) -> Column:
    """How many digits stay: the country code and the next digit."""
    return F.length(F.regexp_extract(digits(m), COUNTRY, 0)) + 1


def domain_of_intl(m: Column) -> Column:
    d, kept = digits(m), kept_of_intl(m)
    return domain_of_digits(F.concat(F.lit("intl"), F.substr(d, F.lit(1), kept), F.lit(":")), F.substr(d, kept + 1))


def new_intl(x: Column) -> Column:
    return laid_out(x["m"], F.concat(F.substr(digits(x["m"]), F.lit(1), kept_of_intl(x["m"])), digits_of(x)))


def domain_of_card(m: Column) -> Column:
    d = digits(m)
    return domain_of_digits(F.concat(F.lit("card"), F.substring(d, 1, 1), F.lit(":")), F.substr(d, F.lit(2), F.length(d) - 2))


def new_card(x: Column) -> Column:
    body = F.concat(F.substring(digits(x["m"]), 1, 1), digits_of(x))
    return laid_out(x["m"], F.concat(body, ((10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")))


def new_email(key: str, m: Column) -> Column:
    return F.concat(F.lit("p"), F.substring(token(key, "email", F.lower(m)), 1, 16), F.lit("@example.invalid"))


def new_secret(key: str, m: Column) -> Column:
    """As many characters of a keyed hash in the secret's place; its name or mark stays."""
    mark = F.regexp_extract(m, r"^(?:(?i:password|passwd|secret|token|api_?key) ?[=:] ?\"?|AKIA|gh[pousr]_|sk-)", 0)
    value = F.substr(m, F.length(mark) + 1)
    new = F.substr(F.concat(token(key, "secret", value), token(key, "secret+", value)), F.lit(1), F.length(value))
    return F.concat(mark, F.when(mark == "AKIA", F.upper(new)).otherwise(new))


#: The kinds that are permuted, with what gives their domain and writes the result.
PERMUTED = {
    "ipv4": (domain_of_ipv4, new_ipv4), "date": (domain_of_date, new_date), "ssn": (domain_of_ssn, new_ssn),
    "phone": (domain_of_phone, new_phone), "intl": (domain_of_intl, new_intl), "card": (domain_of_card, new_card),
}


def kind_of(m: Column) -> Column:
    """The first format that a piece passes; null if none, and then the piece stays."""
    more = {"date": lambda: date_of(m).isNotNull(), "intl": lambda: F.length(digits(m)).between(8, 15), "card": lambda: luhn_sum(digits(m)) % 10 == 0}
    kind = F.lit(None).cast("string")
    whole = lambda k: m.rlike(rf"\A(?:{FORMATS[k]})\z")
    for k in reversed(FORMATS):
        found = whole(k) & more[k]() if k in more else whole(k)
        kind = F.when(found | (whole("intl") & digits(m).rlike(NORTH_AMERICAN)) if k == "phone" else found, k).otherwise(kind)
    return kind


def by_kind(kind: Column, choices: dict[str, Column], other: Column) -> Column:
    out = other
    for k, column in choices.items():
        out = F.when(kind == k, column).otherwise(out)
    return out


def pseudonyms(key: str, pieces: Column) -> Column:
    """An array of kind and new for an array of pieces, in steps that each use the fields of the one before."""
    none = F.lit(None).cast("struct<salt:string,l:bigint,r:bigint,a:bigint,b:bigint>")
    x = F.transform(pieces, lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
    x = F.transform(x, lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), by_kind(x["kind"], {k: f(x["m"]) for k, (f, _) in PERMUTED.items()}, none).alias("d")))
    x = F.transform(x, lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), x["d"].alias("d"), F.when(x["d"].isNotNull(), feistel(key, x["d"])).alias("p")))
    plain = lambda x: {"email": new_email(key, x["m"]), "secret": new_secret(key, x["m"])}
    new = lambda x: by_kind(x["kind"], {k: f(x) for k, (_, f) in PERMUTED.items()} | plain(x), x["m"])
    return F.transform(x, lambda x: F.struct(x["kind"].alias("kind"), new(x).alias("new")))


def session_key(spark: SparkSession) -> str:
    """The key in the session's settings. A session without one gets one at random, which holds as long as it does.

    With a key that nobody knows pseudonyms can't be undone, and they are equal within the session only; to
    link values across sessions, or to undo pseudonyms, set a key and keep it.
    """
    found = spark.conf.get(KEY_SETTING, None)
    if not found:
        found = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, found)
    return found


def pseudonymize(df: DataFrame, key: str | None = None, text_col: str = "text") -> DataFrame:
    """df with personal data in its text replaced, and pii_kinds: the kinds of what was replaced, in order.

    Without a key the session's is taken. A null text stays null and has no kinds; a text without personal
    data stays as it is, byte for byte. Rows are worked on one by one, so repeated rows, ties, empty tables
    and very long texts need nothing special; other columns stay, and one named pii_kinds, in any case of
    letters, is replaced.
    """
    key = key or session_key(df.sparkSession)
    text = F.col(common.quoted(text_col))
    text_name, found_name = common.fresh(df, "_text", "_found")
    hit = text.rlike(HINT)
    nothing = F.expr("CAST(array() AS array<struct<kind:string,new:string>>)")
    found = F.when(hit, pseudonyms(key, F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))).otherwise(nothing)
    between = F.split(F.col(text_name), ANY, -1)
    joined = F.concat(between[0], F.array_join(F.zip_with(F.col(f"{found_name}.new"), F.slice(between, 2, F.greatest(F.size(found_name), F.lit(1))), lambda n, b: F.concat(n, b)), ""))
    kinds = F.filter(F.col(f"{found_name}.kind"), lambda k: k.isNotNull())
    replaced = F.when(F.size(found_name) > 0, joined).otherwise(F.col(text_name))
    columns = [F.col(common.quoted(c)) if c != text_col else replaced.alias(c) for c in common.others(df, ["pii_kinds"])]
    return df.withColumns({text_name: text, found_name: found}).select(*columns, kinds.alias("pii_kinds"))


def pii_digest(df: DataFrame) -> DataFrame:
    """doc_id, the new text, and how many values of each kind were replaced."""
    out = pseudonymize(df.select("doc_id", "text"))
    counts = [F.expr(f"CAST(size(filter(pii_kinds, k -> k = '{name}')) AS LONG) AS n_{name}") for name in FORMATS]
    return out.select("doc_id", "text", F.size("pii_kinds").cast("long").alias("n_replaced"), *counts)
