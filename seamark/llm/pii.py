"""Personal data replaced by format-preserving pseudonyms, in built-in functions only."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamark.llm.common import fresh

ROUNDS = 8
#: Words before a secret in hex digits, with whatever quote, spaces and separator follow; a password may be shorter.
LONG_WORDS = r"(?i:(?:api|access|secret|private|auth)[ _.-]?key|secret|token)"
SHORT_WORDS = r"(?i:password|passwd|passphrase|pwd)"
THEN = r"[\"']?\s*+[:=]{1,2}+>?+\s*+[\"']?"
ACCESS = r"\bAKIA[0-9A-Z]{16}\b"
#: Keys that are known by how they begin.
MARKED = r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}+|sk_(?:live|test)_[A-Za-z0-9]{10,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|eyJ[A-Za-z0-9_-]{5,}+\.[A-Za-z0-9_-]{5,}+\.[A-Za-z0-9_-]{5,}+)(?![A-Za-z0-9_-])"
#: After the same words, any eight signs or more with a letter and a digit.
SIGNS = r"[^\s\"'<>,;:=]"
MIXED = rf"(?:{SHORT_WORDS}|{LONG_WORDS}){THEN}(?={SIGNS}*?[A-Za-z])(?={SIGNS}*?[0-9]){SIGNS}{{8,}}+"
NAMED = rf"(?:{SHORT_WORDS}{THEN}[0-9A-Fa-f]{{8,}}+|{LONG_WORDS}{THEN}[0-9A-Fa-f]{{16,}}+)\b"
#: What may be personal data, by kind; Java patterns without capturing groups.
PATTERNS = {
    "secret": rf"{ACCESS}|{NAMED}",
    "marked": MARKED,
    "mixed": MIXED,
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,126}[A-Za-z]{2,}+",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ip6": r"(?<![0-9A-Za-z:.])(?=[A-Fa-f:]*+[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9/-]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
    r"|(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
#: Runs of groups that a failed candidate was part of, by kind.
RUNS = {
    "iban": r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]*+\b(?: [A-Z0-9]++\b)++",
    "card": r"[0-9]++(?:[ -][0-9]++)++",
}
#: The forms of card numbers in print, which go before other windows of 13 to 19 digits.
CARD_FORM = r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})$"
#: What is looked for in turn where a candidate failed, each in what those before left: windows of a run
#: (kind, form, most groups), or the patterns of kinds.
AGAIN = [
    ("iban", r"^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?$", 9),
    ("card", CARD_FORM, 5),
    "|".join(PATTERNS[k] for k in ("secret", "marked", "mixed", "email", "ip", "ip6", "date", "ssn")),
    ("card", r"^[0-9](?:[ -]?[0-9]){12,18}$", 19),
    PATTERNS["phone"].partition("|(?<!")[0],
    PATTERNS["phone"],
]
PIECES = "array<struct<value:string,kind:string>>"
#: Signs of an account by country; in windows, other countries may have any length.
IBAN_SIGNS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL OM SO", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Cheap test that a text may hold any of them.
MAY_HOLD = rf"[0-9@]|AKIA|eyJ|\bgh[pousr]_|\bsk_|\bxox|{SHORT_WORDS}{THEN}|{LONG_WORDS}{THEN}"
#: Days from 1800-01-01 to 2199-12-31, one cycle of the calendar, as a product.
DAYS = (189, 773)
FIRST_DAY = "1800-01-01"


def keyed(key: str, *parts: Column) -> Column:
    """A number of 60 bits that key and parts decide."""
    text = F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def feistel_pair(left: Column, right: Column, sizes: tuple[int, int], key: str) -> Column:
    """Struct (l, r): a keyed permutation of pairs below ``sizes``; each round adds a function of one half to the other."""

    def step(state: Column, r: Column) -> Column:
        l_new = (state["l"] + keyed(key, r, state["r"])) % sizes[0]
        r_new = (state["r"] + keyed(key, r, state["l"])) % sizes[1]
        even = r % 2 == 0
        return F.struct(F.when(even, l_new).otherwise(state["l"]).alias("l"), F.when(even, state["r"]).otherwise(r_new).alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def turned(c: Column, by: Column, alphabet: str | None) -> Column:
    """A sign moved on by ``by`` within its alphabet: of those given, divided by spaces, else of digits, small or capital letters; others stay."""
    if alphabet:
        out = c
        for signs in alphabet.split():
            place = F.instr(F.lit(signs), c)
            moved = F.substring(F.lit(signs), ((place - 1 + by) % len(signs) + 1).cast("int"), F.lit(1))
            out = F.when(place > 0, moved).otherwise(out)
        return out

    def within(first: int, size: int) -> Column:
        return F.char((F.ascii(c) - first + by) % size + first)

    return (
        F.when(c.between("0", "9"), within(48, 10)).when(c.between("a", "z"), within(97, 26))
        .when(c.between("A", "Z"), within(65, 26)).otherwise(c)
    )


def feistel_text(text: Column, key: str, alphabet: str | None = None) -> Column:
    """A keyed permutation of texts of one format.

    The signs at even places are one half, those at odd places the other; each
    round moves the signs of one half on, each within its alphabet, by a function of the other half.
    """
    signs = F.filter(F.split(text, ""), lambda c: c != "")

    def step(state: Column, r: Column) -> Column:
        other = F.array_join(F.filter(state, lambda c, i: i % 2 != r % 2), "")
        parts = F.struct(state.alias("signs"), other.alias("other"))
        return F.aggregate(
            F.array(parts), F.array().cast("array<string>"),
            lambda _, p: F.transform(p["signs"], lambda c, i: F.when(i % 2 == r % 2, turned(c, keyed(key, r, i, p["other"]), alphabet)).otherwise(c)),
        )

    return F.array_join(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), signs, step), "")


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Checksum of card numbers, the last digit counted once."""
    signs = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    values = F.transform(signs, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c > "4", 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def refill(shape: Column, signs: Column) -> Column:
    """``shape`` with its letters and digits replaced by ``signs``, one after another; what stands between stays."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))

    def step(state: Column, c: Column) -> Column:
        own = c.rlike("[A-Za-z0-9]")
        return F.struct(
            F.concat(state["out"], F.when(own, F.substring(signs, state["next"], F.lit(1))).otherwise(c)).alias("out"),
            (state["next"] + F.when(own, 1).otherwise(0)).alias("next"),
        )

    return F.aggregate(F.filter(F.split(shape, ""), lambda c: c != ""), start, step)["out"]


def new_card(value: Column, key: str) -> Column:
    """All digits but the last are permuted; the last makes the checksum right again."""
    digits = digits_of(value)
    body = feistel_text(F.substring(digits, F.lit(1), F.length(digits) - 1), key + "card")
    check = (10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    return refill(value, F.concat(body, check.cast("string")))


def iban_rest(country_first: Column) -> Column:
    """Remainder by 97 of account signs, country and check digits, letters as 10 to 35."""
    signs = F.filter(F.split(country_first, ""), lambda c: c != "")
    return F.aggregate(
        signs, F.lit(0).cast("long"),
        lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + c.cast("long")).otherwise(a * 100 + F.ascii(c) - 55) % 97,
    )


def new_iban(value: Column, key: str) -> Column:
    """The account is permuted sign by sign, the country stays, and the check digits are made right again."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    account = feistel_text(F.substring(plain, F.lit(5), F.length(plain)), key + "iban")
    country = F.substring(plain, 1, 2)
    check = 98 - iban_rest(F.concat(account, country, F.lit("00")))
    return refill(value, F.concat(country, F.lpad(check.cast("string"), 2, "0"), account))


def octet(value: Column, k: int) -> Column:
    return F.split(value, r"\.")[k].cast("long")


def new_ip(value: Column, key: str) -> Column:
    pair = feistel_pair(octet(value, 0) * 256 + octet(value, 1), octet(value, 2) * 256 + octet(value, 3), (1 << 16, 1 << 16), key + "ip")

    def two(x: Column) -> list[Column]:
        return [F.floor(x / 256).cast("string"), (x % 256).cast("string")]

    return F.concat_ws(".", *two(pair["l"]), *two(pair["r"]))


def date_format(value: Column) -> Column:
    """The format in which the value is a day; null for none. With strokes the month comes first if it can."""
    in_range = lambda f: F.try_to_timestamp(value, F.lit(f)).between("1800-01-01", "2199-12-31")
    return (
        F.when(value.contains("-"), F.when(in_range("yyyy-MM-dd"), "yyyy-MM-dd"))
        .when(value.contains("."), F.when(in_range("dd.MM.yyyy"), "dd.MM.yyyy"))
        .when(value.rlike("^[0-9]{4}/"), F.when(in_range("yyyy/MM/dd"), "yyyy/MM/dd"))
        .otherwise(F.when(in_range("MM/dd/yyyy"), "MM/dd/yyyy").when(in_range("dd/MM/yyyy"), "dd/MM/yyyy"))
    )


def new_date(value: Column, key: str) -> Column:
    out = F.lit(None).cast("string")
    known = date_format(value)
    for f in ("yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", "MM/dd/yyyy", "dd/MM/yyyy"):
        day = F.datediff(F.try_to_timestamp(value, F.lit(f)).cast("date"), F.lit(FIRST_DAY).cast("date"))
        pair = feistel_pair(F.floor(day / DAYS[1]), day % DAYS[1], DAYS, key + "date")
        moved = F.date_add(F.lit(FIRST_DAY).cast("date"), (pair["l"] * DAYS[1] + pair["r"]).cast("int"))
        out = F.when(known == f, F.date_format(moved, f)).otherwise(out)
    return out


def new_ssn(value: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99 and numbers 0001 to 9999 are permuted among themselves."""
    area = F.substring(value, 1, 3).cast("long")
    area = area - 1 - F.when(area > 666, 1).otherwise(0)
    left = area * 99 + F.substring(value, 5, 2).cast("long") - 1
    pair = feistel_pair(left, F.substring(value, 8, 4).cast("long") - 1, (898 * 99, 9999), key + "ssn")
    area = F.floor(pair["l"] / 99) + 1
    area = area + F.when(area >= 666, 1).otherwise(0)
    return F.concat_ws(
        "-", F.lpad(area.cast("string"), 3, "0"), F.lpad((pair["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((pair["r"] + 1).cast("string"), 4, "0")
    )


def new_phone(value: Column, key: str) -> Column:
    """The country's digits stay if marked by a plus; all other digits are permuted."""
    country = F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    rest = F.substring(value, F.length(country) + 1, F.length(value))
    return F.concat(country, refill(rest, feistel_text(digits_of(rest), key + "phone")))


def new_email(value: Column, key: str) -> Column:
    """The name before the sign is permuted, its marks stay; the domain's first label as well, the rest stays."""
    name, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    label = F.substring_index(domain, ".", 1)
    rest = F.substring(domain, F.length(label) + 1, F.length(domain))
    return F.concat(feistel_text(name, key + "name"), F.lit("@"), feistel_text(label, key + "label"), rest)


def new_secret(value: Column, key: str) -> Column:
    """The signs after AKIA are permuted, or the hex digits at the end; the words before those stay."""
    access = F.concat(F.lit("AKIA"), feistel_text(F.substring(value, 5, 16), key + "access", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = F.regexp_extract(value, "[0-9A-Fa-f]+$", 0)
    before = F.substring(value, F.lit(1), F.length(value) - F.length(digits))
    # With capitals, each sign stays in its class, so that these have no pseudonym in common with those in small letters.
    small, mixed = (feistel_text(digits, key + "hex", a) for a in ("0123456789abcdef", "0123456789 abcdef ABCDEF"))
    return F.when(value.startswith("AKIA"), access).otherwise(F.concat(before, F.when(digits.rlike("[A-F]"), mixed).otherwise(small)))


def new_marked(value: Column, key: str) -> Column:
    """What follows the mark is permuted, each sign within digits, small or capital letters."""
    mark = F.regexp_extract(value, "^(?:gh[pousr]_|sk_(?:live|test)_|xox[abprs]-|eyJ)", 0)
    return F.concat(mark, feistel_text(F.substring(value, F.length(mark) + 1, F.length(value)), key + "marked"))


def new_mixed(value: Column, key: str) -> Column:
    """The signs at the end are permuted, each within digits, small or capital letters; other signs and the words before stay."""
    end = F.regexp_extract(value, SIGNS + "+$", 0)
    return F.concat(F.substring(value, F.lit(1), F.length(value) - F.length(end)), feistel_text(end, key + "mixed"))


def new_ip6(value: Column, key: str) -> Column:
    return feistel_text(value, key + "ip6", "0123456789 abcdef ABCDEF")


def checks(value: Column) -> dict[str, Column]:
    """By kind, whether the whole value has its pattern and passes its check."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    digits = digits_of(value)
    return {
        "secret": value.rlike(rf"^(?:{ACCESS}|{NAMED})$"),
        "marked": value.rlike(rf"^{MARKED}$"),
        "mixed": value.rlike(rf"^{MIXED}$"),
        "email": value.contains("@"),
        "iban": value.rlike("^[A-Z]{2}[0-9]{2}") & (F.length(plain).between(15, 34))
        & (iban_rest(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1),
        "ip": value.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"),
        "ip6": value.rlike("^[0-9A-Fa-f:]+$") & value.contains(":"),
        "date": value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$|^[0-9]{4}/[0-9]{2}/[0-9]{2}$|^[0-9]{2}([./])[0-9]{2}\1[0-9]{4}$") & date_format(value).isNotNull(),
        "ssn": value.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"),
        "card": value.rlike("^[0-9](?:[ -]?[0-9]){12,18}$") & (luhn_sum(digits) % 10 == 0) & ~digits.rlike("^0+$"),
        "phone": value.rlike("^(?:[+(]|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$)") & F.length(digits).between(7, 15),
    }


def kind_of(value: Column) -> Column:
    """The kind whose pattern the whole value has and whose check it passes; null for none."""
    out = F.lit(None).cast("string")
    for kind, holds in reversed(checks(value).items()):
        out = F.when(holds, kind).otherwise(out)
    return out


NEW = {
    "secret": new_secret, "marked": new_marked, "mixed": new_mixed, "email": new_email, "iban": new_iban, "ip": new_ip, "ip6": new_ip6, "date": new_date, "ssn": new_ssn, "card": new_card, "phone": new_phone,
}


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    out = value
    for name, new in NEW.items():
        out = F.when(kind == name, new(value, key)).otherwise(out)
    return out


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once."""
    return F.transform(F.array(value), use)[0]


def piece(value: Column, kind: Column | None = None) -> Column:
    return F.struct(value.alias("value"), (F.lit(None) if kind is None else kind).cast("string").alias("kind"))


def cut(pieces: Column, found: Column) -> Column:
    """Pieces (value, kind) of a text from what stands between candidates and the candidates; those without a kind join what is around them."""

    def between(s: Column, marks: Column, k: Column) -> Column:
        low, high = marks[k - 1] + 1, marks[k]
        left = F.transform(F.sequence(low, high), lambda i: F.concat(s["pieces"][i], F.when(i < high, F.get(s["found"], i)["value"]).otherwise("")))
        value = F.transform(F.slice(s["found"], high + 1, F.lit(1)), lambda f: piece(f["value"], f["kind"]))
        return F.concat(F.array(piece(F.array_join(left, ""))), value)

    def parts(s: Column) -> Column:
        count = F.size(s["found"])
        valid = F.filter(F.transform(s["found"], lambda f, i: F.when(f["kind"].isNotNull(), i)), lambda i: i.isNotNull())
        marks = F.concat(F.array(F.lit(-1)), valid, F.array(count))
        return once(marks, lambda m: F.flatten(F.transform(F.sequence(F.lit(1), F.size(m) - 1), lambda k: between(s, m, k))))

    whole = F.struct(pieces.alias("pieces"), found.alias("found"))
    return F.when(found.isNotNull(), once(whole, parts))


def cut_by(text: Column, pattern: str) -> Column:
    return cut(F.split(text, pattern, -1), candidates(text, pattern))


def candidates(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda v: piece(v, kind_of(v)))


def windows(run: Column, kind: str, form: str, most: int) -> Column:
    """Pieces of a run of groups: from the left, the longest window of whole groups that has the form and passes the check, and what is between."""
    lengths = F.map_from_arrays(
        F.array(*[F.lit(c) for codes in IBAN_SIGNS.values() for c in codes.split()]),
        F.array(*[F.lit(n) for n, codes in IBAN_SIGNS.items() for _ in codes.split()]),
    )

    def holds(value: Column) -> Column:
        good = value.rlike(form) & checks(value)[kind]
        if kind == "iban":
            signs = F.length(F.replace(value, F.lit(" "), F.lit("")))
            good = good & (signs == F.coalesce(F.try_element_at(lengths, F.substring(value, 1, 2)), signs))
        return good

    def end(groups: Column, i: Column) -> Column:
        """The last group of the window that starts at group i; null for none."""
        last = F.least(i + most, F.size(groups)) - 1
        found = lambda j: holds(F.rtrim(F.array_join(F.slice(groups, i + 1, j - i + 1), ""), F.lit(" -")))
        return F.get(F.reverse(F.filter(F.sequence(i, last), found)), F.lit(0))

    def scan(groups: Column) -> Column:
        # Groups keep the sign after them; a window ends before that of its last group.
        def step(state: Column, i: Column) -> Column:
            stop = F.when(i >= state["next"], end(groups, i))
            return once(
                stop,
                lambda e: F.when(
                    e.isNotNull(),
                    F.struct((e + 1).alias("next"), F.concat(state["spans"], F.array(F.struct(i.alias("first"), e.alias("last")))).alias("spans")),
                ).otherwise(state),
            )

        start = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<first:int,last:int>>").alias("spans"))
        spans = F.aggregate(F.sequence(F.lit(0), F.size(groups) - 1), start, step)["spans"]
        return once(spans, lambda found: parts(groups, found))

    def parts(groups: Column, spans: Column) -> Column:
        text = lambda a, b: F.array_join(F.slice(groups, a + 1, b - a + 1), "")
        bare = lambda t: F.rtrim(t, F.lit(" -"))

        def before(s: Column, k: Column) -> Column:
            low = F.when(k > 0, F.get(spans, k - 1)["last"] + 1).otherwise(0)
            gap = F.when(k > 0, F.substring(groups[low - 1], F.length(bare(groups[low - 1])) + 1, F.lit(1))).otherwise("")
            return F.concat(gap, text(low, s["first"] - 1))

        body = F.flatten(F.transform(spans, lambda s, k: F.array(piece(before(s, k)), piece(bare(text(s["first"], s["last"])), F.lit(kind)))))
        closing = F.struct(F.size(groups).alias("first"))
        return F.concat(body, F.array(piece(before(closing, F.size(spans)))))

    return once(F.regexp_extract_all(run, F.lit("[A-Z0-9]+[ -]?"), F.lit(0)), scan)


def search_again(pieces: Column, step: str | tuple) -> Column:
    """``pieces`` with those without a kind searched for what a failed candidate may have swallowed, by a step of ``AGAIN``."""

    def search(pattern: str, within: Callable[[Column], Column]) -> Column:
        none = lambda p: p["kind"].isNotNull() | ~p["value"].rlike(pattern)
        return F.flatten(F.transform(pieces, lambda p: F.when(none(p), F.array(p)).otherwise(within(p["value"]))))

    def of_runs(text: Column, run: str, kind: str, form: str, most: int) -> Column:
        # No value of either kind has fewer than 13 signs.
        of_run = lambda r: F.when(F.length(r) > 13, windows(r, kind, form, most)).otherwise(F.array(piece(r)))
        kept = F.transform(F.split(text, run, -1), lambda p: F.array(piece(p)))
        found = F.transform(F.regexp_extract_all(text, F.lit(run), F.lit(0)), of_run)
        flat = F.flatten(F.zip_with(kept, found, lambda p, f: F.concat(p, F.coalesce(f, F.array().cast(PIECES)))))
        # What is left around and within runs is one text again.
        return once(flat, lambda p: cut(F.array_repeat(F.lit(""), F.size(p) + 1), p))

    if isinstance(step, str):
        return search(step, partial(cut_by, pattern=step))
    kind, form, most = step
    return search(RUNS[kind], partial(of_runs, run=RUNS[kind], kind=kind, form=form, most=most))


def pseudonymise(docs: DataFrame, key: str, text: str = "text", kinds: str | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; with ``kinds``, a column of that name lists what was replaced.

    Values are found by pattern and checked: card numbers and accounts by their checksums,
    addresses and social security numbers by their ranges, days by the calendar. Where a candidate
    fails its check, what no other value takes is searched again: windows of whole groups for accounts and cards,
    then the other kinds. What fails there too stays as it is. A pseudonym is a keyed permutation of the value within its
    format (a Feistel network), so equal values have equal pseudonyms in all documents, different ones
    different ones, and checksums hold again. Country codes, mail domains but their first label, and separators stay.

    A null or empty text stays so. Rows are looked at one by one: no shuffle, nothing to skew.
    """
    pattern = "|".join(PATTERNS.values())
    body = F.col(f"`{text}`")
    may = body.rlike(MAY_HOLD)
    # Columns of their own, so that each step is found once and analysed by itself.
    held, failed = fresh(docs, "pieces"), fresh(docs, "failed")
    found = docs.withColumn(held, F.when(may, candidates(body, pattern)))
    found = found.withColumns({
        failed: F.exists(F.col(held), lambda f: f["kind"].isNull()), held: cut(F.when(may, F.split(body, pattern, -1)), F.col(held))
    })
    for step in AGAIN:
        found = found.withColumn(held, F.when(F.col(failed), search_again(F.col(held), step)).otherwise(F.col(held)))
    joined = F.array_join(
        F.transform(F.col(held), lambda p: F.when(p["kind"].isNull(), p["value"]).otherwise(pseudonym(p["value"], p["kind"], key))), ""
    )
    out = {text: F.coalesce(joined, body)}
    if kinds:
        listed = F.filter(F.transform(F.col(held), lambda p: p["kind"]), lambda k: k.isNotNull())
        out[kinds] = F.coalesce(listed, F.array().cast("array<string>"))
    return found.withColumns(out).drop(held, failed)
