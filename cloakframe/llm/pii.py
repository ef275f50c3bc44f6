"""Format-preserving pseudonyms for personal numbers, dates and e-mail addresses.

Everything is DataFrame expressions. One pattern finds candidates, each is validated (Luhn,
mod 97, number plan, calendar, octets), and a valid one is replaced by a keyed permutation
of its format: a Feistel network of ten rounds over its digits or its index, whose round
function is SHA-256 with the key. Where the format isn't a power of ten or 26, the network
is repeated until it lands inside (cycle walking). Check digits are computed anew, and
separators stay. So equal values become equal pseudonyms in all documents, different ones
of a format stay different, and no table of values is needed: no row meets another.

| kind | validated by | permuted |
| --- | --- | --- |
| iban | mod 97 | the digits after the check digits |
| card | 13 to 19 digits, Luhn | all digits but the check digit |
| ssn | area, group and serial of US numbers | the valid numbers |
| phone | North American plan, or + and 7 to 15 digits | area, exchange and line; or all but two digits |
| ip | four octets | the 2^32 addresses |
| date | the calendar, 1900 to 2099 | the days of these 200 years; up to the 12th of a month and later ones apart, so that a date with slashes reads in one way before and after |
| email | its shape | the part before @, in lower case: its digits, its letters a to z, and each other letter or number inside its own run of 128 code points |

Parts that are longer than a network takes are permuted piece by piece, each tweaked by the
pieces before it; so are the letters beyond a to z. Different names of one shape thus have
different pseudonyms, in any script and at any length.

Invalid candidates stay as they are. Null text stays null, empty text empty. Repeated rows
and equal values get equal pseudonyms. Texts of any length are one expression each. Columns
other than the text are kept, whatever their names; one named like found_col is replaced.
A walk ends within 64 steps but for a chance under 1e-13; if not, the query fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_prefix

ROUNDS = 10
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
DATE = r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-])"
IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
PHONE = r"(?<![0-9A-Za-z+])(?:(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}|\+[2-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{2,4}\)?){2,5})(?![0-9])"
KINDS = ("iban", "date", "ip", "ssn", "card", "phone")
NUMBERS = "|".join((IBAN, DATE, IP, SSN, CARD, PHONE))
#: No text without this has any of the above.
HINT = r"[0-9][^0-9]{0,3}[0-9][^0-9]{0,3}[0-9][^0-9]{0,3}[0-9]"


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _power(base: int, n: Column) -> Column:
    most = {10: 18, 26: 13}[base]
    return F.element_at(F.array(*[F.lit(base**i).cast("long") for i in range(most + 1)]), (n + 1).cast("int"))


def _noise(key: str, tweak: Column, i: Column, half: Column) -> Column:
    """60 keyed bits."""
    return F.conv(
        F.substring(F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), half.cast("string")), 256), 1, 15),
        16,
        10,
    ).cast("long")


def _network(a: Column, b: Column, mod_a: Column, mod_b: Column, key: str, tweak: Column) -> Column:
    """struct(a, b) after the rounds; a is below mod_a, b below mod_b, before and after."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    turn = lambda s, i: F.struct(
        s["b"].alias("a"),
        F.pmod(s["a"] + _noise(key, tweak, i, s["b"]), F.when(i % 2 == 0, mod_a).otherwise(mod_b)).alias("b"),
    )
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _ended(v: Column, ok: Column) -> Column:
    """v at the end of a walk."""
    return F.when(ok, v).otherwise(F.raise_error(F.lit("a permutation's walk didn't end")).cast("long"))


def permute(x: Column, size: int, key: str, tweak: str | Column) -> Column:
    """A keyed permutation of the numbers from 0 to size - 1, by cycle walking in a power of ten."""
    low = 10 ** ((len(str(size - 1)) + 1) // 2)
    high = -(-size // low)  # the walk leaves less than one in high

    def once(v: Column) -> Column:
        return F.transform(
            F.array(
                _network(
                    F.floor(v / F.lit(low)).cast("long") if size < 1 << 50 else v,
                    F.pmod(v, F.lit(low)),
                    F.lit(high).cast("long"),
                    F.lit(low).cast("long"),
                    key,
                    _lit(tweak),
                )
            ),
            lambda s: s["a"] * low + s["b"],
        )[0]

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(64)),
        once(x.cast("long")),
        lambda v, _: F.when(v < size, v).otherwise(once(v)),
        lambda v: _ended(v, v < size),
    )


def permute_days(n: Column, key: str) -> Column:
    """A keyed permutation of the days from 1900-01-01 (0) to 2099-12-31 that takes days after the 12th of a month to such days."""
    late = lambda v: F.dayofmonth(F.date_add(F.lit("1900-01-01").cast("date"), v.cast("int"))) > 12
    once = lambda v: permute(v, 73049, key, "date")
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(64)),
        once(n.cast("long")),
        lambda v, _: F.when(late(v) == late(n), v).otherwise(once(v)),
        lambda v: _ended(v, late(v) == late(n)),
    )


def in_pieces(s: Column, most: int, f) -> Column:
    """f(piece, tweak) of each piece of `most` characters, joined; a piece's tweak is what the pieces before it became."""
    last = F.floor((F.length(s) - 1) / F.lit(most)).cast("int")
    made = F.aggregate(
        F.sequence(F.lit(0), last),
        F.lit(""),
        lambda done, i: F.concat(done, f(F.substring(s, i * most + 1, F.lit(most)), done)),
    )
    return F.when(F.length(s) > 0, made).otherwise("")


def permute_digits(d: Column, key: str, tweak: str | Column) -> Column:
    """A keyed permutation of the strings of as many digits (1 to 36)."""
    n = F.length(d)
    u = F.floor(n / 2).cast("int")
    v = n - u
    a = F.coalesce(F.substring(d, F.lit(1), u).try_cast("long"), F.lit(0).cast("long"))
    b = F.substring(d, u + 1, v).try_cast("long")
    net = _network(a, b, _power(10, u), _power(10, v), key, F.concat(_lit(tweak), n.cast("string")))
    return F.transform(
        F.array(net),
        lambda s: F.concat(
            F.when(u > 0, F.lpad(s["a"].cast("string"), u, F.lit("0"))).otherwise(""),
            F.lpad(s["b"].cast("string"), v, F.lit("0")),
        ),
    )[0]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _refill(m: Column, digits: Column, letters: Column | None = None, others: Column | None = None) -> Column:
    """m with its digits (and its letters a to z, and its other letters) replaced in order."""
    def at(i):
        ch, to = F.substring(m, i, F.lit(1)), F.substring(m, F.lit(1), i)
        put = F.when(ch.rlike("[0-9]"), F.substring(digits, F.length(F.regexp_replace(to, "[^0-9]", "")), F.lit(1)))
        if letters is not None:
            put = put.when(ch.rlike("[a-z]"), F.substring(letters, F.length(F.regexp_replace(to, "[^a-z]", "")), F.lit(1)))
            put = put.when(ch.rlike(r"[\p{L}\p{N}]"), F.substring(others, F.length(F.regexp_replace(to, _NOT_OTHER, "")), F.lit(1)))
        return put.otherwise(ch)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), at), "")


def _luhn(d: Column, doubled_first: bool) -> Column:
    """The Luhn sum; doubled_first: the last digit counts double (a number without its check digit)."""
    back, odd = F.reverse(d), 1 if doubled_first else 0

    def term(s, i):
        v = F.substring(back, i, F.lit(1)).cast("int")
        t = F.when(i % 2 == odd, F.when(v > 4, v * 2 - 9).otherwise(v * 2)).otherwise(v)
        return s + t

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), term)


def _mod97(s: Column) -> Column:
    """A string of digits and A to Z (10 to 35), modulo 97."""
    def step(acc, ch):
        v = F.when(ch.rlike("[0-9]"), ch.try_cast("int")).otherwise(F.ascii(ch) - 55)
        return (acc * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0), step)


def _full(pattern: str) -> str:
    return "^(?:" + pattern + ")$"


def _iban(m: Column, key: str) -> tuple[Column, Column]:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    body, head = F.substring(plain, 5, 40), F.substring(plain, 1, 2)
    digits = _digits(body)
    new = _refill(body, permute_digits(digits, key, "iban"))
    check = F.lpad((F.lit(98) - _mod97(F.concat(new, head, F.lit("00")))).cast("string"), F.lit(2), F.lit("0"))
    made = F.concat(head, check, new)
    spaced = F.array_join(
        F.transform(
            F.sequence(F.lit(1), F.length(m)),
            lambda i: F.when(F.substring(m, i, F.lit(1)) == " ", F.lit(" ")).otherwise(
                F.substring(made, F.length(F.replace(F.substring(m, F.lit(1), i), F.lit(" "), F.lit(""))), F.lit(1))
            ),
        ),
        "",
    )
    ok = (_mod97(F.concat(body, F.substring(plain, 1, 4))) == 1) & (F.length(digits) > 0)
    return ok, spaced


def _date(m: Column, key: str) -> tuple[Column, Column]:
    iso, slash = m.rlike("^[0-9]{4}"), m.rlike("/")
    first, second = F.substring(m, 1, 2).cast("int"), F.substring(m, 4, 2).cast("int")
    month_first = slash & (second > 12)
    form = lambda d: F.when(iso, F.date_format(d, "yyyy-MM-dd")).when(
        month_first,
        F.date_format(d, "MM/dd/yyyy"),
    ).when(slash, F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "dd.MM.yyyy"))
    year = F.when(iso, F.substring(m, 1, 4)).otherwise(F.substring(m, 7, 4)).cast("int")
    month = F.when(iso, F.substring(m, 6, 2).cast("int")).when(month_first, first).otherwise(second)
    day = F.when(iso, F.substring(m, 9, 2).cast("int")).when(month_first, second).otherwise(first)
    at = F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")
    day_no = F.datediff(at, F.lit("1900-01-01").cast("date"))
    new = F.date_add(F.lit("1900-01-01").cast("date"), permute_days(day_no, key).cast("int"))
    return at.isNotNull() & (year >= 1900) & (year <= 2099), form(new)


def _ip(m: Column, key: str) -> tuple[Column, Column]:
    part = lambda i: F.element_at(F.split(m, r"\."), i).cast("long")
    x = part(1) * (1 << 24) + part(2) * (1 << 16) + part(3) * (1 << 8) + part(4)
    new = permute(x, 1 << 32, key, "ip")
    dotted = F.transform(
        F.array(new),
        lambda v: F.concat_ws(".", *[F.pmod(F.shiftright(v, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]),
    )[0]
    return (part(1) < 256) & (part(2) < 256) & (part(3) < 256) & (part(4) < 256), dotted


def _ssn(m: Column, key: str) -> tuple[Column, Column]:
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    ok = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    x = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1
    new = permute(x, 898 * 99 * 9999, key, "ssn")

    def show(v):
        a = F.floor(v / F.lit(99 * 9999)).cast("long") + 1
        return F.format_string(
            "%03d-%02d-%04d",
            F.when(a >= 666, a + 1).otherwise(a),
            F.pmod(F.floor(v / F.lit(9999)).cast("long"), F.lit(99)) + 1,
            F.pmod(v, F.lit(9999)) + 1,
        )

    return ok, F.transform(F.array(new), show)[0]


def _card(m: Column, key: str) -> tuple[Column, Column]:
    d = _digits(m)
    new = permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
    made = F.transform(F.array(new), lambda p: F.concat(p, F.pmod(F.lit(10) - _luhn(p, True) % 10, F.lit(10)).cast("string")))[0]
    return (F.pmod(_luhn(d, False), F.lit(10)) == 0) & d.rlike("[1-9]"), F.transform(F.array(made), lambda p: _refill(m, p))[0]


def _phone(m: Column, key: str) -> tuple[Column, Column]:
    d = _digits(m)
    plan = m.rlike(r"^(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}$")
    own = F.right(d, F.lit(10))
    area, exchange, line = (F.substring(own, a, n).cast("long") for a, n in ((1, 3), (4, 3), (7, 4)))
    north = plan & (area >= 200) & (exchange >= 200)
    new = permute(((area - 200) * 800 + exchange - 200) * 10000 + line, 800 * 800 * 10000, key, "phone")
    shown = F.transform(
        F.array(new),
        lambda v: F.format_string(
            "%03d%03d%04d",
            F.floor(v / F.lit(8_000_000)).cast("long") + 200,
            F.pmod(F.floor(v / F.lit(10000)).cast("long"), F.lit(800)) + 200,
            F.pmod(v, F.lit(10000)),
        ),
    )[0]
    head = F.when(north, F.left(d, F.length(d) - 10)).when(plan, F.left(d, F.length(d) - 10)).otherwise(F.left(d, F.lit(2)))
    rest = F.when(north, shown).when(plan, permute_digits(own, key, "phone1")).otherwise(
        permute_digits(F.substring(d, F.lit(3), F.length(d)), key, "phone2")
    )
    ok = plan & (north | m.startswith("+")) | ~plan & F.length(d).between(7, 15)
    return ok, F.transform(F.array(F.concat(head, rest)), lambda p: _refill(m, p))[0]


def _letters26(s: Column, key: str, tweak: str | Column = "") -> Column:
    """A keyed permutation of the strings of as many letters a to z (1 to 24)."""
    n = F.length(s)
    u = F.floor(n / 2).cast("int")
    v = n - u
    number = lambda x: F.aggregate(
        F.filter(F.split(x, ""), lambda c: c != ""),
        F.lit(0).cast("long"),
        lambda acc, c: acc * 26 + F.ascii(c) - 97,
    )
    letter = lambda x, w: F.when(
        w > 0,
        F.array_join(F.transform(F.sequence(F.lit(1), w), lambda i: F.char(F.pmod(F.floor(x / _power(26, w - i)), F.lit(26)) + 97)), ""),
    ).otherwise("")
    net = _network(
        number(F.substring(s, F.lit(1), u)),
        number(F.substring(s, u + 1, v)),
        _power(26, u),
        _power(26, v),
        key,
        F.concat(F.lit("mail"), n.cast("string"), _lit(tweak)),
    )
    return F.transform(F.array(net), lambda x: F.concat(letter(x["a"], u), letter(x["b"], v)))[0]


#: All but letters and numbers beyond a to z and 0 to 9.
_NOT_OTHER = r"[a-z0-9]|[^\p{L}\p{N}]"


def _other_letter(c: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation of the lower-case letters and numbers of c's run of 128 code points; what else stands there stays."""
    at = F.ascii(c)  # the code point
    base = at - at % 128
    show = lambda v: F.decode(F.unhex(F.lpad(F.hex(base + v), 8, "0")), "UTF-32")
    fits = lambda x: x.rlike(r"^[\p{L}\p{N}]$") & (F.lower(x) == x)
    once = lambda v: permute(v, 128, key, F.concat(F.lit("letter"), base.cast("string"), F.lit("|"), tweak))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(128)), once(at % 128), lambda v, _: F.when(fits(show(v)), v).otherwise(once(v)))
    return F.when(fits(c), show(walked)).otherwise(c)


#: An e-mail address is changed in these steps, each a column of its own, as one expression would nest too deeply.
def _email_parts(m: Column, key: str) -> Column:
    given = F.substring_index(m, "@", 1)
    local = F.lower(given)  # may be longer
    return F.struct(
        local.alias("local"),
        F.regexp_replace(local, "[^a-z]", "").alias("letters"),
        F.regexp_replace(local, _NOT_OTHER, "").alias("others"),
        _digits(local).alias("digits"),
        F.substring(m, F.length(given) + 1, F.length(m)).alias("rest"),
    )


def _email_letters(x: Column, key: str) -> Column:
    return x.withField("letters", in_pieces(x["letters"], 22, lambda s, done: _letters26(s, key, done)))


def _email_digits(x: Column, key: str) -> Column:
    return x.withField("digits", in_pieces(x["digits"], 30, lambda s, done: permute_digits(s, key, F.concat(F.lit("mail"), done))))


def _email_others(x: Column, key: str) -> Column:
    return x.withField("others", in_pieces(x["others"], 1, lambda s, done: _other_letter(s, key, F.concat(done, F.lit("|"), x["letters"]))))


def _email_joined(x: Column, key: str) -> Column:
    return F.struct(
        F.concat(_refill(x["local"], x["digits"], x["letters"], x["others"]), x["rest"]).alias("new"),
        F.lit("email").alias("kind"),
    )


def _each(values: Column, step, key: str) -> Column:
    return F.transform(values, lambda x: step(x, key))


EMAIL_STEPS = (_email_parts, _email_letters, _email_digits, _email_others, _email_joined)


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _replaced(text: Column, pattern: str, done: Column) -> Column:
    """struct(text, kinds): text with its matches replaced by done, an array of struct(new, kind), where the kind is '' for what stays."""
    parts = F.split(text, pattern, -1)
    joined = F.array_join(F.zip_with(parts, done, lambda p, x: F.concat(p, F.coalesce(x["new"], F.lit("")))), "")
    return F.struct(joined.alias("text"), F.filter(F.transform(done, lambda x: x["kind"]), lambda k: k != "").alias("kinds"))


def _number(m: Column, key: str) -> Column:
    kinds = {
        "iban": (IBAN, _iban),
        "date": (DATE, _date),
        "ip": (IP, _ip),
        "ssn": (SSN, _ssn),
        "card": (CARD, _card),
        "phone": (PHONE, _phone),
    }
    out = None
    for kind, (pattern, f) in kinds.items():
        ok, new = f(m, key)
        is_kind = m.rlike(_full(pattern))
        made = F.struct(F.when(ok, new).otherwise(m).alias("new"), F.when(ok, F.lit(kind)).otherwise("").alias("kind"))
        out = F.when(is_kind, made) if out is None else out.when(is_kind, made)
    return out.otherwise(F.struct(m.alias("new"), F.lit("").alias("kind")))


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", found_col: str = "pii") -> DataFrame:
    """docs with the text replaced, and a column found_col: array of the kinds replaced, in order of e-mails, then numbers."""
    none = F.array().cast("array<string>")
    text, p = F.col(f"`{text_col}`").cast("string"), free_prefix(docs)
    mail, first, number = (F.col(p + x) for x in ("mail", "first", "number"))
    rows = docs.select("*", F.when(text.contains("@"), _found(text, EMAIL)).alias(p + "0"))
    for i, step in enumerate(EMAIL_STEPS):
        rows = rows.select("*", _each(F.col(f"{p}{i}"), step, key).alias(f"{p}{i + 1}")).drop(f"{p}{i}")
    done = F.col(f"{p}{len(EMAIL_STEPS)}")
    rows = rows.select("*", F.when(F.size(done) > 0, _replaced(text, EMAIL, done)).alias(p + "mail")).drop(done)
    rows = rows.select("*", F.coalesce(mail["text"], text).alias(p + "first"))
    rows = rows.select("*", F.when(first.rlike(HINT), F.transform(_found(first, NUMBERS), lambda m: _number(m, key))).alias(p + "found"))
    rows = rows.select("*", F.when(F.size(p + "found") > 0, _replaced(first, NUMBERS, F.col(p + "found"))).alias(p + "number"))
    kinds = F.concat(F.coalesce(mail["kinds"], none), F.coalesce(number["kinds"], none))
    keep = [F.col(f"`{c}`") if c != text_col else F.coalesce(number["text"], first).alias(text_col) for c in docs.columns if c != found_col]
    return rows.select(*keep, kinds.alias(found_col))
