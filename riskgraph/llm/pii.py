"""Format-preserving pseudonyms for personal data, by a keyed Feistel network.

Numbers and dates that pass their own validation (Luhn digit, mod-97 check, octet
and calendar ranges, numbering plans) are permuted among the valid values of their
format: equal values have equal pseudonyms in every document, different values of a
format keep different ones. Spellings of one value are brought into one form before:
phone numbers with and without separators, country code or trunk zero, IBANs in
groups of four, IPv6 addresses with and without their zeros. E-mail addresses get
their local part's letters and digits permuted, the domain stays. Nothing is stored:
the key alone links values across documents and runs. It reaches the executors as
the value of a subquery, so plans and event logs don't show it.

All of it is column expressions on the JVM. A text is split at its matches, each
match is replaced, and the parts are joined; texts without a digit, an at sign or a
pair of colons are not searched at all.

Defined cases: a null text stays null with counts of 0; an empty text stays
empty; candidates that fail validation stay as they are, and so do the addresses
``::`` and ``::1``; of candidates that begin at one place the first kind in the order
of ``PATTERNS`` counts; null ids pass through; repeated rows are treated
independently; further columns are ignored. Slash and dot dates are read as
day-month-year, or month-day-year where only that is valid; dates stay before 1900,
in 1900 to 2099, or after. Ten digits in a row are a phone number only after a word
that says so. National numbers count as ``+1``, those with a trunk zero as ``+33``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: First day and radices (their product is the number of days) of the ranges that dates stay in.
DAY_RANGES = (("0001-01-01", 745, 931), ("1900-01-01", 17, 4297), ("2100-01-01", 195, 14797))
#: Areas of a social security number: 001 to 899 without 666; groups 01 to 99; serials 0001 to 9999.
SSN_AREAS, SSN_GROUPS, SSN_SERIALS = 898, 99, 9999
#: Letters and digits of a local part that are permuted at a time.
MAIL_LETTERS, MAIL_DIGITS = 24, 30
#: Country calling codes by their length (fixed values): those of one and two digits; all others have three.
CALLING_CODE = "^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
_H = "[0-9A-Fa-f]{1,4}"
#: Candidates, tried in this order at each place.
PATTERNS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ipv6": rf"(?<![\w:.])(?:(?:{_H}:){{7}}{_H}|(?:{_H}(?::{_H}){{0,6}})?::(?:{_H}(?::{_H}){{0,6}})?)(?![\w:])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "iso_date": r"(?<![\d./-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![\d/-])",
    "date": r"(?<![\d./-])[0-9]{1,2}([/.-])[0-9]{1,2}\1[0-9]{4}(?![\d/-])",
    "ssn": r"(?<![\d-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\d-])",
    "phone": r"(?<![\w(+])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?!\d)"
    r"|(?<![\w(+])\+33[ .-]?(?:\(0\)[ .-]?)?[1-9](?:[ .-]?[0-9]{2}){4}(?!\d)"
    r"|(?<![\w(+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[.-])[0-9]{3}[ .-]?[0-9]{4}(?!\d)"
    r"|(?<![\w(+])\+[0-9]{1,3}(?:[ .-]?[0-9]{1,4}){2,5}(?!\d)"
    r"|(?<![\w(+.,/-])0[1-9](?:[ .-]?[0-9]{2}){4}(?![\d/-])"
    r"|(?<=(?i:tel|phone|call|fax|mobile|cell)[ .:#]{1,3})[0-9]{10}(?!\d)",
    "ip": r"(?<![\d.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?\d)",
    "card": r"(?<![\d.+-])[0-9](?:[ -]?[0-9]){12,18}(?!\d)",
}
KINDS = ("email", "iban", "date", "ssn", "phone", "ip", "card")
#: Kinds of ``PATTERNS`` that one count covers.
COUNTED = {"date": ("iso_date", "date"), "ip": ("ip", "ipv6")}
#: Name of the column that holds the key.
KEY = "_key"


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(var: str, value: str, body: str) -> str:
    """``body`` with ``var`` bound to ``value``, evaluated once."""
    return f"element_at(transform(array({value}), {var} -> {body}), 1)"


def _feistel(left: str, right: str, a: str, b: str, tweak: str) -> str:
    """SQL for the struct (l, r) after all rounds on [0, a) x [0, b)."""

    def mix(x: str, modulus: str) -> str:
        return (
            f"pmod(cast(conv(substr(sha2(concat_ws('|', {KEY}, {tweak}, cast(i as string), cast({x} as string)), 256), 1, 15), "
            f"16, 10) as bigint), {modulus})"
        )

    return (
        f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), "
        f"(s, i) -> if(i % 2 = 0, "
        f"named_struct('l', (s.l + {mix('s.r', a)}) % {a}, 'r', s.r), "
        f"named_struct('l', s.l, 'r', (s.r + {mix('s.l', b)}) % {b})))"
    )


def _power(base: int, n: str) -> str:
    return f"cast(round(pow({base}, {n})) as bigint)"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _permute_digits(d: str, tweak: str) -> str:
    """A digit string of up to 30 digits, permuted among those of its length."""
    half = f"(length({d}) div 2)"
    net = _feistel(
        f"if({half} = 0, 0, cast(substr({d}, 1, {half}) as bigint))", f"cast(substr({d}, {half} + 1) as bigint)",
        _power(10, half), _power(10, f"(length({d}) - {half})"), f"concat({tweak}, length({d}))",
    )
    out = f"concat(if({half} = 0, '', lpad(cast(f.l as string), {half}, '0')), lpad(cast(f.r as string), length({d}) - {half}, '0'))"
    return f"if(length({d}) = 0, '', {_let('f', net, out)})"


def _refill(m: str, new: str, kind: str = "[0-9]") -> str:
    """``m`` with its characters of a class replaced, in order, by those of ``new``."""
    nth = f"length(regexp_replace(substr({m}, 1, p), '{kind.replace('[', '[^')}', ''))"
    return (
        f"array_join(transform(sequence(1, length({m})), p -> if(substr({m}, p, 1) rlike '{kind}', "
        f"substr({new}, {nth}, 1), substr({m}, p, 1))), '')"
    )


def _luhn_sum(d: str, doubled: int) -> str:
    """Luhn sum where positions from the right of parity ``doubled`` count double."""
    return (
        f"aggregate(sequence(1, length({d})), 0, (t, p) -> t + if((length({d}) - p) % 2 = {doubled}, "
        f"element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), cast(substr({d}, p, 1) as int) + 1), cast(substr({d}, p, 1) as int)))"
    )


def _card() -> str:
    body = f"concat(substr(d, 1, 1), {_permute_digits('substr(d, 2, length(d) - 2)', _quote('card'))})"
    check = f"concat(b, cast(pmod(10 - {_luhn_sum('b', 0)} % 10, 10) as string))"
    new = _let("b", body, check)
    return _let("d", _digits("m"), f"if({_luhn_sum('d', 1)} % 10 = 0, {_let('n', new, _refill('m', 'n'))}, m)")


def _ip() -> str:
    octets = "transform(split(m, '[.]'), o -> cast(o as int))"
    net = _feistel("q[0] * 256 + q[1]", "q[2] * 256 + q[3]", "65536", "65536", _quote("ip"))
    out = "concat_ws('.', f.l div 256, f.l % 256, f.r div 256, f.r % 256)"
    return _let("q", octets, f"if(exists(q, o -> o > 255), m, {_let('f', net, out)})")


def _ipv6() -> str:
    """The upper and the lower half are permuted one after the other; all groups are written out."""
    groups = "transform(filter(split({}, ':'), h -> h <> ''), h -> cast(conv(h, 16, 10) as bigint))"
    head, tail = groups.format("substring_index(m, '::', 1)"), groups.format("if(m like '%::%', substring_index(m, '::', -1), '')")
    filled = f"concat(a, array_repeat(0L, if(m like '%::%', greatest(8 - size(a) - size(b), 0), 0)), b)"
    q = _let("a", head, _let("b", tail, filled))
    numbers = "named_struct('u', q[0] * 65536 + q[1], 'v', q[2] * 65536 + q[3], 'x', q[4] * 65536 + q[5], 'y', q[6] * 65536 + q[7])"
    upper = _feistel("z.u", "z.v", "4294967296", "4294967296", _quote("ipv6"))
    lower = _feistel("z.x", "z.y", "4294967296", "4294967296", "concat_ws(':', 'ipv6', z.u, z.v)")
    out = "concat_ws(':', transform(array(f.l, f.r, g.l, g.r), w -> concat(lower(hex(w div 65536)), ':', lower(hex(w % 65536)))))"
    new = _let("z", numbers, _let("f", upper, _let("g", lower, out)))
    sound = "size(q) = 8 and (m not like '%::%' or size(filter(split(m, ':'), h -> h <> '')) < 8) and m not in ('::', '::1') and m rlike '[0-9]'"
    return _let("q", q, f"if({sound}, {new}, m)")


def _ssn() -> str:
    """Permuted among the valid areas, groups and serials."""
    area, group, serial = (f"cast(substr(m, {at}, {n}) as bigint)" for at, n in ((1, 3), (5, 2), (8, 4)))
    left = f"({area} - 1 - if({area} > 666, 1, 0)) * {SSN_GROUPS} + {group} - 1"
    net = _feistel(left, f"{serial} - 1", str(SSN_AREAS * SSN_GROUPS), str(SSN_SERIALS), _quote("ssn"))
    number = f"(f.l div {SSN_GROUPS} + 1)"
    out = (
        f"concat_ws('-', lpad(cast({number} + if({number} >= 666, 1, 0) as string), 3, '0'), "
        f"lpad(cast(f.l % {SSN_GROUPS} + 1 as string), 2, '0'), lpad(cast(f.r + 1 as string), 4, '0'))"
    )
    return f"if({area} between 1 and 899 and {area} <> 666 and {group} > 0 and {serial} > 0, {_let('f', net, out)}, m)"


def _phone() -> str:
    """Country codes and trunk zeros stay; the rest is permuted within its numbering plan, told by its leading digits.

    ``v.kept`` digits stay in front, ``v.cc`` is the country code and ``b`` the rest.
    Ten digits of the plan of ``+1`` are permuted within it, ten others keep the two
    digits that put them outside; of all other numbers the first digit stays.
    """
    cc = f"if(m like '+%', regexp_extract(d, '{CALLING_CODE}', 1), if(m rlike '^0[1-9]([ .-]?[0-9]{{2}}){{4}}$', '33', '1'))"
    kept = "if(m like '+%', length(cc) + if(cc = '33' and substr(d, 3, 1) = '0', 1, 0), if(cc = '33', 1, 0))"
    split = _let("cc", cc, f"named_struct('cc', cc, 'kept', {kept})")
    plan = _feistel(
        "((cast(substr(b, 1, 3) as bigint) - 200) * 800 + cast(substr(b, 4, 3) as bigint) - 200)",
        "cast(substr(b, 7, 4) as bigint)", "640000", "10000", _quote("phone"),
    )
    in_plan = _let("f", plan, "concat(cast(200 + f.l div 800 as string), cast(200 + f.l % 800 as string), lpad(cast(f.r as string), 4, '0'))")
    tail = _permute_digits("t", "concat('phone', v.cc, ':', length(b))")
    other = _let("t", "concat(substr(b, 2, 2), substr(b, 5))", _let("n", tail, "concat(substr(b, 1, 1), substr(n, 1, 2), substr(b, 4, 1), substr(n, 3))"))
    rest = _let("t", "substr(b, 2)", _let("n", tail, "concat(substr(b, 1, 1), n)"))
    new = f"if(v.cc = '1' and length(b) = 10, if(b rlike '^[2-9][0-9]{{2}}[2-9][0-9]{{6}}$', {in_plan}, {other}), {rest})"
    body = _let("b", "substr(d, v.kept + 1)", _let("y", f"concat(substr(d, 1, v.kept), {new})", _refill("m", "y")))
    sound = "length(d) between 8 and 15"
    return _let("d", _digits("m"), f"if({sound}, {_let('v', split, body)}, m)")


def _date(iso: bool) -> str:
    sep = "regexp_extract(m, '[^0-9]', 0)"
    if iso:
        body, form = "named_struct('day', try_cast(m as date), 'dm', true)", "date_format(n, 'yyyy-MM-dd')"
    else:
        parts = "transform(split(m, '[^0-9]'), x -> if(length(x) = 1, concat('0', x), x))"
        first, second = "try_cast(concat_ws('-', q[2], q[1], q[0]) as date)", "try_cast(concat_ws('-', q[2], q[0], q[1]) as date)"
        body = _let("q", parts, f"named_struct('day', coalesce({first}, {second}), 'dm', {first} is not null)")
        form = f"if(v.dm, concat_ws({sep}, date_format(n, 'dd'), date_format(n, 'MM'), date_format(n, 'yyyy')), "
        form += f"concat_ws({sep}, date_format(n, 'MM'), date_format(n, 'dd'), date_format(n, 'yyyy')))"
    cases = []
    for start, a, b in reversed(DAY_RANGES):
        count = f"datediff(v.day, date'{start}')"
        net = _feistel(f"{count} div {b}", f"{count} % {b}", str(a), str(b), _quote("date" + start))
        new = _let("f", net, f"date_add(date'{start}', cast(f.l * {b} + f.r as int))")
        cases.append(f"when v.day >= date'{start}' then {_let('n', new, form)}")
    return _let("v", body, f"case {' '.join(cases)} else m end")


def _iban() -> str:
    """Check digits made anew; a group that follows by chance is left out if the rest is valid without it."""

    def mod97(x: str) -> str:
        chars = f"transform(split({x}, ''), ch -> if(ch rlike '[0-9]', ch, cast(ascii(ch) - 55 as string)))"
        return f"aggregate({chars}, 0L, (t, ch) -> if(ch = '', t, (t * if(length(ch) = 2, 100, 10) + cast(ch as bigint)) % 97))"

    def valid(x: str) -> str:
        return f"(length({x}) between 15 and 34 and {mod97(f'concat(substr({x}, 5), substr({x}, 1, 4))')} = 1)"

    bban = _let("r", "substr(c, 5)", _let("d", _digits("r"), _let("n", _permute_digits("d", _quote("iban")), _refill("r", "n"))))
    new = f"concat(substr(c, 1, 2), lpad(cast(98 - {mod97('concat(y, substr(c, 1, 2), ' + _quote('00') + ')')} as string), 2, '0'), y)"
    grouped = _let("w", new, _refill("k", "w", "[A-Z0-9]"))
    whole = _let("c", "replace(k, ' ', '')", f"if({valid('c')}, concat({_let('y', bban, grouped)}, substr(m, length(k) + 1)), null)")
    less = "regexp_replace(m, ' [A-Z0-9]{1,4}$', '')"
    return f"coalesce({_let('k', 'm', whole)}, {_let('k', less, whole)}, m)"


def _email() -> str:
    """Letters and digits of the local part permuted, block by block; a block's network depends on those before it."""

    def number(x: str) -> str:
        return f"aggregate(split({x}, ''), 0L, (t, ch) -> if(ch = '', t, t * 26 + ascii(ch) - 97))"

    def word(x: str, n: str) -> str:
        return (
            f"if({n} = 0, '', array_join(transform(sequence(1, greatest({n}, 1)), p -> "
            f"chr(97 + pmod({x} div cast(round(pow(26, {n} - p)) as bigint), 26))), ''))"
        )

    def blocks(x: str, width: int, body: str) -> str:
        """``body`` of each block ``w``, with ``before`` for what precedes it."""
        each = _let("w", f"substr({x}, g * {width} + 1, {width})", _let("before", f"substr({x}, 1, g * {width})", body))
        return f"if(length({x}) = 0, '', array_join(transform(sequence(0, (length({x}) - 1) div {width}), g -> {each}), ''))"

    half = "(length(w) div 2)"
    net = _feistel(
        f"if({half} = 0, 0L, {number(f'substr(w, 1, {half})')})", number(f"substr(w, {half} + 1)"),
        _power(26, half), _power(26, f"(length(w) - {half})"), "concat('mail', length(w), before)",
    )
    letters = _let("f", net, "concat(" + word("f.l", half) + ", " + word("f.r", f"(length(w) - {half})") + ")")
    local = _let("s", "lower(regexp_replace(u, '[^A-Za-z]', ''))", _let("n", blocks("s", MAIL_LETTERS, letters), _refill("u", "n", "[A-Za-z]")))
    digits = blocks("d", MAIL_DIGITS, _permute_digits("w", "concat('mail', before)"))
    local = _let("u2", local, _let("d", _digits("u2"), _let("n", digits, _refill("u2", "n"))))
    cased = "array_join(transform(sequence(1, length(u)), p -> if(substr(u, p, 1) rlike '[A-Z]', upper(substr(y, p, 1)), substr(y, p, 1))), '')"
    return _let("u", "substring_index(m, '@', 1)", f"concat({_let('y', local, cased)}, substr(m, length(u) + 1))")


def _replace() -> str:
    """SQL for the pseudonym of a match ``m``; the first kind whose test fits it decides."""
    by = {
        "email": _email(), "ipv6": _ipv6(), "iban": _iban(), "iso_date": _date(True), "date": _date(False),
        "ssn": _ssn(), "phone": _phone(), "ip": _ip(), "card": _card(),
    }
    return "case " + " ".join(f"when {_kind_test(k)} then {by[k]}" for k in by) + " else m end"


def _kind_test(kind: str) -> str:
    tests = {
        "email": "m like '%@%'",
        "ipv6": "m like '%:%'",
        "iban": "m rlike '^[A-Z]'",
        "iso_date": "m rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2}$'",
        "date": "m rlike '^[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{4}$'",
        "ssn": "m rlike '^[0-9]{3}-[0-9]{2}-[0-9]{4}$'",
        "phone": "m rlike '^([+]|[(]|[0-9]{3}[.-][0-9]{3}[ .-]?[0-9]{4}$|0[1-9]([ .-]?[0-9]{2}){4}$|[0-9]{10}$)'",
        "ip": "m rlike '^[0-9]{1,3}([.][0-9]{1,3}){3}$'",
        "card": "true",
    }
    return tests[kind]


def pattern() -> str:
    return "|".join(f"(?:{p})" for p in PATTERNS.values())


def pseudonymize(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text, n_<kind>...``: texts with pseudonyms, and what was replaced per kind.

    One pass without a shuffle; no Python code runs on the executors.
    """
    spark = docs.sparkSession
    secret = spark.createDataFrame([(key,)], f"{KEY} string").scalar()
    text = F.col(text_col)
    p = F.lit(pattern())
    searched = text.contains("@") | text.contains("::") | text.rlike(f"[0-9]{{2}}|[0-9][./-][0-9]|(?:{_H}:){{7}}")
    found = F.when(searched, F.regexp_extract_all(text, p, F.lit(0))).otherwise(F.array().cast("array<string>"))
    base = docs.select(
        F.col(id_col).alias("doc_id"), text.alias("text"), F.coalesce(found, F.array().cast("array<string>")).alias("found"), secret.alias(KEY)
    )
    new = base.withColumn("new", F.expr(f"transform(found, m -> {_replace()})"))
    joined = F.expr(
        f"if(size(found) = 0, text, array_join(zip_with(split(text, {_quote(pattern())}, -1), new, (g, m) -> concat(g, coalesce(m, ''))), ''))"
    )

    def first_kind(kind: str) -> str:
        earlier = " or ".join(f"({_kind_test(k)})" for k in list(PATTERNS)[: list(PATTERNS).index(kind)]) or "false"
        return f"(({_kind_test(kind)}) and not ({earlier}))"

    def count(kind: str) -> Column:
        test = " or ".join(first_kind(k) for k in COUNTED.get(kind, (kind,)))
        return F.expr(f"cast(size(filter(zip_with(found, new, (m, y) -> m <> y and ({test})), z -> z)) as bigint)").alias(f"n_{kind}")

    return new.select("doc_id", joined.alias("text"), *(count(k) for k in KINDS))
