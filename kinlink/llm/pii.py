"""Pseudonyms that keep their format, by a keyed Feistel permutation; native expressions only.

Found and validated: payment card numbers (13 to 19 digits, Luhn), phone numbers with a country code
(any groups) or a three-digit area code, US social security numbers, IPv4 and IPv6 addresses, IBANs (check digits; letters stay letters), dates (ISO,
day/month/year with ``/`` or ``.``, and month/day/year where the day is above 12) and e-mail addresses.  Each value is mapped to an index of
its domain ``A x B`` and permuted by rounds ``a += F(b) mod A``, ``b += F(a) mod B`` with
F from SHA-256 of key, kind, round and half.  This is one-to-one and depends on nothing but
the value and the key, so equal values get equal pseudonyms in every document, on any
executor.  Separators stay where they were; card and IBAN check digits are made valid anew.
E-mail names are replaced by a keyed hash, their domains by ``example.com``-like hashes.

Text that fails its validation (a 16-digit number with a wrong check digit, 31 February, an
octet of 300) is left as it is.  Defined cases: null text stays null with 0 found; empty text
stays empty; repeated rows are treated alike; texts of any length are rewritten whole; an empty table gives no rows;
if the table has a column ``n_pii``, that stays and the count is ``n_pii_found``; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

# What is searched for. The order decides where two could start at one place.
EMAIL = r"(?<![\p{L}0-9._%+\-])[\p{L}0-9._%+\-]++@[\p{L}0-9\-]+(?:\.[\p{L}0-9\-]+)*\.[\p{L}]{2,}"
IPV4 = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"
IPV6 = r"(?<![\p{L}0-9:.])(?=[0-9A-Fa-f:]*[0-9])(?=(?:[0-9A-Fa-f]*:){2})(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![\p{L}0-9:]|\.[0-9])"
DATE_ISO = r"(?<![0-9\-])(?:18|19|20|21)[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9\-])"
DATE_DMY = r"(?<![0-9/.])[0-9]{2}(?:/[0-9]{2}/|\.[0-9]{2}\.)(?:18|19|20|21)[0-9]{2}(?![0-9]|[/.][0-9])"
SSN = r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
PHONE = r"(?<![0-9+])(?:\+[0-9]{1,3}[ .\-]?)?\([0-9]{3}\)[ .\-]?[0-9]{3}[ .\-][0-9]{4}(?![0-9])|(?<![0-9+])\+[0-9]{1,3}[ .\-][0-9]{3}[ .\-][0-9]{3}[ .\-][0-9]{4}(?![0-9])|(?<![0-9.\-])[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}(?![0-9.\-])"
#: With a country code in any groups: of known length first, so that what follows isn't taken in; no decimal number.
_NEXT = r"(?:[ .\-/]?\(?[0-9]\)?)"
PHONE += rf"|(?<![0-9+])(?!\+[0-9]{{1,3}}\.[0-9]++(?!\.[0-9]))\+(?:(?:33|34){_NEXT}{{9}}|(?:1|44){_NEXT}{{10}}|[1-9][0-9]{{0,2}}{_NEXT}{{6,12}})(?![0-9])"
#: Country codes of one and of two digits; all others have three.
CODES = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
#: Countries by the length of their IBANs; accounts may hold letters.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_ACCOUNTS = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
#: Of other countries, or other lengths: digits in groups.
IBAN = rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_ACCOUNTS}|[A-Z]{{2}}[0-9]{{2}}(?: ?[0-9]{{4}}){{3,7}}(?: ?[0-9]{{1,3}})?)(?![A-Za-z0-9])"
CARD = r"(?<![0-9A-Za-z])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9A-Za-z])"
PATTERN = "|".join((EMAIL, IBAN, IPV4, IPV6, DATE_ISO, DATE_DMY, SSN, PHONE, CARD))

#: 400 years of the Gregorian calendar from 1800-01-01: 146,097 days = 189 * 773.
DATE_A, DATE_B = 189, 773

#: Month and day of the dates that can only be month first, without 29 February.
MONTH_FIRST = [f"{m:02}{d:02}" for m, n in enumerate((31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31), 1) for d in range(13, n + 1)]


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _feistel(key: str, kind: str, a: str, b: str, size_a: str, size_b: str) -> str:
    """SQL for struct(a, b) after ROUNDS rounds."""
    def f(half: str, size: str) -> str:
        return f"pmod(cast(conv(substring(sha2(concat_ws('|', {_quote(key)}, '{kind}', {size_a}, {size_b}, i, {half}), 256), 1, 14), 16, 10) as bigint), {size})"

    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint)), (s, i) -> "
        f"if(i % 2 = 1, named_struct('a', pmod(s.a + {f('s.b', size_a)}, {size_a}), 'b', s.b), named_struct('a', s.a, 'b', pmod(s.b + {f('s.a', size_b)}, {size_b}))))"
    )


def _let(name: str, value: str, body: str) -> str:
    """SQL for body with name bound to value, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _refill(m: str, digits: str) -> str:
    """m with its digits replaced, in turn, by those of the string digits."""
    return (
        f"aggregate(split({m}, ''), named_struct('o', cast('' as string), 'k', 1), (t, c) -> if(c >= '0' and c <= '9', "
        f"named_struct('o', concat(t.o, substring({digits}, t.k, 1)), 'k', t.k + 1), named_struct('o', concat(t.o, c), 'k', t.k)), t -> t.o)"
    )


def _luhn_sum(d: str, shift: int) -> str:
    """Luhn sum of the digit string; shift 1 if a check digit is still to be appended."""
    return (
        f"aggregate(sequence(1, length({d})), 0, (t, j) -> t + "
        f"if((j + {shift}) % 2 = 0, element_at(array(0,2,4,6,8,1,3,5,7,9), 1 + cast(substring({d}, length({d}) - j + 1, 1) as int)), cast(substring({d}, length({d}) - j + 1, 1) as int)))"
    )


def _halves(key: str, kind: str, d: str) -> str:
    """A digit string of any length up to 30, permuted among those of its length."""
    u = f"(length({d}) div 2)"
    size_a, size_b = f"cast(pow(10, {u}) as bigint)", f"cast(pow(10, length({d}) - {u}) as bigint)"
    r = _feistel(key, kind, f"substring({d}, 1, {u})", f"substring({d}, {u} + 1)", size_a, size_b)
    return _let("h", r, f"concat(lpad(h.a, {u}, '0'), lpad(h.b, length({d}) - {u}, '0'))")


def _mod97(s: str) -> str:
    """Remainder by 97 of a string of digits and A-Z (A is 10, Z is 35)."""
    return f"aggregate(split({s}, ''), 0, (t, c) -> if(c >= '0' and c <= '9', (t * 10 + cast(c as int)) % 97, (t * 100 + ascii(c) - 55) % 97))"


def _card(key: str) -> str:
    body = "substring(d, 1, length(d) - 1)"
    new = _let("q", _halves(key, "card", "p"), _let("e", f"concat(q, cast((10 - {_luhn_sum('q', 1)} % 10) % 10 as string))", _refill("m", "e")))
    return _let("d", _digits("m"), f"if(length(d) between 13 and 19 and {_luhn_sum('d', 0)} % 10 = 0 and d rlike '[1-9]', {_let('p', body, new)}, m)")


def _phone(key: str) -> str:
    """The digits after the country code are permuted."""
    code = f"if(substring(m, 1, 1) <> '+', 0, if(d rlike {_quote(CODES)}, if(d rlike '^[17]', 1, 2), 3))"
    new = _let("n", code, _let("p", "substring(d, n + 1)", _let("q", _halves(key, "phone", "p"), _let("e", "concat(substring(d, 1, n), q)", _refill("m", "e")))))
    return _let("d", _digits("m"), f"if(length(d) between 8 and 15, {new}, m)")


def _ssn(key: str) -> str:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    area = "cast(substring(m, 1, 3) as int)"
    index = f"({area} - 1 - if({area} > 666, 1, 0)) * 99 + cast(substring(m, 5, 2) as int) - 1"
    new = _let(
        "h",
        _feistel(key, "ssn", index, "cast(substring(m, 8, 4) as int) - 1", "88902", "9999"),
        "concat(lpad(cast((h.a div 99) + 1 + if((h.a div 99) >= 665, 1, 0) as string), 3, '0'), '-', lpad(cast(h.a % 99 + 1 as string), 2, '0'), '-', lpad(cast(h.b + 1 as string), 4, '0'))",
    )
    return f"if({area} between 1 and 899 and {area} <> 666 and substring(m, 5, 2) <> '00' and substring(m, 8, 4) <> '0000', {new}, m)"


def _ip(key: str) -> str:
    new = _let(
        "h",
        _feistel(key, "ip", "x[0] * 256 + x[1]", "x[2] * 256 + x[3]", "65536", "65536"),
        "concat_ws('.', h.a div 256, h.a % 256, h.b div 256, h.b % 256)",
    )
    return _let("x", "transform(split(m, '[.]'), y -> cast(y as bigint))", f"if(array_max(x) <= 255, {new}, m)")


def _ipv6(key: str) -> str:
    """The 128 bits as eight groups, however they were written: each half of the address is permuted."""
    groups = lambda x: f"filter(split({x}, ':'), c -> c <> '')"
    zeros = "array_repeat('0', greatest(0, 8 - size(g) - size(t)))"
    full = f"if(instr(m, '::') > 0, concat(g, {zeros}, t), g)"
    number = lambda i: f"cast(conv(concat(lpad(x[{i}], 4, '0'), lpad(x[{i + 1}], 4, '0')), 16, 10) as bigint)"
    text = lambda v: f"concat_ws(':', lpad(lower(hex({v} div 65536)), 4, '0'), lpad(lower(hex({v} % 65536)), 4, '0'))"
    halves = [_let("h", _feistel(key, f"ipv6-{i}", number(i), number(i + 2), "4294967296", "4294967296"), f"concat_ws(':', {text('h.a')}, {text('h.b')})") for i in (0, 4)]
    new = _let("x", full, f"if(size(x) = 8, concat_ws(':', {halves[0]}, {halves[1]}), m)")
    return _let("g", groups("substring_index(m, '::', 1)"), _let("t", groups("if(instr(m, '::') > 0, substring_index(m, '::', -1), '')"), new))


def _month_first(key: str) -> str:
    """400 years from 1800 on, by the month and day of MONTH_FIRST."""
    days = f"array({', '.join(_quote(x) for x in MONTH_FIRST)})"
    n = len(MONTH_FIRST)
    at = f"array_position({days}, concat(substring(m, 1, 2), substring(m, 4, 2)))"
    out = f"element_at({days}, cast(h.b + 1 as int))"
    new = _let("h", _feistel(key, "date-us", "cast(substring(m, 7, 4) as bigint) - 1800", "w - 1", "400", str(n)), _let("v", out, "concat(substring(v, 1, 2), substring(m, 3, 1), substring(v, 3, 2), substring(m, 6, 1), cast(h.a + 1800 as string))"))
    return _let("w", at, f"if(w = 0, m, {new})")


def _date(key: str, day: str, out: str) -> str:
    """day: SQL of the date, null if invalid; out: SQL of the text from date v."""
    new = _let(
        "h",
        _feistel(key, "date", f"w div {DATE_B}", f"w % {DATE_B}", str(DATE_A), str(DATE_B)),
        _let("v", f"date_add(date'1800-01-01', cast(h.a * {DATE_B} + h.b as int))", out),
    )
    return _let("w", f"datediff({day}, date'1800-01-01')", f"if(w is null, m, {new})")


def _letters(key: str, kind: str, x: str) -> str:
    """A string of up to 24 letters A-Z, permuted among those of its length."""
    u, v = f"(length({x}) div 2)", f"(length({x}) - length({x}) div 2)"
    number = lambda y: f"aggregate(filter(split({y}, ''), c -> c <> ''), cast(0 as bigint), (t, c) -> t * 26 + ascii(c) - 65)"
    text = lambda n, k: f"if({k} = 0, '', aggregate(sequence(1, greatest(1, {k})), named_struct('o', '', 'n', {n}), (t, i) -> named_struct('o', concat(char(65 + t.n % 26), t.o), 'n', t.n div 26), t -> t.o))"
    size = lambda k: f"aggregate(sequence(0, {k}), cast(1 as bigint), (t, i) -> if(i = 0, t, t * 26))"
    r = _feistel(key, kind, number(f"substring({x}, 1, {u})"), number(f"substring({x}, {u} + 1)"), size(u), size(v))
    return f"if({x} = '', '', {_let('h', r, f'concat({text('h.a', u)}, {text('h.b', v)})')})"


def _iban(key: str) -> str:
    """The digits after the check digits are permuted, and so are the letters; the check digits are 98 - remainder."""
    valid = f"{_mod97('concat(substring(z, 5), substring(z, 1, 4))')} = 1"
    check = f"lpad(cast(98 - {_mod97('''concat(q, substring(z, 1, 2), '00')''')} as string), 2, '0')"
    mixed = (
        "aggregate(split(p, ''), named_struct('o', cast('' as string), 'k', 1, 'l', 1), (t, c) -> if(c >= '0' and c <= '9', "
        "named_struct('o', concat(t.o, substring(dq, t.k, 1)), 'k', t.k + 1, 'l', t.l), named_struct('o', concat(t.o, substring(lq, t.l, 1)), 'k', t.k, 'l', t.l + 1)), t -> t.o)"
    )
    filled = (
        "aggregate(split(m, ''), named_struct('o', cast('' as string), 'k', 1), (t, c) -> if(c = ' ', named_struct('o', concat(t.o, c), 'k', t.k), "
        "named_struct('o', concat(t.o, substring(e, t.k, 1)), 'k', t.k + 1)), t -> t.o)"
    )
    digits = _let("g", _digits("p"), f"if(length(g) < 2, g, {_halves(key, 'iban', 'g')})")
    letters = _let("y", "regexp_replace(p, '[^A-Z]', '')", _letters(key, "iban-letters", "y"))
    new = _let("p", "substring(z, 5)", _let("dq", digits, _let("lq", letters, _let("q", mixed, _let("e", f"concat(substring(z, 1, 2), {check}, q)", filled)))))
    return _let("z", "replace(m, ' ', '')", f"if({valid}, {new}, m)")


def _email(key: str) -> str:
    h = f"sha2(concat_ws('|', {_quote(key)}, 'email', lower(m)), 256)"
    return _let("y", h, "concat('user', substring(y, 1, 12), '@', substring(y, 13, 8), '.example.com')")


def _value(key: str) -> str:
    at = lambda p: "m rlike " + _quote("^(?:" + p + ")$")
    return (
        f"case when instr(m, '@') > 0 then {_email(key)} when {at(IBAN)} then {_iban(key)} when {at(IPV4)} then {_ip(key)} "
        f"when {at(DATE_ISO)} then {_date(key, _try_date(1, 6, 9), 'cast(v as string)')} "
        f"when {at(IPV6)} then {_ipv6(key)} when {at(DATE_DMY)} and {_try_date(7, 4, 1)} is null then {_month_first(key)} "
        f"when {at(DATE_DMY)} then {_date(key, _try_date(7, 4, 1), '''concat(substring(cast(v as string), 9, 2), substring(m, 3, 1), substring(cast(v as string), 6, 2), substring(m, 6, 1), substring(cast(v as string), 1, 4))''')} "
        f"when {at(SSN)} then {_ssn(key)} when {at(PHONE)} then {_phone(key)} else {_card(key)} end"
    )


def _try_date(y: int, mo: int, d: int) -> str:
    return f"try_cast(concat(substring(m, {y}, 4), '-', substring(m, {mo}, 2), '-', substring(m, {d}, 2)) as date)"


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its text rewritten, plus ``n_pii`` (values replaced; see above for a table that has one).

    The text is cut once at all matches; the pieces between are copied, the matches mapped.
    Texts without a digit or ``@`` skip both regular expressions.
    """
    t = f"`{text_col}`"
    found = docs.withColumn("__kl_m", F.expr(f"if({t} rlike '[0-9@]', regexp_extract_all({t}, {_quote(PATTERN)}, 0), cast(array() as array<string>))"))
    mapped = found.withColumn("__kl_v", F.expr(f"transform(__kl_m, m -> {_value(key)})"))
    mapped = mapped.withColumn("n_pii_found" if "n_pii" in docs.columns else "n_pii", F.expr("if(__kl_m is null, 0, aggregate(zip_with(__kl_m, __kl_v, (a, b) -> if(a = b, 0, 1)), 0, (x, y) -> x + y))"))
    joined = f"if(size(__kl_m) = 0 or __kl_m is null, {t}, concat_ws('', flatten(zip_with(split({t}, {_quote(PATTERN)}, -1), __kl_v, (p, v) -> array(p, coalesce(v, ''))))))"
    return mapped.withColumn(text_col, F.expr(joined)).drop("__kl_m", "__kl_v")
