import datetime
import hashlib
import re

import pytest

from kinlink.llm import pii

KEY = "k'1"


def run(spark, texts):
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, n int")
    rows = sorted(pii.pseudonymise(df, KEY).collect(), key=lambda r: r["doc_id"])
    return [r["text"] for r in rows], [r["n_pii"] for r in rows]


def feistel(kind, a, b, size_a, size_b):
    def f(i, half, size):
        h = hashlib.sha256("|".join(map(str, (KEY, kind, size_a, size_b, i, half))).encode()).hexdigest()[:14]
        return int(h, 16) % size

    for i in range(1, pii.ROUNDS + 1):
        if i % 2:
            a = (a + f(i, b, size_a)) % size_a
        else:
            b = (b + f(i, a, size_b)) % size_b
    return a, b


def halves(kind, d):
    u = len(d) // 2
    a, b = feistel(kind, int(d[:u]), int(d[u:]), 10**u, 10 ** (len(d) - u))
    return f"{a:0{u}d}{b:0{len(d) - u}d}"


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_cards(spark):
    (a, b, c, d), n = run(spark, ["pay 4111 1111-11111111 now", "x4111111111111111", "no 4111111111111112.", "4111111111111111"])
    want = halves("card", "411111111111111")
    new = re.sub(r"\D", "", a)
    assert new[:-1] == want and luhn(new) and re.fullmatch(r"pay \d{4} \d{4}-\d{8} now", a) and new != "4111111111111111"
    assert b == "x4111111111111111" and c == "no 4111111111111112." and re.sub(r"\D", "", d) == new
    assert n == [1, 0, 0, 1]


def test_phones_ssn_ip(spark):
    out, n = run(spark, ["+1 (743) 555-3824", "ssn 123-45-6789.", "ip 172.242.194.228, 300.1.1.1 1.2.3.4.5", "000-12-3456 666-12-3456"])
    assert re.sub(r"\D", "", out[0]) == "1" + halves("phone", "7435553824") and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", out[0])
    area, group, serial = map(int, re.search(r"(\d{3})-(\d\d)-(\d{4})", out[1]).groups())
    a, b = feistel("ssn", (123 - 1) * 99 + 44, 6788, 88902, 9999)
    assert (area - 1 - (area > 666)) * 99 + group - 1 == a and serial - 1 == b and area != 666
    x, y = feistel("ip", 172 * 256 + 242, 194 * 256 + 228, 65536, 65536)
    assert out[2] == f"ip {x // 256}.{x % 256}.{y // 256}.{y % 256}, 300.1.1.1 1.2.3.4.5"
    assert out[3] == "000-12-3456 666-12-3456" and n == [1, 1, 1, 0]


def test_dates(spark):
    out, n = run(spark, ["born 1984-02-29 or 29.02.1984 or 29/02/1984", "1985-02-29 2001-13-01", "31/04/2001"])
    day = (datetime.date(1984, 2, 29) - datetime.date(1800, 1, 1)).days
    a, b = feistel("date", day // 773, day % 773, 189, 773)
    new = datetime.date(1800, 1, 1) + datetime.timedelta(a * 773 + b)
    assert out[0] == f"born {new} or {new:%d.%m.%Y} or {new:%d/%m/%Y}" and n[0] == 3
    assert out[1:] == ["1985-02-29 2001-13-01", "31/04/2001"] and n[1:] == [0, 0]


def test_iban_and_mail(spark):
    out, n = run(spark, ["to DE89 3704 0044 0532 0130 00 please", "DE88370400440532013000", "mail bosbt.42@mail8.example.com, Bosbt.42@mail8.example.com", "(ñandú.7@über.example.de)***"])
    new = re.search(r"DE[\d ]+\d", out[0])[0]
    z = new.replace(" ", "")
    assert int(z[4:] + "1314" + z[2:4]) % 97 == 1 and z[4:] == halves("iban", "370400440532013000") and [len(x) for x in new.split()] == [4, 4, 4, 4, 4, 2]
    assert out[1] == "DE88370400440532013000"
    first, second = re.findall(r"\S+@[\w.]+", out[2])
    assert first == second and "bosbt" not in out[2].lower() and n == [1, 0, 2, 1]
    assert re.fullmatch(r"\(user[0-9a-f]{12}@[0-9a-f]{8}\.example\.com\)\*\*\*", out[3])


def test_one_to_one():
    assert len({feistel("t", i // 10, i % 10, 10, 10) for i in range(100)}) == 100
    assert len({feistel("t", i // 9, i % 9, 7, 9) for i in range(63)}) == 63


@pytest.mark.parametrize("text", [None, "", "no numbers at all", "version 3.0, 12 of 345", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "$1 \\1 ' \" 2024"])
def test_clean_text_is_left_alone(spark, text):
    assert run(spark, [text]) == ([text], [0])


def test_many_values_long_text_repeats_and_empty(spark):
    text = ("word " * 2000 + "8.8.8.8 ") * 50
    (a, b), n = run(spark, [text, text])
    assert a == b and n == [50, 50] and len(set(re.findall(r"\d+\.\d+\.\d+\.\d+", a))) == 1
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.pseudonymise(df, KEY).count() == 0
    plan = pii.pseudonymise(df, KEY)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("iban", ["GB82 WEST 1234 5698 7654 32", "NL91ABNA0417164300", "IE29 AIBK 9311 5212 3456 78", "FR14 2004 1010 0505 0001 3M02 606", "IT60 X054 2811 1010 0000 0123 456", "NO93 8601 1117 947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"])
def test_ibans_with_letters(spark, iban):
    (a, b, c), n = run(spark, [f"pay {iban} AND NOW", f"({iban})", iban[:-1] + ("1" if iban[-1] != "1" else "2")])
    new = a[4:-8]
    assert a == f"pay {new} AND NOW" and b == f"({new})" and new != iban and n == [1, 1, 0]
    shape = lambda x: re.sub("[0-9]", "0", re.sub("[A-Z]", "A", x))
    z = new.replace(" ", "")
    assert shape(new) == shape(iban) and new[:2] == iban[:2]
    assert int("".join(str(int(x, 36)) for x in z[4:] + z[:4])) % 97 == 1


@pytest.mark.parametrize("phone", ["+34 612 345 678", "+33 1 23 45 67 89", "+49 30 123456", "+34612345678", "+44 20 7946 0958", "+351 912 345 678", "+33 (0)1 23 45 67 89", "+49-151-23456789"])
def test_international_phones(spark, phone):
    (a, b), n = run(spark, [f"call {phone}, then", f"call {phone}"])
    new = b[5:]
    assert a == f"call {new}, then" and new != phone and n == [1, 1]
    assert re.sub("[0-9]", "0", new) == re.sub("[0-9]", "0", phone) and new[:2] == phone[:2]


def test_numbers_beside_international_phones(spark):
    (a, b, c), n = run(spark, ["+34 612 345 678 2024", "+34 612 345 678 4111 1111 1111 1111", "+1.23456789 and +12 34 or +5"])
    assert a.endswith(" 2024") and n[0] == 1 and "612 345 678" not in a
    assert n[1] == 2 and a[:15] == b[:15] and luhn(re.sub(r"\D", "", b[16:]))
    assert c == "+1.23456789 and +12 34 or +5" and n[2] == 0


def test_ipv6_addresses(spark):
    texts = ["at 2001:db8::8a2e:370:7334 now", "2001:0DB8:0:0:0:8A2E:0370:7334", "fe80::1, ::1", "std::dec and a::b and 12:30:45", "1:2:3:4:5:6:7:8:9"]
    got = list(run(spark, texts)[0])
    found = [re.findall(r"(?:[0-9a-f]{4}:){7}[0-9a-f]{4}", t) for t in got]
    assert len(found[0]) == 1 and found[0] == found[1] and found[0][0] != "2001:0db8:0000:0000:0000:8a2e:0370:7334"
    assert got[0].startswith("at ") and got[0].endswith(" now") and "fe80::1" not in got[2]
    assert got[3:] == texts[3:]


def test_month_first_dates(spark):
    texts = ["12/31/1990", "on 12/31/1990.", "02/30/1990", "13/13/1990", "03/04/1990"]
    got = list(run(spark, texts)[0])
    new = datetime.datetime.strptime(got[0], "%m/%d/%Y")
    assert new.day > 12 and got[0] != texts[0] and got[1] == f"on {got[0]}."
    assert got[2] == texts[2] and got[3] == texts[3]
    datetime.datetime.strptime(got[4], "%d/%m/%Y")
    assert len(pii.MONTH_FIRST) == 365 - 144


def test_column_of_the_count_is_kept(spark):
    df = spark.createDataFrame([(1, "call +1 (807) 555-5623", 77), (2, None, 78)], "doc_id long, text string, n_pii int")
    got = pii.pseudonymise(df, KEY).orderBy("doc_id").collect()
    assert [(r["n_pii"], r["n_pii_found"]) for r in got] == [(77, 1), (78, 0)]


def test_key_comes_from_the_session(spark):
    from kinlink.llm import registry

    drawn = registry.pii_key(spark)
    assert len(drawn) == 64 and registry.pii_key(spark) == drawn
    spark.conf.set(registry.PII_KEY, "secret")
    try:
        assert registry.pii_key(spark) == "secret"
    finally:
        spark.conf.unset(registry.PII_KEY)
