import random
import re
from datetime import date

import pytest

from glyphmeter.llm import pii
from tests.llm.data import clashing, docs, empty, rows_of

P = pii.Pseudonyms(b"k")


@pytest.mark.parametrize("length", [1, 2, 3, 4])
def test_permutation(length):
    assert len({P.number(v, 10, length, "t") for v in range(10**length)}) == 10**length
    assert [P.number(v, 10, length, "t") for v in range(9)] != [P.number(v, 10, length, "u") for v in range(9)] or length == 1


def test_dates_are_permuted_among_dates():
    days = [date.fromordinal(pii._FIRST + k) for k in range(0, pii._DAYS, 37)]
    assert len({P.date(d) for d in days}) == len(days)
    assert all(pii._width(P.date(d)) == pii._width(d) for d in days)


def change(text):
    return pii.replace(text, P)


VALID = ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "378282246310005", "123-45-6789", "+1 (136) 555-7479", "(017) 555-7713", "555-123-4567", "152.143.123.131", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "1990-02-01", "1/2/1990", "05/20/1990", "1.2.1990", "12 March 1990", "Mar 3, 2001", "jo.smith7@mail.example.com", "4111\u00a01111\u202f1111\u00a01111", "DE89\u00a03704\u00a00044\u00a00532\u00a00130\u00a000", "10/5/1990"]
INVALID = ["4111111111111112", "9999999999999999", "000-12-3456", "256.1.1.1", "1.2.3", "1990-13-01", "31/02/1990", "DE00 3704 0044 0532 0130 00", "12345", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "a@b", "1.2.3.4.5"]


@pytest.mark.parametrize("value", VALID)
def test_valid_values_change_within_their_format(value):
    text, n = change(f"x {value}, y")
    new = text[2:-3]
    assert n == 1 and new != value
    shape = lambda s: re.sub(r"[0-9]", "9", re.sub(r"[A-Za-z]+", "a", s))
    folded = (lambda s: re.sub(r"9+", "9", shape(s))) if value.count(".") == 3 else shape
    assert folded(new) == folded(value)
    assert change(f"x {new}, y")[1] == 1  # still valid: check digits and dates


@pytest.mark.parametrize("value", INVALID)
def test_invalid_values_stay(value):
    assert change(f"x {value} y") == (f"x {value} y", 0)


def test_equal_values_stay_linked():
    a, b = change("card 4111 1111 1111 1111.")[0], change("4111-1111-1111-1111!")[0]
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b)
    assert change("born 1990-02-01")[0][5:] == "-".join(f"{int(x):02d}" for x in reversed(change("01/02/1990")[0].split("/")))
    assert pii.replace("4111111111111111", pii.Pseudonyms(b"other")) != pii.replace("4111111111111111", P)


@pytest.mark.parametrize(
    "text",
    [
        "+1 (826) 555-4081| |190.137.223.204",
        "+1 (826) 555-4081| 42 calls",
        "+49 30 1234567| |2024-05-06",
        "+49 30 1234567| 12:30",
        "+49 30 1234567| |4111 1111 1111 1111",
        "4111111111111111| 12",
        "4111111111111111|-12",
        "12 |4111111111111111",
        "AT61 1904 3002 3457 3201| EUR",
        "BE68 5390 0754 7034| PAID |2024-05-06",
    ],
)
def test_values_beside_others_change_as_they_do_alone(text):
    parts = text.split("|")
    alone = [change(x) for x in parts]
    assert change(text.replace("|", "")) == ("".join(t for t, _ in alone), sum(n for _, n in alone)) != (text, 0)
    assert all(n == 1 for (_, n), x in zip(alone, parts) if len(x) > 9)


def test_one_pseudonym_in_every_notation():
    numbers = lambda t: [int(x) for x in re.findall(r"[0-9]+", t)]
    for y, m, d in [(1999, 12, 31), (2020, 2, 1), (1950, 10, 12), (2001, 3, 13)]:
        want = numbers(change(f"{y}-{m:02d}-{d:02d}")[0])
        assert numbers(change(f"{d}/{m}/{y}")[0]) == numbers(change(f"{d:02d}.{m:02d}.{y}")[0]) == want[::-1]
        assert numbers(change(f"{y}-{m:02d}-{d:02d}T10:00:00")[0])[:3] == want
        assert numbers(change(f"{y}-{m:02d}-{d:02d}T10:00:00")[0])[3:] == [10, 0, 0]
        if d > 12:
            assert numbers(change(f"{m:02d}/{d}/{y}")[0]) == [want[1], want[2], want[0]]
        for name in (pii._MONTHS[m - 1], pii._MONTHS[m - 1].lower(), pii._MONTHS[m - 1][:3].upper()):
            text, n = change(f"on {d} {name} {y}.")
            assert n == 1 and numbers(text) == [want[2], want[0]]
            assert pii._MONTH[text.split()[2].lower()] == want[1] and text.split()[2].islower() == name.islower()
    tail = lambda t: re.sub(r"\D", "", change(t)[0])[-10:]
    assert tail("+1 415 555 2671") == tail("(415) 555-2671") == tail("415-555-2671") == tail("+14155552671") == tail("+1 415 555 2671 ")
    assert change("+1 415 555 2671 2 times")[0] == change("+1 415 555 2671")[0] + " 2 times"


def valid_readings(text):
    """Every card number and IBAN of the text that begins and ends with a group, by all starts and all ends."""
    out = []
    for a in range(len(text)):
        if a and text[a - 1].isalnum():
            continue
        for b in range(a + 13, min(len(text), a + 45) + 1):
            if b < len(text) and text[b].isalnum():
                continue
            part = re.sub(f"[{pii._SP}]", "", text[a:b])
            if not text[a].isalnum() or not text[b - 1].isalnum() or re.search(f"[{pii._SP}-]{{2}}|^[{pii._SP}-]", text[a:b]):
                continue
            digits = part.replace("-", "")
            if digits.isdigit() and 13 <= len(digits) <= 19 and pii.luhn(digits) == 0:
                out.append(text[a:b])
            if re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]+", part) and len(part) == pii._IBAN_LENGTH.get(part[:2]) and pii.iban_valid(part):
                out.append(text[a:b])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_no_valid_card_or_iban_is_left(seed):
    rng = random.Random(seed)
    values = ["4111 1111 1111 1111", "378282246310005", "4111-1111-1111-1111", "AT61 1904 3002 3457 3201", "GB82WEST12345698765432", "5555\u00a05555\u00a05555\u00a04444"]
    other = ["12/25", "123", "USD 500", "EUR", "7", "PAID", "2024-05-06", "x", "+1 826 555 4081", "9999 1234", ",", "(", "2"]
    for _ in range(300):
        text = " ".join(rng.choice(values if rng.random() < 0.4 else other) for _ in range(6))
        new = change(text)[0]
        assert not [v for v in valid_readings(text) if v in new], text


def test_long_rows_of_numbers_end():
    text = "1 2 3 " * 20000 + "+1 826 555 4081 " * 5000
    assert change(text)[1] >= 5000


def test_different_values_stay_apart():
    rng = random.Random(2)
    cards = set()
    while len(cards) < 300:
        head = "".join(rng.choice("0123456789") for _ in range(15))
        cards.add(head + str(-pii.luhn(head + "0") % 10))
    new = {P.card(c) for c in cards}
    assert len(new) == 300 and all(pii.luhn(c) == 0 for c in new)


def test_prefilter_lets_no_value_through():
    import pyarrow as pa
    import pyarrow.compute as pc

    assert all(pc.match_substring_regex(pa.array([f"x {v}" for v in VALID]), pii.PREFILTER).to_pylist())


ROWS = [(1, "call +1 (136) 555-7479"), (1, "call +1 (136) 555-7479"), (2, None), (3, ""), (None, "on 1990-02-01"), (4, "a" * 30000 + " 123-45-6789 " + "1" * 30000)]


def test_table(spark):
    got = pii.pseudonymise(docs(spark, ROWS), b"k")
    want = [(i, None if t is None else change(t)[0], 0 if t is None else change(t)[1]) for i, t in ROWS]
    assert rows_of(got, "doc_id", "text", "pii_values") == sorted(want, key=repr)


def test_edges(spark):
    assert pii.pseudonymise(empty(spark)).count() == 0
    odd = clashing(spark, [(1, "on 1990-02-01")])
    got = pii.pseudonymise(odd, b"k")
    assert sorted(got.columns) == sorted(odd.columns) and got.first()["pii_values"] == 1 and got.first()["lang"] == "en"
    kept = pii.pseudonymise(odd, b"k", count=None)
    assert kept.columns == odd.columns and kept.first()["pii_values"] == "x"
