"""Surrogates of names in all their writings, ordinary words that are names too, and of every kind by brute force."""

import ipaddress
import random
import re

import pytest

from rosterly.llm import pii_surrogates as pii


def rewritten(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in sorted(pii.anonymised(docs, "k").collect(), key=lambda r: r.doc_id)]


def test_whole_names_are_replaced(spark):
    texts = ["Ask Mr McDonald now", "Mr O'Brien and Mrs O’Hara-McKay left", "See Mr J. Smith or Mr J.R. Smith, and Mr J Smith", "MR BROWN met Mrs Brown", "Mr van Dyke and Herr von der Leyen", "Dr DeWitt's dog"]
    got = rewritten(spark, *texts)
    for real in ("McDonald", "Donald", "Brien", "Hara", "McKay", "Smith", "BROWN", "Brown", "Dyke", "Leyen", "DeWitt", "Witt"):
        assert not any(real in t for t in got), real
    assert re.fullmatch(r"Ask Mr \p{L}+ now".replace(r"\p{L}", "[A-Za-z]"), got[0]) and re.fullmatch("Mr [A-Za-z]+ and Mrs [A-Za-z]+ left", got[1])
    one = re.fullmatch(r"See Mr ([A-Z])\. (\w+) or Mr ([A-Z])\.([A-Z])\. ?(\w+), and Mr ([A-Z]) (\w+)", got[2])
    assert one and one[1] == one[3] == one[6] and one[2] == one[5] == one[7]
    brown = re.fullmatch(r"MR ([A-Z]+) met Mrs ([A-Z][a-z]+)", got[3])
    assert brown and brown[1].lower() + "a" == brown[2].lower()
    assert re.fullmatch(r"Mr van [A-Z][a-z]+ and Herr von der [A-Z][a-z]+", got[4]) and re.fullmatch(r"Dr [A-Z][a-z]+'s dog", got[5])


def test_ordinary_words_that_are_names_stay(spark):
    got = rewritten(spark, "Mr Will Young sang. Will you come? Young people may. Will Young left.\nYoung ones; we saw Young there.")[0]
    will, young = got.split()[1:3]
    young = young.rstrip(".") if young.endswith(".") else young
    assert got == f"Mr {will} {young} sang. Will you come? Young people may. {will} {young} left.\nYoung ones; we saw {young} there."
    assert rewritten(spark, "Will you come? Young people.", "May it be so. Mark this.") == ["Will you come? Young people.", "May it be so. Mark this."]


def test_addresses_of_the_sixth_version_and_phones_in_pairs(spark):
    got = rewritten(spark, "at 2001:db8::8a2e:370:7334 and 2001:DB8::8A2E:370:7334, 06 12 34 56 78 or +33 6 12 34 56 78; at 10:20:30 std::vector a::b")[0]
    a, b = re.search(r"at (\S+) and (\S+),", got).groups()
    assert ipaddress.ip_address(a) and a == b.lower() and b == b.upper() and a != "2001:db8::8a2e:370:7334"
    assert "12 34 56 78" not in got and re.search(r", 0\d \d\d \d\d \d\d \d\d or \+3\d \d \d\d \d\d \d\d \d\d;", got)
    assert got.endswith("at 10:20:30 std::vector a::b")


def luhn(n):
    return sum(int(x) if k % 2 == 0 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(reversed(n))) % 10 == 0


def made(rng, kind):
    """(the entity, how it is written in a text) of a kind, by plain Python."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "email":
        e = f"{rng.choice('abc')}{d(3)}.{rng.choice('xyz')}@host{d(2)}.org"
        return e, rng.choice([e, e.upper(), e.capitalize()])
    if kind == "ipv4":
        e = ".".join(str(rng.randint(1, 254)) for _ in range(4))
        return e, e
    if kind == "ssn":
        e = d(9)
        return e, f"{e[:3]}-{e[3:5]}-{e[5:]}"
    if kind == "iban":
        account = d(18)
        check = 98 - int(account + "131400") % 97
        e = f"DE{check:02d}{account}"
        return e, rng.choice([e, " ".join(e[k : k + 4] for k in range(0, 22, 4))])
    if kind == "card":
        body = "4" + d(14)
        e = next(body + x for x in "0123456789" if luhn(body + x))
        return e, rng.choice([e, " ".join(e[k : k + 4] for k in range(0, 16, 4)), "-".join(e[k : k + 4] for k in range(0, 16, 4))])
    e = "1" + d(10)
    return e, rng.choice([f"+{e[0]} {e[1:4]} {e[4:7]} {e[7:]}", f"+{e[0]} ({e[1:4]}) {e[4:7]}-{e[7:]}", f"+{e[0]}-{e[1:4]}-{e[4:7]}-{e[7:]}"])


SHAPE = {"email": r"[a-z0-9.]+@[a-z0-9]+\.org", "ipv4": r"\d+\.\d+\.\d+\.\d+", "ssn": r"\d{9}", "iban": r"DE\d{20}", "card": r"\d{16}", "phone": r"\d{11}"}


@pytest.mark.parametrize("kind", list(SHAPE))
def test_every_kind_by_brute_force(spark, kind):
    """Each mention against one mapping of entities to surrogates that all mentions must agree on, one to one."""
    rng = random.Random(kind)
    pool = [made(random.Random(f"{kind}{k}"), kind)[0] for k in range(150)]
    rows, said = [], []
    for i in range(300):
        k = rng.randrange(150)
        entity, written = made(random.Random(f"{kind}{k}"), kind)
        rows.append((i, f"see {written} now"))
        said.append((entity, written))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.anonymised(docs, "k").collect()}
    plain = (lambda x: x.lower()) if kind in ("email", "ipv4") else lambda x: re.sub("[^0-9A-Z]", "", x)
    mapping = {}
    for i, (entity, written) in enumerate(said):
        put = re.fullmatch("see (.*) now", got[i].text)[1]
        assert got[i].pii_kinds == [kind] and got[i].pii_mentions == 1 and re.fullmatch(SHAPE[kind], plain(put))
        assert mapping.setdefault(entity, plain(put)) == plain(put)
        if kind not in ("email", "ipv4"):
            assert re.sub(r"\d", "0", put) == re.sub(r"\d", "0", written)
        if kind == "card":
            assert luhn(plain(put)) and put[0] == "4"
        if kind == "iban":
            assert int(plain(put)[4:] + "1314" + plain(put)[2:4]) % 97 == 1
    assert len(set(mapping.values())) == len(mapping) and not set(mapping.values()) & set(pool)
