import datetime
import hashlib
import random
import re

from pyspark.sql import functions as F

from riskframe.llm.pii import pseudonymise

SCHEMA = "doc_id long, text string, n_found int, kind string"


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(digits[::-1])) % 10 == 0


def card(rng):
    body = "".join(rng.choice("0123456789") for _ in range(15))
    return next(body + c for c in "0123456789" if luhn(body + c))


def run(spark, texts, key="k"):
    rows = [(k, t, 5, "clash") for k, t in enumerate(texts)]
    return {r.doc_id: r for r in pseudonymise(spark.createDataFrame(rows, SCHEMA), key).collect()}


def test_formats_hold_and_values_stay_apart_and_linked(spark):
    rng = random.Random(3)
    cards = sorted({card(rng) for _ in range(150)})
    start = datetime.date(1900, 1, 1)
    dates = sorted({(start + datetime.timedelta(days=rng.randrange(73_049))).isoformat() for _ in range(300)} | {"2000-02-29", "1904-02-29", "2099-12-31", "1900-03-01"})
    ips = sorted({".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(100)})
    phones = sorted({f"+1 ({rng.randrange(1000):03d}) 555-{rng.randrange(10000):04d}" for _ in range(100)})
    ssns = ["123-45-6789", "665-01-0001", "667-99-9999", "001-01-0001", "899-50-5000"]
    for values, valid in (
        (cards, lambda s: re.fullmatch(r"\d{16}", s) and luhn(s)),
        (dates, lambda s: datetime.date.fromisoformat(s)),
        (ips, lambda s: all(0 <= int(x) <= 255 and str(int(x)) == x for x in s.split("."))),
        (phones, lambda s: re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", s)),
        (ssns, lambda s: re.fullmatch(r"\d{3}-\d{2}-\d{4}", s) and s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"),
    ):
        got = run(spark, [f"ä {v}, end" for v in values] + [f"{values[0]}\n{values[1]}!! {values[0]}"])
        new = [got[k].text[2:-5] for k in range(len(values))]
        assert all(valid(x) for x in new)
        assert len(set(new)) == len(values)  # a permutation: distinct values stay distinct
        assert sum(a != b for a, b in zip(new, values, strict=True)) >= 0.9 * len(values)
        assert got[len(values)].text == f"{new[0]}\n{new[1]}!! {new[0]}"  # linked across documents
        assert all(r.n_found >= 1 for r in got.values())


def test_decoys_and_clean_texts_stay(spark):
    texts = ["4668656817506358 no", "1.2.3.400", "2023-02-30", "000-12-3456", "666-12-3456", 'token = "6fd311c3cf3163b66d5a9875b883d8ce"', "v 12.5, 3/4", "", "a@b", "12345678901234567890123"]
    got = run(spark, [*texts, None])
    assert [got[k].text for k in range(len(texts))] == texts
    assert got[len(texts)].text == "" and all(r.n_found == 0 for r in got.values())


def test_iban_and_spaced_card_and_email(spark):
    got = run(spark, ["DE89 3704 0044 0532 0130 00 x", "4111 1111 1111 1111", "Mail Jo.Doe+1@mail7.example.com, JO.DOE+1@mail7.example.com", "DE88 3704 0044 0532 0130 00"])
    iban = got[0].text[:-2]
    digits = iban.replace(" ", "")
    assert re.fullmatch(r"DE\d{2} (\d{4} ){4}\d{2}", iban) and int(digits[4:] + "1314" + digits[2:4]) % 97 == 1 and iban != "DE89 3704 0044 0532 0130 00"
    assert re.fullmatch(r"4\d{3}( \d{4}){3}", got[1].text) and luhn(got[1].text.replace(" ", ""))
    first, second = re.findall(r"[a-z0-9]+@mail7\.example\.com", got[2].text)
    assert first == second and "oe" not in got[2].text and got[2].n_found == 2
    assert got[3].text == "DE88 3704 0044 0532 0130 00"


def test_key_changes_pseudonyms_and_other_columns_stay(spark):
    a, b = run(spark, ["192.168.10.20"], "one")[0], run(spark, ["192.168.10.20"], "two")[0]
    assert a.text != b.text and a.kind == "clash" and a.found[0].old == "192.168.10.20" and a.found[0].kind == "ip"


def test_empty_table(spark):
    assert pseudonymise(spark.createDataFrame([], SCHEMA), "k").collect() == []


def feistel(key, kind, a, ma, b, mb):
    """The rounds, one value at a time."""
    h = lambda r, half: int(hashlib.sha256(f"{key}|{r}|{kind}|{half}".encode()).hexdigest()[:13], 16)
    for r in range(8):
        if r % 2:
            b = (b + h(r, a)) % mb
        else:
            a = (a + h(r, b)) % ma
    return a, b


def test_equals_rounds_by_hand(spark):
    rng = random.Random(9)
    start = datetime.date(1900, 1, 1)
    day = lambda n: start + datetime.timedelta(days=n)
    texts, want = [], []
    for n in [0, 59, 73_048, *(rng.randrange(73_049) for _ in range(60))]:
        a, b = feistel("k", "date", n // 4297, 17, n % 4297, 4297)
        shape = rng.choice(["%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y"])
        write = lambda d, shape=shape: d.strftime(shape).replace(d.strftime("%Y"), f"{d.year:04d}")
        texts.append(write(day(n)))
        want.append(write(day(a * 4297 + b)))
    for _ in range(40):
        o = [rng.randrange(256) for _ in range(4)]
        a, b = feistel("k", "ip", o[0] * 256 + o[1], 65536, o[2] * 256 + o[3], 65536)
        texts.append(".".join(map(str, o)))
        want.append(f"{a // 256}.{a % 256}.{b // 256}.{b % 256}")
        c = card(rng)
        a, b = feistel("k", "card", int(c[1:8]), 10**7, int(c[8:15]), 10**7)
        body = f"{c[0]}{a:07d}{b:07d}"
        texts.append(c)
        want.append(next(body + x for x in "0123456789" if luhn(body + x)))
        p = rng.randrange(10**10)
        a, b = feistel("k", "phone", p // 10**5, 10**5, p % 10**5, 10**5)
        tell = lambda n: f"+1 ({n // 10**7:03d}) {n // 10**4 % 1000:03d}-{n % 10**4:04d}"
        texts.append(tell(p))
        want.append(tell(a * 10**5 + b))
        area, group, serial = rng.choice([1, 665, 667, 899]), rng.randrange(1, 100), rng.randrange(1, 10000)
        a, b = feistel("k", "ssn", area - (2 if area > 666 else 1), 898, (group - 1) * 9999 + serial - 1, 99 * 9999)
        texts.append(f"{area:03d}-{group:02d}-{serial:04d}")
        want.append(f"{a + (2 if a + 1 >= 666 else 1):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}")
    got = run(spark, texts)
    assert [got[k].text for k in range(len(texts))] == want


def test_every_day_is_permuted_and_leap_days_leak_nothing(spark):
    days = spark.range(73_049).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("text"))
    new = pseudonymise(days, "k").select("text", F.col("found")[0]["old"].alias("old"))
    assert new.where("to_date(text) between '1900-01-01' and '2099-12-31'").select("text").distinct().count() == 73_049
    leap = {r.old: r.text for r in new.where("old like '%-02-29'").collect()}
    moves = {(datetime.date.fromisoformat(b) - datetime.date.fromisoformat(a)).days for a, b in leap.items()}
    assert len(leap) == 49 and len(moves) > 40 and sum(b.endswith("-02-29") for b in leap.values()) < 5


def test_dates_of_time_stamps(spark):
    got = run(spark, ["at 2020-01-05T12:00:00Z.", "2020-01-05 12:00", "x2020-01-05T12", "2020-01-05Tea"])
    assert got[0].text == f"at {got[1].text[:10]}T12:00:00Z." and got[0].n_found == 1 and got[1].text[:10] != "2020-01-05"
    assert got[2].text == "x2020-01-05T12" and got[3].text == "2020-01-05Tea"
