import hashlib
import re
import time
from datetime import date, timedelta

from pyspark.sql import functions as F

from lorespark.llm import pseudonyms as ps


LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def places(key, label, count):
    label = hashlib.sha512(label.encode()).hexdigest()
    out = "".join(hashlib.sha512("\n".join([key, str(b), label, key]).encode()).hexdigest() for b in range((count - 1) // 32 + 1))
    return [int(out[4 * i : 4 * i + 4], 16) for i in range(count)]


def feistel(values, radix, key):
    tag, half = ",".join(map(str, radix)), len(values) // 2
    add = lambda own, rad, other, k: [(v + s) % r for v, s, r in zip(own, places(key, "|".join([str(k), tag, ",".join(map(str, other))]), len(own)), rad)]
    if len(values) == 1:
        return add(values, radix, [], 0)
    left, right = values[:half], values[half:]
    for k in range(1, ps.ROUNDS + 1):
        if k % 2:
            left = add(left, radix[:half], right, k)
        else:
            right = add(right, radix[half:], left, k)
    return left + right


def shaped(text, key, classes=(LOWER, UPPER, DIGITS)):
    of = lambda c: next((k for k in classes if c in k), c)
    return "".join(of(c)[n] for c, n in zip(text, feistel([of(c).index(c) for c in text], [len(of(c)) for c in text], key)))


def luhn(s):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(re.sub(r"\D", "", s)))) % 10 == 0


def test_values_match_a_plain_version(spark):
    cases = ["4539578763621486", "4539 5787 6362 1486", "4539578763621487", "192.168.0.1", "300.1.1.1", "an.b-7@mail5.example.com", "2024-02-29", "2023-02-29", "29.02.2024", "01/31/1999", "31/01/1999", "1492-01-01", "123-45-6789", "000-45-6789", "+1 (743) 555-3824", "a" * 8 + "0123" * 8, "A" * 8 + "0123" * 8]
    got = {r.v: r.p for r in spark.createDataFrame([(c,) for c in cases], "v string").select("v", ps.pseudonym(F.col("v"), "k")["pseudonym"].alias("p")).collect()}
    assert [c for c in cases if got[c] is None] == ["4539578763621487", "300.1.1.1", "2023-02-29", "31/01/1999", "1492-01-01", "000-45-6789"]
    body = shaped("453957876362148", "k|card", (DIGITS,))
    assert got["4539578763621486"][:-1] == body and luhn(got["4539578763621486"])
    assert luhn(got["4539 5787 6362 1486"]) and got["4539 5787 6362 1486"].replace(" ", "") == got["4539578763621486"]
    assert got["192.168.0.1"] == ".".join(map(str, feistel([192, 168, 0, 1], [256] * 4, "k|ip")))
    assert got["an.b-7@mail5.example.com"] == shaped("an.b-7", "k|email") + "@mail5.example.com"
    n = (date(2024, 2, 29) - date(1800, 1, 1)).days
    a, b = feistel([n // 773, n % 773], [189, 773], "k|date")
    day = date(1800, 1, 1) + timedelta(a * 773 + b)
    assert got["2024-02-29"] == day.isoformat() and got["29.02.2024"] == day.strftime("%d.%m.%Y")
    assert re.fullmatch(r"\d\d/\d\d/\d{4}", got["01/31/1999"])
    assert got["+1 (743) 555-3824"] == "+1 " + shaped("(743) 555-3824", "k|phone")
    assert got["a" * 8 + "0123" * 8] == shaped("a" * 8 + "0123" * 8, "k|secret", (ps.HEX,))
    assert got["A" * 8 + "0123" * 8] == got["a" * 8 + "0123" * 8].upper()
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", got["123-45-6789"]) and got["123-45-6789"] != "123-45-6789"


def test_permutes_without_collisions(spark):
    pins = spark.range(10_000).select(F.concat(F.lit("+1 "), F.lpad(F.col("id").cast("string"), 4, "0")).alias("v"))
    assert pins.select(ps.pseudonym(F.col("v"), "k")["pseudonym"].alias("p")).where(r"p rlike '^\\+1 [0-9]{4}$'").distinct().count() == 10_000
    days = spark.range(0, 146_097, 37).select(F.date_format(F.expr("date_add(date'1800-01-01', int(id))"), "yyyy-MM-dd").alias("v"))
    out = days.select(ps.pseudonym(F.col("v"), "k")["pseudonym"].alias("p"))
    assert out.distinct().count() == days.count() and out.where("to_date(p) between '1800-01-01' and '2199-12-31'").count() == days.count()


def test_whole_texts(spark):
    card = "4539578763621486"
    text = f"pay {card}, or mail an@mail5.example.com. From 10.0.0.1!! on 2024-02-29; token = \"{'ab01' * 10}\"### v1.2.3.4.5 id 12345678901234 +1 (499) 555-6503%%%"
    rows = [(1, text, "x"), (2, f"again {card}", "y"), (2, f"again {card}", "y"), (3, None, None), (4, "", "z"), (None, "plain É text", "z"), (5, card, "q"), (6, (card + " ") * 3000, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pii string")
    got = ps.pseudonymise(docs, "k").collect()
    assert len(got) == len(rows)
    one = next(r for r in got if r.doc_id == 1)
    assert [p.kind for p in one.pii] == ["card", "email", "ip", "date", "secret", "phone"]
    new = one.pii[0].pseudonym
    assert card not in one.text and "an@mail5" not in one.text and "10.0.0.1" not in one.text and "ab01ab01" not in one.text and "555-6503" not in one.text
    assert "v1.2.3.4.5 id 12345678901234" in one.text and one.text.startswith(f"pay {new}, or mail ") and len(one.text) == len(text) + len(one.pii[2].pseudonym) - len("10.0.0.1")
    assert all(r.text == f"again {new}" for r in got if r.doc_id == 2)
    assert next(r for r in got if r.doc_id == 5).text == new and next(r for r in got if r.doc_id == 6).text == (new + " ") * 3000
    for r in got:
        if r.doc_id in (3, 4, None):
            assert r.pii == [] and r.text == {3: None, 4: "", None: "plain É text"}[r.doc_id]
    assert ps.pseudonymise(docs.limit(0), "k").collect() == []


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, "pay 4539578763621486", "a", "b", "c", "d")], "doc_id long, text string, _found string, _gaps string, _NEW string, __found string")
    got = ps.pseudonymise(docs, "k")
    assert got.columns == [*docs.columns, "pii"] and tuple(got.first())[2:6] == ("a", "b", "c", "d") and len(got.first().pii) == 1


def test_long_runs_take_linear_time(spark):
    card = "4539578763621486"
    runs = ["0a" * 500_000, "a.1-" * 250_000, "x@" + "a.1." * 250_000, "a@b" * 330_000, "1" * 1_000_000, "1.1.1.1." * 125_000, "token=" * 160_000, "secret=" + "0f" * 30_000 + " ", "+1 22 333 " * 5_000, "#" * 1_000_000]
    docs = spark.createDataFrame([(i, f"{r} {card} {r}") for i, r in enumerate(runs)], "doc_id long, text string").repartition(len(runs))
    assert docs.count() == len(runs)
    began = time.monotonic()
    got = ps.pseudonymise(docs, "k").collect()
    assert time.monotonic() - began < 30
    new = ps.pseudonymise(spark.createDataFrame([(card,)], "text string"), "k").first().text
    assert all(new in r.text and card not in r.text for r in got)


def test_secrets_of_any_length_and_without_digits(spark):
    secrets = ["ab01" * 35, "abcdef" * 10, "ABCDEF" * 10, "0f" * 2000]
    left = ["abcdef" * 5, "abcdeg" * 10]
    docs = spark.createDataFrame([(i, f"token={v} end") for i, v in enumerate(secrets + left)], "doc_id long, text string")
    got = [r.text for r in ps.pseudonymise(docs, "k").orderBy("doc_id").collect()]
    for text, v in zip(got, secrets):
        own = re.fullmatch("token=([0-9a-fA-F]+) end", text)[1]
        assert len(own) == len(v) and own != v and own.lower() == shaped(v.lower(), "k|secret", (ps.HEX,))
    assert got[len(secrets) :] == [f"token={v} end" for v in left]
