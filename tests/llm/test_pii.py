import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from strandloom.llm import pii

RX = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(text):
    out = []
    for rank, (kind, rx) in enumerate(RX.items()):
        for m in rx.finditer(text or ""):
            v = m[0]
            d = "".join(c for c in v if c in "0123456789")
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in v.split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    out.sort()
    counts = [sum(o[3] == k for o in out) for k in RX]
    return (*counts, hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in out).encode()).hexdigest())


FIXED = [
    None, "", "nothing here", "a@b.c", "a@b.c_d@e.f a@b", "x..y%+-@-a-.b-.c.", "@a.b a@.b", "😀é me@example.com 😀 you@x.org",
    "1.2.3.4.5.6.7.8 256.1.1.1 0255.001.0.00000000009", "999.1.1.1.2 1.2.3", "4845168114407329 and 4845 1681-1440 7329 4845  1681",
    "+1 (017) 555-7713 +12345 +1 22 333 4444 55555 66666", "++49 30 1234567+49 30 7654321", "+1-4845168114407329", "12-" * 400 + "1", "1" * 5000, "a" * 20000,
    "a." * 5000 + "@", "1." * 5000, "+1" * 300, "me@x.io " * 700, "10.0.0.1," * 700,
]


def fuzz():
    rnd = random.Random(4)
    for _ in range(300):
        yield "".join(rnd.choice(["a", "b.", "@", "1", "23", ".", " ", "-", "+", "(", "é", "😀", "_", "4845168114407329", "x@y.z", "9.9.9.9"]) for _ in range(rnd.randrange(60)))


def test_base(spark):
    rows = [(i, t, "clash") for i, t in enumerate([*FIXED, *fuzz()])] + [(None, "a@b.c", ""), (3, "a@b.c", ""), (3, "a@b.c", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted((str(r["doc_id"]), (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"])) for r in pii.summary(pii.find(df)).collect())
    assert got == sorted((str(d), brute(t)) for d, t, _ in rows)


def story(spark):
    common = "the quick report of a long day with some people in the town".split()
    rnd = random.Random(8)
    rows, text = [], lambda n: " ".join(rnd.choice(common) for _ in range(n))
    for i in range(12):
        rows.append((i, f"{text(9)} Zorbelius zorb@mail.example {text(9)}"))
    for i in range(12, 60):
        rows.append((i, f"{text(20)} call {rnd.choice(common)}"))
    rows += [(60 + i, "one fixed Quxington passage a@b.example here") for i in range(6)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_disclosing_terms(spark):
    got = {r["doc_id"]: r for r in pii.find(story(spark)).collect()}
    for i in range(12):
        assert [s["kind"] for s in got[i]["added"]] == ["drop"] and len(got[i]["base"]) == 1
    assert all(not got[i]["added"] for i in range(12, 66))  # no value; or the same context again and again
    assert len(got[60]["base"]) == 1
    clean = pii.sanitised(story(spark))
    t = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert all("orb" not in t[i] and "[EMAIL]" in t[i] for i in range(12)) and t[60] == "one fixed Quxington passage [EMAIL] here"


def test_a_disclosing_term_is_marked_where_it_is_the_only_trace(spark):
    more = spark.createDataFrame([(100, "Zorbelius went to town"), (101, "nobody but Zorbelius"), (102, "nobody else")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find(story(spark).union(story(spark).selectExpr("doc_id + 200", "replace(text, 'day', 'night')")).union(more)).collect()}
    assert [[(s["start"], s["end"]) for s in got[i]["added"]] for i in (100, 101, 102)] == [[(0, 9)], [(11, 20)], []]
    assert all(len(got[i]["added"]) == 1 for i in (*range(12), *range(200, 212)))


def test_terms_far_from_the_value(spark):
    rnd = random.Random(5)
    text = lambda n: " ".join(rnd.choice("report of a long day with some people in town".split()) for _ in range(n))
    rows = [(i, f"Zorbelius {text(60)} write to one@mail.example {text(60)} zorbelius") for i in range(5)] + [(i, text(80)) for i in range(5, 60)]
    # Copies of one long text with a word changed each are one context.
    copy = text(200)
    rows += [(60 + i, f"Quxington {copy} two@mail.example {copy} changed{i}") for i in range(4)]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows[:5]:
        marked = {t[s["start"] : s["end"]].lower() for s in got[i]["added"]}
        assert "zorbelius" in marked and marked <= {"zorbelius", "write", "to"}
        assert sum(t[s["start"] : s["end"]].lower() == "zorbelius" for s in got[i]["added"]) == 2
    assert all(not got[i]["added"] for i, _ in rows[5:])


def test_secrets_and_terms_of_a_kind(spark):
    rnd = random.Random(6)
    text = lambda n: " ".join(rnd.choice("report of a long day with some people in town".split()) + rnd.choice("abcdefgh") for _ in range(n))
    code = lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(40))
    codes = {i: code() for i in range(30)}
    rows = [(i, f"{text(9)} apikey = \"{c}\" {text(9)}") for i, c in codes.items()]
    rows += [(i, text(30)) for i in range(30, 900)]
    rows += [(900, f"Apikey {text(4)}"), (None, f"{text(3)} APIKEY"), (None, f"{text(3)} APIKEY")]
    # Copies of one text with a value, and a word that only they have.
    one = f"{text(20)} {code()} gronk {text(20)}"
    rows += [(1000 + i, one if i % 3 else one.replace(" ", f" x{i} ", 1)) for i in range(60)]
    rows += [(2000, "abcdefghijklmnopqrstuvwxyz 1234567890123456x a1 b2 Internationalisation12 deadbeefdeadbeef a1b2c3d4e5f6g7h")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find(df).collect()
    got = {r["doc_id"]: r for r in found}
    texts = dict(rows)
    marks = lambda i: [(s["kind"], texts[i][s["start"] : s["end"]]) for s in got[i]["added"]]
    for i, c in codes.items():
        (kind, term), secret = marks(i)
        assert kind in ("term", "drop") and term == "apikey" and secret == ("secret", c)
    assert all(not marks(i) for i in [*range(30, 900), 2000])
    assert [t for _, t in marks(900)] == ["Apikey"]  # where nothing else is found, too
    assert [[s["start"] > 0 for s in r["added"]] for r in found if r["doc_id"] is None] == [[True], [True]]
    assert all([k for k, _ in marks(1000 + i)] == ["secret"] for i in range(60))
    assert all(s["kind"] in ("secret", "term", "drop") for r in found for s in r["added"]) and not any(r["base"] for r in found)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(df.withColumn("__s", df.text).withColumn("base", df.text)).collect()}
    assert all("[SECRET]" in clean[i] and codes[i] not in clean[i] and "apikey" not in clean[i] for i in codes)
    assert "pikey" not in clean[900] and clean[30] == texts[30]


def test_share_against_brute_force(spark):
    """Which terms disclose the kind: counted over single documents."""
    import math

    rnd = random.Random(9)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = []
    for i in range(1500):
        with_value = rnd.random() < 0.06
        t = rnd.sample(words, 8) + (["hint"] if rnd.random() < (0.9 if with_value else 0.002) else []) + (["weak"] if rnd.random() < (0.9 if with_value else 0.05) else [])
        rnd.shuffle(t)
        rows.append((i, " ".join(t) + (f" p{i}@mail.example" if with_value else "")))
    value = {i: re.findall(r"\S+@\S+", t) for i, t in rows}
    want = {}
    p = sum(map(bool, value.values())) / len(rows)
    for term in [*words, "hint", "weak"]:
        have = [i for i, t in rows if term in t.split(" ")]
        k, n, z = sum(bool(value[i]) for i in have), len(have), 3.29
        low = (k / n + z * z / 2 / n - z * math.sqrt(k / n * (1 - k / n) / n + z * z / 4 / n / n)) / (1 + z * z / n)
        share = math.log(low / p) / -math.log(p) if k >= 3 and low > 0 else 0
        if share >= 0.8:
            want[term] = "drop" if share >= 0.95 else "term"
    assert "hint" in want and "weak" not in want
    got = {}
    for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        for s in r["added"]:
            got.setdefault(rows[r["doc_id"]][1][s["start"] : s["end"]], set()).add(s["kind"])
    assert got == {t: {k} for t, k in want.items()}


def test_sanitised(spark):
    rows = [(1, "x +1-4845168114407329 y 1.2.3.4 a@b.c", 5), (2, None, 0), (3, "", 0), (4, "plain", 5), (4, "é me@x.io", 9), (4, "é me@x.io", 9), (None, "me@x.io", 7), (5, "at @ 12 only", 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = sorted(map(str, (tuple(r) for r in pii.sanitised(df).collect())))
    want = [(1, "x +1-[CARD] y [IP] [EMAIL]", 26), (2, None, 0), (3, "", 0), (4, "plain", 5), (4, "é [EMAIL]", 9), (4, "é [EMAIL]", 9), (None, "[EMAIL]", 7), (5, "at @ 12 only", 12)]
    spans = brute(rows[0][1])
    assert spans[:2] == (1, 1)
    if spans[2] == 0:
        want[0] = (1, "x +1-4845168114407329 y [IP] [EMAIL]", 36)
    assert got == sorted(map(str, want))


@pytest.mark.parametrize("f", [pii.find, pii.sanitised])
def test_empty(spark, f):
    assert f(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_places_of_terms_alone_become_rows(spark):
    """Words of a text that disclose nothing are no rows, however many there are."""
    text = "Über alles: " + "plain words here " * 300 + "TOKEN x, token. tokens"
    d = spark.createDataFrame([(text, ["token", "über"]), ("nothing", ["token"])], "text string, terms array<string>")
    got = [[(p["start"], p["value"]) for p in r["p"]] for r in d.select(pii._places(F.col("text"), F.col("terms")).alias("p")).collect()]
    assert got == [[(0, "Über"), (text.index("TOKEN"), "TOKEN"), (text.index("token."), "token")], []]
