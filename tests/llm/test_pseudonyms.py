"""Pseudonyms: permutations within their formats, checked against plain Python and by going back."""

import hashlib
import random
import re

from lodestrand.llm import pseudonyms as ps
from pyspark.sql import functions as F


def plain_feistel(a, b, m, n, key, domain):
    for r in range(ps.ROUNDS):
        f = lambda x: int(hashlib.sha256(f"{key}|{domain}|{r}|{x}".encode()).hexdigest()[:15], 16)  # noqa: B023, E731
        if r % 2 == 0:
            a = (a + f(b)) % m
        else:
            b = (b + f(a)) % n
    return a, b


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def test_digits_against_plain_python_and_back(spark):
    rng = random.Random(2)
    values = ["".join(rng.choice("0123456789") for _ in range(n)) for n in range(2, 20) for _ in range(6)]
    df = spark.createDataFrame([(v,) for v in values], "v string").withColumn("p", ps.permute_digits(F.col("v"), "k", "digits"))
    for r in df.withColumn("back", ps.permute_digits(F.col("p"), "k", "digits", inverse=True)).collect():
        n = len(r["v"])
        u = n // 2
        a, b = plain_feistel(int(r["v"][:u]), int(r["v"][u:]), 10**u, 10 ** (n - u), "k", f"digits{n}")
        assert r["p"] == f"{a:0{u}d}{b:0{n - u}d}" and r["back"] == r["v"]


def test_permutation_of_all_short_numbers(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("v"))
    assert df.select(ps.permute_digits(F.col("v"), "k", "x").alias("p")).distinct().count() == 1000


def one(spark, values, inverse=False):
    df = spark.createDataFrame([(v,) for v in values], "v string").withColumn("k", ps.kind_of(F.col("v")))
    return {r["v"]: (r["k"], r["p"]) for r in df.withColumn("p", ps.pseudonym(F.col("v"), F.col("k"), "k", inverse)).collect()}


def test_formats(spark):
    rng = random.Random(4)
    cards = ["".join(rng.choice("0123456789") for _ in range(16)) for _ in range(60)]
    shapes = {"phone": ["+1 (017) 555-7713", "(555) 123-4567", "555-123-4567", "+491701234567"], "ssn": ["123-45-6789"], "address": ["97.51.17.173", "0.0.0.0", "255.255.255.255"], "date": ["2021-03-04", "1999/12/31", "01.02.2003", "12/31/1999"], "number": [*cards, "4532-1234-5678-9012", "4111 1111 1111 1111"]}
    for kind, values in shapes.items():
        out = one(spark, values)
        assert {k for k, _ in out.values()} == {kind}
        back = one(spark, [p for _, p in out.values()], inverse=True)
        for v, (_, p) in out.items():
            assert back[p] == (kind, v)
            if kind != "address":
                assert re.sub(r"\d", "9", v) == re.sub(r"\d", "9", p)
            if kind == "number":
                assert luhn(re.sub(r"\D", "", v)) == luhn(re.sub(r"\D", "", p))
            if kind == "address":
                assert all(0 <= int(x) < 256 for x in p.split(".")) and p.count(".") == 3
    assert one(spark, ["2021-03-04"])["2021-03-04"][1][:2] in ("18", "19", "20", "21")


def test_texts(spark):
    text = "Call +1 (017) 555-7713 or mail a.b@c.example.com; card 9807915762804490, 9807915762804490! token = \"b44e15e09fd311c3cf3163b66d5a9875b883d8ce\" on 2021-03-04 from 10.0.0.1."
    rows = [(1, text), (2, "9807915762804490"), (3, None), (4, ""), (5, "no data here: 12 or 3.5"), (None, text), (6, "x " * 50000 + "10.0.0.1")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id bigint, text string, kind string")
    got = {r["doc_id"]: r for r in ps.pseudonymise(df, "k").collect()}
    out = got[1]["text"]
    assert got[1]["__replaced"] == 7 and got[None]["text"] == out
    for secret in ("555-7713", "a.b@", "9807915762804490", "b44e15e0", "2021-03-04", "10.0.0.1"):
        assert secret not in out
    assert out.count(got[2]["text"]) == 2, "equal values stay linked"
    assert re.sub(r"u[0-9a-f]{15}@", "a.b@", re.sub("[0-9]", "9", re.sub(r'"[0-9a-f]{40}"', "T", out)))[:22] == "Call +9 (999) 999-9999"
    assert got[3]["text"] is None and got[3]["__replaced"] == 0 and got[4]["text"] == ""
    assert got[5]["text"] == "no data here: 12 or 3.5"
    assert got[6]["__replaced"] == 1 and got[6]["text"].startswith("x " * 50000)
    assert ps.pseudonymise(df, "other").where("doc_id = 2").first()["text"] != got[2]["text"]
    assert ps.pseudonymise(df.limit(0), "k").count() == 0


def test_joined_lists_and_international_groupings(spark):
    cards = ["4111111111111111", "5500000000000004", "3782 822463 10005", "3782-822463-10005", "3056 930902 5904"]
    phones = ["+44 20 7946 0958", "+33 1 23 45 67 89", "+49 30 123456", "+44 (0)20 7946 0958", "+49-1512-3456789", "+4512345678"]
    for kind, values in {"number": cards, "phone": phones}.items():
        out = one(spark, values)
        assert {k for k, _ in out.values()} == {kind} and all(v != p and re.sub(r"\d", "9", v) == re.sub(r"\d", "9", p) for v, (_, p) in out.items())
        assert {p for _, p in one(spark, [p for _, p in out.values()], inverse=True).values()} == set(values)
        if kind == "number":
            assert all(luhn(re.sub(r"\D", "", p)) for _, p in out.values())
        else:
            assert all(p.startswith(re.match(r"\+\d+(?=[ -])|", v)[0]) for v, (_, p) in out.items())
    a, b = cards[:2]
    texts = [f"a,{a},b", f"{a},{b}", f"card-{a}", f"{a}-{b}", f"{a}.{b}", f"No.{a}", f'{{"x":1,"c":{a},"y":2}}', f"1,{a},2", "3782 822463 10005,4111-1111-1111-1111", *(f"{p},{p}" for p in phones)]
    kept = ["0.30000000000000004", "x 12.1234567890123456,", "1234567890123456.25", "550e8400-e29b-41d4-a716-446655440000", "+5 and 12, 3"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts + kept)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in ps.pseudonymise(df, "k").collect()}
    for i, text in enumerate(texts):
        assert not any(v in got[i]["text"] for v in [*cards, *phones, "4111-1111-1111-1111"]), text
        assert re.sub(r"\d", "9", got[i]["text"]) == re.sub(r"\d", "9", text)
    assert [got[i]["__replaced"] for i in range(5)] == [1, 2, 1, 2, 2]
    assert [got[len(texts) + i]["text"] for i in range(len(kept))] == kept


def test_nothing_but_values_changes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.join(ps.pseudonymise(docs, "k").select("doc_id", F.col("text").alias("new"), "__replaced"), "doc_id").collect()
    every = re.compile("|".join(f"(?:{p})" for p in ps.PATTERNS.values() if "\\1" not in p) + r"|(?<![\d.,-])\d{13,19}(?!\d|[.,-]\d)", re.ASCII)
    for r in rows:
        assert (r["text"] == r["new"]) == (r["__replaced"] == 0)
        assert every.sub("#", r["text"]).count("#") == every.sub("#", r["new"]).count("#")


def test_it_runs_in_the_jvm(spark, sf):
    plan = ps.pseudonymise(spark.read.parquet(f"{sf}/documents.parquet"), "k")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_columns_survive(spark):
    docs = spark.createDataFrame([(1, "call 555-123-4567", "a", "b", "c")], "doc_id bigint, text string, __hits string, __replaced string, `a.b` string")
    out = ps.pseudonymise(docs, "k")
    row = out.first()
    assert out.columns == [*docs.columns, "__replaced_"] and tuple(row[2:]) == ("a", "b", "c", 1) and row["text"] != "call 555-123-4567"
