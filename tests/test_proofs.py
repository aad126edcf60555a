"""Digests, identifiers and proofs against the standard library and by hand."""

import hashlib
import hmac

import pytest
from lodestrand.operators import proofs
from lodestrand.sources import legacy
from pyspark.sql import functions as F


@pytest.mark.parametrize("key", [b"k", b"x" * 64, b"y" * 100])
def test_hmac(spark, key):
    got = spark.createDataFrame([("m",), ("",), ("\u00e9t\u00e9" * 50,)], "t string").select("t", proofs.hmac_sha256(key, F.col("t")).alias("h")).collect()
    assert all(r["h"] == hmac.new(key, r["t"].encode(), hashlib.sha256).hexdigest() for r in got)


def test_base58():
    for data in (b"", b"\0", b"\0\0a", b"hello", bytes(range(40))):
        assert proofs.from_base58(proofs.base58(data)) == data
    assert proofs.base58(b"Hello World!") == "2NEpo7TZRRrLZSi2U"


def test_identifiers_refuse_what_they_are_not(spark):
    df = spark.createDataFrame([(bytes(32),), (b"short",), (None,)], "k binary")
    made = [r[0] for r in df.select(proofs.key_identifier("k")).collect()]
    assert made[0].startswith("did:key:z6Mk") and made[1:] == [None, None]
    odd = spark.createDataFrame([(made[0],), ("did:key:z0OIl",), ("did:web:x",), (None,)], "d string")
    assert [r[0] for r in odd.select(proofs.identified_key("d")).collect()] == ["00" * 32, None, None, None]


def test_sealed_sums_and_proofs(spark):
    df = spark.createDataFrame([(k, k % 2, k * k) for k in range(200)], "id bigint, g bigint, v bigint").repartition(5)
    want = {g: sum(k * k for k in range(200) if k % 2 == g) for g in (0, 1)}
    assert {r["g"]: r["total"] for r in proofs.sealed_sum(df, "g", "id", "v", "s").collect()} == want
    made = proofs.knowledge_proofs(df, "id", "v", "s")
    assert all(r["valid"] for r in proofs.proofs_hold(made).collect())
    wrong = proofs.proofs_hold(made.withColumn("response", (F.col("response") + 1) % proofs.Q))
    assert not any(r["valid"] for r in wrong.collect())


def test_sealed_sums_of_nulls_large_numbers_and_tasks_without_rows(spark):
    rows = [(1, "a", 2**50), (2, "a", None), (3, "b", None), (4, "c", -7), (5, "c", 3), (6, None, 5)]
    df = spark.createDataFrame(rows, "id bigint, g string, v bigint").repartition(16)
    assert {r["g"]: r["total"] for r in proofs.sealed_sum(df, "g", "id", "v", "s").collect()} == {"a": 2**50, "b": None, "c": -4, None: 5}


def test_older_layouts():
    rows = [("TEXT", b"one"), ("EMBD", b""), ("IMAG", b"x" * 1000)]
    data = legacy.encode(rows)
    assert (legacy.OLD_FILE.size, legacy.OLD_BLOCK.size, legacy.RUN_HEADER) == (144, 80, 72)
    assert [(r["block_type"], r["data"]) for r in legacy.decode(data)] == rows
    bare = data[:80] + bytes(32) + data[112:]
    assert legacy.OLD_FILE.read(data)["checksum"] == hashlib.sha256(bare).digest()
    assert [r.get("error") is not None for r in legacy.decode(data[: legacy.OLD_FILE.size + 90])] == [True] * 3
    run = legacy.encode_run(rows)
    assert [(r["block_type"], r["data"]) for r in legacy.decode_run(b"\x01\x02" + run + b"tail")] == rows
    spoilt = run[:4] + b"????" + run[8:]
    assert [r["data"] for r in legacy.decode_run(spoilt)] == [b"", b"x" * 1000]
