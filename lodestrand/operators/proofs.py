"""Keyed digests, commitments, identifiers of keys, sums of sealed numbers and proofs of knowledge.

The number-theoretic ones show what such protocols compute; their parameters are small and not fit to keep secrets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# The base58 alphabet, and the prefix of Ed25519 public keys in key identifiers.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
ED25519 = bytes([0xED, 0x01])

#: A safe prime's group of squares: P = 2 Q + 1, with a generator of the subgroup of order Q.
P, Q, G = 2039, 1019, 4
#: Two primes whose product, the modulus of the additive encryption, is above 2**64, so that any bigint sum can be opened.
PAILLIER = (4294967311, 4294967357)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 as SHA-256 expressions: the key is known when the plan is made, so its pads are literals."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in block)) for x in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer, first), 256)


def commit(value: Column, nonce: Column) -> Column:
    return F.sha2(F.concat(F.encode(value, "UTF-8"), F.encode(nonce, "UTF-8")), 256)


def base58(data: bytes) -> str:
    number, out = int.from_bytes(data), ""
    while number:
        number, digit = divmod(number, 58)
        out = BASE58[digit] + out
    return "1" * (len(data) - len(data.lstrip(b"\0"))) + out


def from_base58(text: str) -> bytes:
    number = 0
    for c in text:
        number = number * 58 + BASE58.index(c)
    zeros = len(text) - len(text.lstrip("1"))
    return bytes(zeros) + number.to_bytes((number.bit_length() + 7) // 8)


@pandas_udf(StringType())
def key_identifier(key: pd.Series) -> pd.Series:
    """The identifier of a 32-byte public key."""
    return key.map(lambda k: f"did:key:z{base58(ED25519 + bytes(k))}" if k is not None and len(k) == 32 else None)


@pandas_udf(StringType())
def identified_key(identifier: pd.Series) -> pd.Series:
    """The public key of an identifier, in hex; null if it isn't one."""

    def read(did: str | None) -> str | None:
        if not did or not did.startswith("did:key:z") or any(c not in BASE58 for c in did[9:]):
            return None
        data = from_base58(did[9:])
        return data[2:].hex() if data[:2] == ED25519 and len(data) == 34 else None

    return identifier.map(read)


def _draw(*parts: object, below: int) -> int:
    return int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()) % below


def sealed_sum(rows: DataFrame, by: str, id_col: str, value_col: str, salt: str) -> DataFrame:
    """(by, total): each group's sum, found by multiplying sealed values and opening the product only; nulls as in SQL's sum.

    Products are taken within each task first, so a group's values are never gathered.
    """
    p, q = PAILLIER
    n, phi = p * q, (p - 1) * (q - 1)
    square = n * n

    def blind(i: object) -> int:
        r, again = _draw(salt, i, below=n - 2) + 2, 0
        while r % p == 0 or r % q == 0:  # it has no inverse, and no product that it is in can be opened
            again += 1
            r = _draw(salt, i, again, below=n - 2) + 2
        return pow(r, n, square)

    def seal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for g, i, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                product = held.setdefault(g, None)
                if v is not None:
                    held[g] = (1 if product is None else product) * (1 + n * int(v)) * blind(i) % square
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), kind), pa.array([None if x is None else str(x) for x in held.values()], pa.string())], [by, "sealed"])

    def opened(pdf: pd.DataFrame) -> pd.DataFrame:
        product = None
        for x in pdf["sealed"].dropna():
            product = (1 if product is None else product) * int(x) % square
        total = None if product is None else (pow(product, phi, square) - 1) // n * pow(phi, -1, n) % n
        total = total - n if total is not None and total > n // 2 else total
        return pd.DataFrame({by: pdf[by].iloc[:1], "total": pd.array([total], "Int64")})

    kind = rows.schema[by].dataType.simpleString()
    sealed = rows.select(by, F.col(id_col).alias("id"), F.col(value_col).cast("bigint").alias("value")).mapInArrow(seal, f"{by} {kind}, sealed string")
    return sealed.groupBy(by).applyInPandas(opened, f"{by} {kind}, total bigint")


def knowledge_proofs(rows: DataFrame, id_col: str, secret_col: str, salt: str) -> DataFrame:
    """(id, public, commitment, response): that each row's secret is known, without telling it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, s in zip(pdf["id"], pdf["secret"], strict=True):
                x, k = int(s) % Q, _draw(salt, i, s, below=Q)
                public, t = pow(G, x, P), pow(G, k, P)
                out.append((i, public, t, (k + _draw(public, t, i, below=Q) * x) % Q))
            yield pd.DataFrame(out, columns=["id", "public", "commitment", "response"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("id"), F.col(secret_col).alias("secret")).mapInPandas(run, f"id {kind}, public bigint, commitment bigint, response bigint")


def proofs_hold(proofs: DataFrame) -> DataFrame:
    """(id, valid) for each proof."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            valid = [pow(G, int(s), P) == int(t) * pow(int(y), _draw(y, t, i, below=Q), P) % P for i, y, t, s in zip(pdf["id"], pdf["public"], pdf["commitment"], pdf["response"], strict=True)]
            yield pd.DataFrame({"id": pdf["id"], "valid": valid})

    return proofs.mapInPandas(run, f"id {proofs.schema['id'].dataType.simpleString()}, valid boolean")
