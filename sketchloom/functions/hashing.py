"""Hash primitives of the sketches: Murmur3 32-bit, golden-ratio unit hash, min-wise hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The constants of Murmur3 x86 32-bit, and of the unit hash.
C1, C2, MIX, ADD = 0xCC9E2D51, 0x1B873593, 0x85EBCA6B, 0xE6546B64
MIX2 = 0xC2B2AE35
GOLDEN = 1.6180339887498949025
MASK = 0xFFFFFFFF


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint32(r)) | (x >> np.uint32(32 - r))


def _scrambled(k: np.ndarray) -> np.ndarray:
    return _rotl(k * np.uint32(C1), 15) * np.uint32(C2)


def _finished(h: np.ndarray, n: int) -> np.ndarray:
    h = h ^ np.uint32(n)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(MIX)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(MIX2)
    return h ^ (h >> np.uint32(16))


def murmur3_array(column: pa.Array) -> pa.Array:
    """Murmur3 x86 32-bit, seed 0, of each string's UTF-8 bytes as a signed int; null stays null.

    Strings of equal length are hashed together, so the work is vector arithmetic whatever the strings are.
    """
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    starts, sizes = at[:-1], np.diff(at)
    out = np.zeros(len(column), np.uint32)
    order = np.argsort(sizes, kind="stable")
    lengths, firsts = np.unique(sizes[order], return_index=True)
    with np.errstate(over="ignore"):
        for n, rows in zip(lengths.tolist(), np.split(order, firsts[1:])):
            h = np.zeros(len(rows), np.uint32)
            base = starts[rows]
            for k in range(0, n - 3, 4):
                block = np.zeros(len(rows), np.uint32)
                for b in range(4):
                    block |= raw[base + k + b].astype(np.uint32) << np.uint32(8 * b)
                h = _rotl(h ^ _scrambled(block), 13) * np.uint32(5) + np.uint32(ADD)
            if n % 4:
                tail = np.zeros(len(rows), np.uint32)
                for b in range(n % 4):
                    tail |= raw[base + n - n % 4 + b].astype(np.uint32) << np.uint32(8 * b)
                h = h ^ _scrambled(tail)
            out[rows] = _finished(h, n)
    return pa.array(out.view(np.int32), mask=~valid)


def _hash_udf(column):
    return murmur3_array(column)


def murmur3(column: Column) -> Column:
    """Murmur3 of a string column, batch by batch in Arrow."""
    return F.arrow_udf(_hash_udf, "int")(column)


def _hash_ints(*parts: pa.Array) -> pa.Array:
    valid = np.logical_and.reduce([p.is_valid().to_numpy(zero_copy_only=False) for p in parts])
    with np.errstate(over="ignore"):
        h = np.zeros(len(parts[0]), np.uint32)
        for p in parts:
            k = p.fill_null(0).cast(pa.int32()).to_numpy().view(np.uint32)
            h = _rotl(h ^ _scrambled(k), 13) * np.uint32(5) + np.uint32(ADD)
        return pa.array(_finished(h, 4 * len(parts)).view(np.int32), mask=~valid)


def _hash_tuple_udf(a, b):
    return _hash_ints(a, b)


def hash_int_tuple(a: Column, b: Column) -> Column:
    """Murmur3 32-bit, seed 0, over two little-endian ints, batch by batch in Arrow.

    As column arithmetic each step would name the one before twice, and the expression would grow past what the
    JVM compiles.
    """
    return F.arrow_udf(_hash_tuple_udf, "int")(a.cast("int"), b.cast("int"))


def unit_hash(h: Column) -> Column:
    """Golden-ratio hash of an int onto [0, 1)."""
    x = (h.cast("double") + F.lit(1.0)) * F.lit(GOLDEN)
    return x - F.floor(x)


def minwise_coefficients(n: int, seed: int = 1947) -> list[int]:
    return np.random.default_rng(seed).integers(1, 2**31 - 1, n).tolist()


def minwise(hashes: Column, n: int, seed: int = 1947) -> Column:
    """Array of n structs (min_hash, position): the smallest of (a*x + b) mod 2147483587 over an int array.

    a and b of each function are the same number, drawn once for each function from a seeded generator.
    """
    coefficients = minwise_coefficients(n, seed)

    def one(c: int) -> Column:
        values = F.transform(
            hashes,
            lambda x, i: F.struct(F.pmod(x.cast("decimal(20,0)") * c + c, F.lit(2147483587)).cast("long").alias("min_hash"), i.alias("position")),
        )
        return F.array_min(values)

    return F.array(*[one(c) for c in coefficients])


# The same in DuckDB's SQL, for the counterparts of queries.


def murmur3_sql(expr: str) -> str:
    """DuckDB expression: Murmur3 of a string as a signed integer."""
    x = f"hex(encode({expr}))"

    def scrambled(k: str) -> str:
        return f"((({rot_sql(f'((({k}) * {C1}) & {MASK})', 15)}) * {C2}) & {MASK})"

    def byte(at: str) -> str:
        return f"substr(hx, {at}, 2)"

    def block(i: str) -> str:
        return "('0x' || " + " || ".join(byte(f"8 * {i} + {7 - 2 * b}") for b in range(4)) + ")::UBIGINT"

    step = f"(({rot_sql(f'xor(h, {scrambled(chr(107))})', 13)}) * 5 + {ADD}) & {MASK}"
    body = f"list_reduce([{block('i')} FOR i IN range(0, nb // 4)], lambda h, k: {step}, 0::UBIGINT)"
    tail = "('0x' || " + " || ".join(f"(CASE WHEN nb % 4 > {b} THEN substr(hx, 8 * (nb // 4) + {2 * b + 1}, 2) ELSE '' END)" for b in (2, 1, 0)) + ")::UBIGINT"
    mixed = f"xor(CASE WHEN nb % 4 = 0 THEN h0 ELSE xor(h0, {scrambled(tail)}) END, nb::UBIGINT)"
    return (
        "(SELECT CASE WHEN h3 >= 2147483648 THEN h3::BIGINT - 4294967296 ELSE h3::BIGINT END FROM ("
        "SELECT xor(h2, h2 >> 16) AS h3 FROM ("
        f"SELECT (xor(h1, h1 >> 13) * {MIX2}) & {MASK} AS h2 FROM ("
        f"SELECT (xor(hm, hm >> 16) * {MIX}) & {MASK} AS h1 FROM ("
        f"SELECT {mixed} AS hm FROM (SELECT hx, nb, {body} AS h0 FROM (SELECT {x} AS hx, length({x}) // 2 AS nb))))))) "
    )


def rot_sql(a: str, r: int) -> str:
    return f"(((({a}) << {r}) | (({a}) >> {32 - r})) & {MASK})"


def hash_int_tuple_sql(a: str, b: str) -> str:
    """DuckDB expression: Murmur3 of two ints as a signed integer."""
    h = "0::UBIGINT"
    for part in (a, b):
        u = f"((({part})::BIGINT + 4294967296) % 4294967296)::UBIGINT"
        k = f"((({rot_sql(f'(({u} * {C1}) & {MASK})', 15)}) * {C2}) & {MASK})"
        h = f"((({rot_sql(f'xor({h}, {k})', 13)}) * 5 + {ADD}) & {MASK})"
    return (
        "(SELECT CASE WHEN h3 >= 2147483648 THEN h3::BIGINT - 4294967296 ELSE h3::BIGINT END FROM ("
        "SELECT xor(h2, h2 >> 16) AS h3 FROM ("
        f"SELECT (xor(h1, h1 >> 13) * {MIX2}) & {MASK} AS h2 FROM ("
        f"SELECT (xor(h0, h0 >> 16) * {MIX}) & {MASK} AS h1 FROM (SELECT xor({h}, 8::UBIGINT) AS h0))))) "
    )


def unit_hash_sql(h: str) -> str:
    x = f"((({h})::DOUBLE + 1.0::DOUBLE) * 1.6180339887498949::DOUBLE)"
    return f"({x} - floor({x}))"
