"""CRC-32 in DuckDB's SQL, which has no function for it."""

from __future__ import annotations

#: CTEs up to crc32_table (one row, a list of 256 numbers): a byte's remainder, eight shifts by the reflected polynomial.
CRC32 = ", ".join([
    "crc32_0 AS (SELECT i, i AS c FROM range(256) AS r(i))",
    *[f"crc32_{k + 1} AS (SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM crc32_{k})" for k in range(8)],
    "crc32_table AS (SELECT list(c ORDER BY i) AS remainders FROM crc32_8)"])


def crc32(numbers: str) -> str:
    """The unsigned CRC-32 of a list of bytes, where crc32_table is joined."""
    return f"xor(list_reduce(list_concat([4294967295], {numbers}), lambda a, x: xor(a >> 8, remainders[(xor(a, x) & 255) + 1])), 4294967295)"
