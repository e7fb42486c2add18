"""DuckDB fragments shared by the SQL counterparts."""

from __future__ import annotations

# One row with the 256 remainders of the reflected CRC-32 polynomial.
CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(
    [n, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END)) AS t)"""


def crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes; needs ``crc_table`` in the FROM clause."""
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    step = "lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {data}), {step}), 4294967295::BIGINT)"
