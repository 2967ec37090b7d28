"""Pieces of DuckDB SQL that several corpus queries share."""

from __future__ import annotations

#: A table of one row: tab, the 256 remainders of the CRC-32 polynomial, made by its rule.
CRC_TABLE = """crc_table AS (SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS tab
  FROM (SELECT unnest(range(256)) AS n))"""


def crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII string of at least one character, where ``tab`` of ``CRC_TABLE`` is joined in."""
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"
