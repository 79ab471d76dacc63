"""CRC-32 as a DuckDB expression, for SQL twins."""

from __future__ import annotations

POLYNOMIAL = 0xEDB88320


def _step(value: int, bits: int = 4) -> int:
    for _ in range(bits):
        value = value >> 1 ^ (POLYNOMIAL if value & 1 else 0)
    return value


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of a SQL string, four bits at a time, low ones of a byte first."""
    digits = f"hex(encode({text}))"
    place = "xor(k, 1) + 1"
    halves = f"list_transform(range(length({digits})), lambda k: instr('0123456789ABCDEF', substr({digits}, {place}, 1)) - 1)"
    table = [_step(i) for i in range(16)]
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {halves}), lambda c, x: xor(c >> 4, list_extract({table}, xor(c, x) % 16 + 1))), 4294967295::bigint)"
