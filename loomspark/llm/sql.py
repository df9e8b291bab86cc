"""What several operators' DuckDB SQL needs and DuckDB lacks."""


def _crc_steps() -> list[int]:
    """What four bits at the low end of a CRC-32 become."""
    out = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def crc32(text: str) -> str:
    """SQL of the CRC-32 of a text's UTF-8 bytes, as BIGINT: a fold over its bytes, half a byte at a time."""
    steps = f"CAST({_crc_steps()} AS BIGINT[])"
    half = lambda x: f"xor(({x}) >> 4, {steps}[CAST((({x}) & 15) + 1 AS INTEGER)])"
    data = f"list_transform(range(0, strlen({text})), lambda i: CAST('0x' || substr(hex({text}), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(list_reduce({data}, lambda c, b: {half(half('xor(c, b)'))}, CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"
