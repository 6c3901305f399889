"""Small builders for the DuckDB texts."""

from __future__ import annotations


def R(expr: str, digits: int = 6) -> str:
    """Rounded double without negative zero."""
    return f"(round(cast({expr} as double),{digits})+0.0::double)"


def SAT(expr: str) -> str:
    """Half-even rounding clamped to the uint8 range."""
    return f"cast(least(255,greatest(0,round_even({expr},0))) as int)"


def U(seed: str, *keys: str) -> str:
    """Uniform number from 40 bits of an md5 digest."""
    text = "concat_ws(':','" + seed + "'," + ",".join(f"cast({k} as varchar)" for k in keys) + ")"
    return f"(cast(concat('0x',substring(md5({text}),1,10)) as bigint)/1099511627776e0)"
