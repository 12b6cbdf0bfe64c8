"""Fragments of check SQL that round exactly, in whole numbers."""


def cents(x: str) -> str:
    """A decimal with two places as a whole number of hundredths."""
    return f"CAST(({x}) * 100 AS HUGEINT)"


def half_up(num: str, den: str, places: int) -> str:
    """num/den of whole numbers (den > 0), rounded half away from zero, as DOUBLE."""
    ten = 10**places
    return (
        f"(CAST(sign({num}) AS HUGEINT) * ((2 * abs({num}) * {ten} + ({den})) // (2 * ({den})))) / CAST({ten} AS DOUBLE)"
    )


def krw(x: str) -> str:
    """Money text without decimals; null counts as 0."""
    r = f"CAST(round(coalesce({x}, 0)) AS HUGEINT)"
    return f"CASE WHEN abs({r}) >= 1000000000000 THEN repeat('#', 16) ELSE format('{{:,}}', {r}) END"


def krw_half_up(num: str, den: str) -> str:
    """Money text of num/den, both whole numbers, rounded to units."""
    r = f"CAST(CAST(sign({num}) AS HUGEINT) * ((2 * abs({num}) + ({den})) // (2 * ({den}))) AS HUGEINT)"
    return f"CASE WHEN abs({r}) >= 1000000000000 THEN repeat('#', 16) ELSE format('{{:,}}', {r}) END"
