"""Check-digit tests as native folds."""

from .core import let


def luhn_ok(value: str) -> str:
    """ISO/IEC 7812: double every second digit from the right; the digit sum ends in zero."""
    digits = f"filter(split(reverse(regexp_replace({value}, '[^0-9]', '')), ''), lu_c -> lu_c <> '')"
    weighted = f"transform({digits}, (lu_d, lu_i) -> cast(lu_d as int) * (1 + lu_i % 2))"
    return (f"(aggregate({weighted}, 0, (lu_a, lu_v) -> "
            f"lu_a + case when lu_v > 9 then lu_v - 9 else lu_v end) % 10 = 0)")


def mod97_ok(value: str) -> str:
    """ISO 13616: first four characters last, letters as 10..35, remainder one modulo 97."""
    turned = let("mo_c", f"upper(replace({value}, ' ', ''))",
                 "concat(substring(mo_c, 5), substring(mo_c, 1, 4))")
    codes = f"transform(filter(split({turned}, ''), mo_x -> mo_x <> ''), mo_y -> ascii(mo_y))"
    return (f"(aggregate({codes}, 0, (mo_a, mo_v) -> case when mo_v <= 57 "
            f"then (mo_a * 10 + mo_v - 48) % 97 else (mo_a * 100 + mo_v - 55) % 97 end) = 1)")


def checked(name: str, value: str) -> str:
    return f"case {name} when 'luhn' then {luhn_ok(value)} when 'mod97' then {mod97_ok(value)} else true end"
