"""Optional decoding of percent- or base64-encoded text before detection."""

from .core import let, lit


def decode_sql(text: str) -> str:
    """Percent-decoded text if that changes it; else base64-decoded if it is valid; else the text.

    A plus sign stays a plus sign and a stray percent sign stays as it is. Bytes that are not
    valid UTF-8 after percent-decoding leave the text undecoded.
    """
    guarded = f"replace(regexp_replace(de_t, {lit('%(?![0-9A-Fa-f]{2})')}, '%25'), '+', '%2B')"
    opened = f"coalesce(try_url_decode({guarded}), de_t)"
    looks = f"de_s rlike {lit('^[A-Za-z0-9+/=]+$')} and length(de_s) >= 8 and length(de_s) % 4 = 0"
    raw = "try_validate_utf8(cast(try_to_binary(de_s, 'base64') as string))"
    binary = let("de_s", f"regexp_replace(de_t, {lit('(?U)^' + chr(92) + 's+|' + chr(92) + 's+$')}, '')",
                 f"case when {looks} then coalesce({raw}, de_t) else de_t end")
    return let("de_t", text, let("de_u", opened, f"case when de_u <> de_t then de_u else {binary} end"))
