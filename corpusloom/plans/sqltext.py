"""DuckDB text of the functions in corpusloom.functions.text, for the side-by-side checks."""

from __future__ import annotations

from corpusloom.functions import numwords
from corpusloom.functions import text as T

W = r"\p{L}\p{N}_"
S = r"\t-\r\x1c-\x20\x85\p{Z}"


def rr(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def null_safe(x: str) -> str:
    return f"coalesce({x}, '')"


def to_persian(x: str) -> str:
    return f"translate({x}, '{T.ARABIC}', '{T.PERSIAN}')"


def without_marks(x: str) -> str:
    return rr(x, f"[{T.MARKS}]")


def collapsed(x: str) -> str:
    return f"trim({rr(x, f'[{S}]+', ' ')})"


def letters_only(x: str) -> str:
    return rr(x, f"[^{W}]")


def fingerprint(x: str) -> str:
    return letters_only(without_marks(x))


def for_scoring(x: str) -> str:
    return collapsed(rr(without_marks(to_persian(x)), rf"[^{W}{S}\x{{200C}}]", " "))


def normalized(x: str, collapse: bool = True) -> str:
    y = numwords.text_sql(to_persian(null_safe(x)))
    return collapsed(y) if collapse else y


def extended(x: str, spell: bool = True) -> str:
    y = f"translate({rr(null_safe(x), f'[{T.VOWELS}]')}, '{T.ARABIC + T.ASCII_DIGITS + T.ARABIC_DIGITS}', '{T.PERSIAN + T.PERSIAN_DIGITS * 2}')"
    return collapsed(rr(numwords.text_sql(y) if spell else y, rf"[^{W}{S}\x{{200C}}]", " "))


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{S}]+'), lambda w: w <> '')"


def word_count(x: str) -> str:
    return f"len({words(x)})"


def is_short(x: str) -> str:
    return f"(length({x}) < {T.SHORT_CHARS} OR {word_count(x)} < {T.SHORT_WORDS})"


def audio_key(a: str = "audio") -> str:
    return f"coalesce(md5({a}.bytes), nullif({a}.path, ''), CASE WHEN {a} IS NOT NULL THEN '{{}}' END, 'None')"


def le(h: str, at: int, size: int = 4) -> str:
    """Little-endian number of ``size`` bytes at a 1-based byte position of a hex text."""
    nibble = lambda k: f"(strpos('0123456789ABCDEF', substr({h}, CAST({k} AS INT), 1)) - 1)"
    byte = lambda i: f"({nibble(f'2 * ({at} + {i}) - 1')} * 16 + {nibble(f'2 * ({at} + {i})')})"
    return "(" + " + ".join(f"{byte(i)}::BIGINT * {256**i}" for i in range(size)) + ")"


def wav_plain(h: str) -> str:
    """Whether a hex text is a WAV of the common layout with channels and a rate."""
    return f"""coalesce(length({h}) >= 88 AND substr({h}, 1, 8) = '52494646' AND substr({h}, 17, 8) = '57415645' AND substr({h}, 25, 8) = '666D7420' AND substr({h}, 73, 8) = '64617461'
        AND substr({h}, 45, 4) <> '0000' AND {le(h, 25)} > 0 AND {le(h, 29)} > 0, false)"""


def wav_seconds(h: str) -> str:
    """Seconds by the header of the common layout; in the tables every other clip is corrupt."""
    return f"CASE WHEN {wav_plain(h)} THEN {le(h, 41)}::DOUBLE / {le(h, 29)} END"
