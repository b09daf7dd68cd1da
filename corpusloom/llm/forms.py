"""One consistent character form for text that looks the same (problem 2), in plain Python per text.

``shape`` covers everything that can be decided from the text alone; look-alike letters of another script need
the corpus vocabulary and are repaired by :mod:`corpusloom.llm.lookalikes`. Tables come from the Unicode data
of the running Python by rule.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# The project's letter map.
LETTER_MAP = {"ي": "ی", "ك": "ک", "ة": "ه", "أ": "ا", "إ": "ا", "ٱ": "ا", "ؤ": "و", "ئ": "ی", "ى": "ی"}
# Arabic-Indic digits drawn exactly like the extended (Persian) ones; 4, 5 and 6 are drawn differently.
DIGIT_MAP = {"٠": "۰", "١": "۱", "٢": "۲", "٣": "۳", "٧": "۷", "٨": "۸", "٩": "۹"}
# The vowel marks of the project's definition of letters and digits.
VOWELS = "ً-ْٰ"
ZWNJ, ZWJ, AE, HEH = "‌", "‍", "ە", "ه"
#: Letters that join to the letter before them but never to the one after.
RIGHT_JOINING = set("آأؤإاةدذرزوٱڈڑژۀەۓ")
NON_JOINING = {"ء"}
#: Compatibility kinds whose members are drawn like their plain letters.
PLAIN_KINDS = ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>")


def _compat(c: str) -> str | None:
    d = unicodedata.decomposition(c)
    if not d.startswith(PLAIN_KINDS):
        return None
    return unicodedata.normalize("NFKC", c)


@lru_cache(maxsize=1)
def tables() -> tuple[dict[int, str | None], dict[int, str], dict[int, str]]:
    """(compatibility and invisible characters, letter and digit map, drawn form of presentation letters)."""
    first: dict[int, str | None] = {0x2026: "...", 0x09: " ", 0x0B: "\n", 0x0C: "\n", 0x85: "\n", 0x2028: "\n", 0x2029: "\n"}
    forms: dict[int, str] = {}
    for cp in range(0x80, 0x10000):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind == "Cf" and c not in (ZWNJ, ZWJ) and not 0x600 <= cp <= 0x605 and cp not in (0x6DD, 0x70F, 0x8E2):
            first[cp] = None
        elif kind == "Zs":
            first[cp] = " "
        elif (plain := _compat(c)) is not None and not plain.startswith(" "):
            first[cp] = plain
            if 0xFB50 <= cp <= 0xFEFC:
                forms[cp] = unicodedata.decomposition(c).split(">")[0][1:]
    for cp in [*range(0x180B, 0x180E), *range(0xFE00, 0xFE10), 0x034F, 0x17B4, 0x17B5]:
        first[cp] = None
    second = {ord(a): b for a, b in (LETTER_MAP | DIGIT_MAP).items()}
    second[ord(AE)] = HEH + ZWNJ
    return first, second, forms


def joins_before(c: str) -> bool:
    """Whether the Arabic letter joins to the letter before it."""
    return "ؠ" <= c <= "ە" and unicodedata.category(c) in ("Lo", "Lm") and c not in NON_JOINING


def joins_after(c: str) -> bool:
    return joins_before(c) and c not in RIGHT_JOINING


#: Text that needs none of the work below.
PLAIN = re.compile(r"[ \n!-~«»،؛؟ءآا-بت-غفقل-وً-ْٰپچژکگی۰-۹à-öø-ÿ]*")
TWO_VOWELS = re.compile(f"[{VOWELS}]{{2}}")  # their order may vary
PRESENTATION = re.compile("[ﭐ-﷿ﹰ-ﻼ]")
HAMZA = re.compile("([اوی])[ٕٔ]")
MARKS = re.compile("[̀-ͯؐ-ًؚ-ٰٟۖ-ۜ۟-۪ۤۧۨ-ۭ]")
JOINERS = re.compile(f"[{ZWNJ}{ZWJ}]+")


def _kept_joiner(m: re.Match) -> str:
    """A half-space stays only where it parts two letters that would join, a joiner only where it changes a shape."""
    s = m.string
    a, b = m.start() - 1, m.end()
    while a >= 0 and MARKS.match(s[a]):
        a -= 1
    while b < len(s) and (MARKS.match(s[b]) or s[b] in (ZWNJ, ZWJ)):
        b += 1
    before, after = a >= 0 and joins_after(s[a]), b < len(s) and joins_before(s[b])
    if ZWNJ in m.group():
        return ZWNJ if before and after else ""
    return ZWJ if before != after else ""


def _drawn(s: str, first: dict, forms: dict[int, str]) -> str:
    """Presentation letters to plain ones; letters drawn apart in them stay apart."""
    out: list[str] = []
    last = ""
    for c in s:
        form = forms.get(ord(c), "")
        if last in ("final", "isolated") and form in ("initial", "isolated"):
            out.append(ZWNJ)
        out.append(first.get(ord(c), c) or "")
        last = form
    return "".join(out)


def shape(text: str | None) -> str | None:
    """The consistent form without look-alike repair: two texts drawn alike give equal strings.

    Null gives null; blank text gives "". Case, vowel marks, the width of inner gaps, line breaks, visible
    half-spaces and punctuation are kept; invisible characters and outer blanks go.
    """
    if text is None:
        return None
    if PLAIN.fullmatch(text) and not TWO_VOWELS.search(text):
        return text.strip(" \n")
    first, second, forms = tables()
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = _drawn(text, first, forms) if PRESENTATION.search(text) else text.translate(first)
    text = unicodedata.normalize("NFC", text).translate(second)
    if "ٔ" in text or "ٕ" in text:
        text = HAMZA.sub(r"\1", text).replace(HEH + "ٔ", "ۀ")
    return JOINERS.sub(_kept_joiner, text).strip(" \n")


DROPPED = re.compile(f"[{VOWELS}­؜᠎​-‏‪-‮⁠-⁤⁦-⁯﻿]")
NOT_WORD = re.compile(r"[\W_]+")


def letters(form: str) -> str:
    """Letters and digits of a consistent form: lower case, nothing else."""
    return NOT_WORD.sub("", DROPPED.sub("", form).lower())


def words(form: str) -> list[str]:
    """Words of a text: vowel marks and zero-width characters dropped, lower case, split at all other characters."""
    return [w for w in NOT_WORD.split(DROPPED.sub("", form).lower()) if w]
