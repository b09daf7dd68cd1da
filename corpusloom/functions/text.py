"""Text functions as Column expressions. All give null for null unless stated; none needs Python on the executors.

Character classes are written so that Java and other engines agree on them: WORD is letters, digits and the
underscore, SPACE the 29 Unicode white-space characters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import numwords

WORD = r"\p{L}\p{N}_"
SPACE = r"\t-\r\x1c-\x20\x85\p{Z}"
DIGIT = r"\p{Nd}"
HALF_SPACE = "‌"
# Arabic letters and their Persian replacements, position by position.
ARABIC, PERSIAN = "يكةأإٱؤئى", "یکهاااویی"
# Vowel and Quranic marks of the base profile; vowel marks alone of the extended one.
MARKS, VOWELS = r"ً-ْٰۖ-ۭ", r"ً-ْٰ"
# Digits.
ASCII_DIGITS, PERSIAN_DIGITS, ARABIC_DIGITS = "0123456789", "۰۱۲۳۴۵۶۷۸۹", "٠١٢٣٤٥٦٧٨٩"
SHORT_CHARS, SHORT_WORDS = 15, 4


def null_safe(text: Column) -> Column:
    """Null becomes the empty text (PRJ1)."""
    return F.coalesce(text.cast("string"), F.lit(""))


def has_arabic(text: Column) -> Column:
    return text.rlike(f"[{ARABIC}]")


def to_persian(text: Column) -> Column:
    return F.translate(text, ARABIC, PERSIAN)


def has_marks(text: Column) -> Column:
    return text.rlike(f"[{MARKS}]")


def without_marks(text: Column) -> Column:
    return F.regexp_replace(text, f"[{MARKS}]", "")


def has_digits(text: Column) -> Column:
    return text.rlike(DIGIT)


def numbers_as_words(text: Column) -> Column:
    """Each run of digits becomes its number in words between spaces; runs beyond the largest scale stay as they are."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{Nd}+|\P{Nd}+)"), F.lit(1))
    spelled = F.array_join(F.transform(runs, lambda r: F.when(r.rlike(f"^{DIGIT}"), numwords.spelled_run(r)).otherwise(r)), "")
    return F.when(has_digits(text), spelled).otherwise(text)


def letters_only(text: Column) -> Column:
    """Neither punctuation nor spaces nor half-spaces."""
    return F.regexp_replace(text, f"[^{WORD}]", "")


def collapsed(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def fingerprint(normalized: Column) -> Column:
    return letters_only(without_marks(normalized))


def for_scoring(text: Column) -> Column:
    """The form that error rates are computed on: Persian letters, no marks, punctuation as spaces, half-spaces kept."""
    bare = F.regexp_replace(without_marks(to_persian(text)), rf"[^{WORD}{SPACE}\x{{200C}}]", " ")
    return collapsed(bare)


def char_count(text: Column) -> Column:
    return F.length(text)


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def is_short(text: Column) -> Column:
    return (char_count(text) < SHORT_CHARS) | (word_count(text) < SHORT_WORDS)


def audio_key(audio: str) -> Column:
    """md5 of the bytes, empty ones too; else the path unless it is empty; else one name for structs without either
    and one for null structs (a struct column ``audio`` of bytes and path)."""
    return F.coalesce(F.md5(F.col(f"{audio}.bytes")), F.nullif(F.col(f"{audio}.path"), F.lit("")), F.when(F.col(audio).isNotNull(), F.lit("{}")), F.lit("None"))


# --- the extended profile ---


def without_vowels(text: Column) -> Column:
    return F.regexp_replace(text, f"[{VOWELS}]", "")


def to_persian_digits(text: Column) -> Column:
    return F.translate(text, ARABIC + ASCII_DIGITS + ARABIC_DIGITS, PERSIAN + PERSIAN_DIGITS * 2)


def without_punctuation(text: Column) -> Column:
    return collapsed(F.regexp_replace(text, rf"[^{WORD}{SPACE}\x{{200C}}]", " "))


def without_spaces(text: Column) -> Column:
    """White space and half-spaces go, punctuation stays."""
    return F.regexp_replace(text, rf"[{SPACE}\x{{200C}}]", "")


@dataclass(frozen=True)
class Profile:
    """A normaliser: the base profile cleans labels, the extended one also strips vowels and punctuation."""

    extended: bool = False
    spell_numbers: bool = True
    collapse: bool = True

    def __call__(self, text: Column) -> Column:
        text = null_safe(text)
        if self.extended:
            text = to_persian_digits(without_vowels(text))
            text = numbers_as_words(text) if self.spell_numbers else text
            return without_punctuation(text)
        text = to_persian(text)
        text = numbers_as_words(text) if self.spell_numbers else text
        return collapsed(text) if self.collapse else text


# --- log text ---

# How a training log names its figures.
LOG_FIELDS = {
    "train_runtime": r"'train_runtime':\s*'?([\d.]+)'?",
    "eval_runtime": r"'eval_runtime':\s*'?([\d.]+)'?",
    "eval_wer": r"'eval_wer':\s*'?([\d.]+)'?",
    "eval_cer": r"'eval_cer':\s*'?([\d.]+)'?",
    "peak_vram": r"\[PEAK VRAM\]\s*([\d.]+)\s*GiB",
}
OUT_OF_MEMORY = "OutOfMemoryError"
NUMBER = r"([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)"


def number_after(log: Column, pattern: str) -> Column:
    """The first group of the first match as a number; null where there is none."""
    return F.nullif(F.regexp_extract(log, pattern, 1), F.lit("")).try_cast("double")


def last_lines(log: Column, n: int = 6, width: int = 160) -> Column:
    """The last ``n`` lines that are not blank, each cut to ``width`` characters."""
    lines = F.filter(F.split(log, r"\r\n|\n|\r"), lambda x: F.trim(x) != "")
    start = F.greatest(F.size(lines) - n, F.lit(0)) + 1
    return F.transform(F.slice(lines, start, F.lit(n)), lambda x: F.substring(x, 1, width))


def comma_list(text: Column, allowed: tuple[str, ...] | None = None) -> Column:
    """The trimmed parts between commas. With ``allowed`` any other part is an error when the row is read."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x))
    if allowed is None:
        return parts
    unknown = F.filter(parts, lambda x: ~x.isin(*allowed))
    return F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("unknown: "), F.array_join(unknown, ", ")))).otherwise(parts)
