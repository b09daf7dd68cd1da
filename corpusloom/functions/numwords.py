"""Persian number words as Column expressions and as SQL text, on digit strings of any script and length.

The number is read in groups of three digits, so nothing is cast to an integer and nothing overflows. Leading
zeros vanish, an all-zero run is zero, a thousand is spelled with its leading one. Numbers of more than 21
digits are beyond the largest scale name and are left as they are.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words.
ZERO, AND = "صفر", " و "
ONES = ("", "یک", "دو", "سه", "چهار", "پنج", "شش", "هفت", "هشت", "نه")
TEENS = ("ده", "یازده", "دوازده", "سیزده", "چهارده", "پانزده", "شانزده", "هفده", "هجده", "نوزده")
TENS = ("", "", "بیست", "سی", "چهل", "پنجاه", "شصت", "هفتاد", "هشتاد", "نود")
HUNDREDS = ("", "صد", "دویست", "سیصد", "چهارصد", "پانصد", "ششصد", "هفتصد", "هشتصد", "نهصد")
SCALES = ("", " هزار", " میلیون", " میلیارد", " تریلیون", " کوادریلیون", " کوینتیلیون")
MOST = 3 * len(SCALES)
#: The zeros of other scripts, each followed by its nine other digits, by the Unicode data of the running Python.
ZEROS = tuple(c for c in range(0x80, 0x20000) if unicodedata.category(chr(c)) == "Nd" and unicodedata.digit(chr(c)) == 0)
FOREIGN = "".join(chr(z + d) for z in ZEROS for d in range(10))
ASCII = "0123456789" * len(ZEROS)


def under_thousand(n: int) -> str:
    h, t, o = n // 100, n // 10 % 10, n % 10
    rest = [TEENS[o]] if t == 1 else [TENS[t], ONES[o]]
    return AND.join(x for x in (HUNDREDS[h], *rest) if x)


def spell(digits: str) -> str:
    """The same for one string, in Python."""
    digits = digits.translate(str.maketrans(FOREIGN, ASCII))
    n = digits.lstrip("0")
    if not n:
        return ZERO
    if len(n) > MOST or not n.isascii():
        return digits
    n = n.zfill(-(-len(n) // 3) * 3)
    groups = [int(n[i : i + 3]) for i in range(0, len(n), 3)]
    return AND.join(under_thousand(g) + SCALES[len(groups) - 1 - i] for i, g in enumerate(groups) if g)


def _table(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _at(values: tuple[str, ...], digit: Column) -> Column:
    return F.element_at(_table(values), digit.cast("int") + 1)


def _group(g: Column) -> Column:
    h, t, o = (F.substring(g, i, 1) for i in (1, 2, 3))
    parts = F.array(_at(HUNDREDS, h), F.when(t == "1", _at(TEENS, o)).otherwise(_at(TENS, t)), F.when(t == "1", "").otherwise(_at(ONES, o)))
    return F.array_join(F.filter(parts, lambda x: x != ""), AND)


def spelled_run(run: Column) -> Column:
    """A run of digits between spaces, in words."""
    ascii_ = F.translate(run, FOREIGN, ASCII)
    n = F.regexp_replace(ascii_, "^0+", "")
    size = F.ceil(F.length(n) / 3).cast("int")
    padded = F.lpad(n, size * 3, "0")
    groups = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(F.substring(padded, i * 3 + 1, F.lit(3)).alias("g"), _at(SCALES, size - 1 - i).alias("s")))
    named = F.array_join(F.transform(F.filter(groups, lambda x: x["g"] != "000"), lambda x: F.concat(_group(x["g"]), x["s"])), AND)
    return F.when(n == "", F.lit(f" {ZERO} ")).when((F.length(n) > MOST) | ~n.rlike("^[0-9]+$"), run).otherwise(F.concat(F.lit(" "), named, F.lit(" ")))


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def run_sql(run: str) -> str:
    """DuckDB text of :func:`spelled_run`."""
    n = f"regexp_replace(translate({run}, '{FOREIGN}', '{ASCII}'), '^0+', '')"
    size = f"CAST(ceil(length({n}) / 3.0) AS INT)"
    padded = f"lpad({n}, {size} * 3, '0')"
    at = lambda values, d: f"{_list(values)}[CAST({d} AS INT) + 1]"
    h, t, o = (f"substr(g, {i}, 1)" for i in (1, 2, 3))
    group = f"array_to_string(list_filter([{at(HUNDREDS, h)}, CASE WHEN {t} = '1' THEN {at(TEENS, o)} ELSE {at(TENS, t)} END, CASE WHEN {t} = '1' THEN '' ELSE {at(ONES, o)} END], lambda x: x <> ''), '{AND}')"
    groups = f"list_transform(range(0, {size}), lambda i: [substr({padded}, CAST(i AS INT) * 3 + 1, 3), {_list(SCALES)}[{size} - CAST(i AS INT)]])"
    named = f"array_to_string(list_transform(list_filter({groups}, lambda p: p[1] <> '000'), lambda p: list_transform([p[1]], lambda g: {group})[1] || p[2]), '{AND}')"
    return f"CASE WHEN {n} = '' THEN ' {ZERO} ' WHEN length({n}) > {MOST} OR NOT regexp_full_match({n}, '[0-9]+') THEN {run} ELSE ' ' || {named} || ' ' END"


def text_sql(text: str) -> str:
    """DuckDB text that spells all numbers of a text."""
    return f"CASE WHEN regexp_matches({text}, '\\p{{Nd}}') THEN array_to_string(list_transform(regexp_extract_all({text}, '(\\p{{Nd}}+|\\P{{Nd}}+)', 1), lambda r: CASE WHEN regexp_matches(r, '^\\p{{Nd}}') THEN {run_sql('r')} ELSE r END), '') ELSE {text} END"
