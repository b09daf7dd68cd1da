"""Script-aware repair of look-alike letters (problem 2).

A token with letters of more than one of the Latin, Greek and Cyrillic scripts is mixed. Its dominant script is
the one of most of its letters. The letters of the other scripts are replaced by their look-alikes of the
dominant script, then, where that is no known word, of each other script; a replacement counts only when it is
wholly in one script and exists in the corpus vocabulary: among the corpus's unmixed tokens (case apart), or as
the result of at least two differently stored mixed tokens. All else stays as it is.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import forms
from corpusloom.llm.arrow import with_columns

# Letters of the three scripts that are drawn alike, Latin / Cyrillic / Greek; a dot where there is none.
LATIN = "aceijopsxyvhABCEHIJKMNOPSTXYZ"
CYRILLIC = "асеіјорѕхуѵһАВСЕНІЈКМ.ОРЅТХУ."
GREEK = "α....ο....ν.ΑΒ.ΕΗΙ.ΚΜΝΟΡ.ΤΧΥΖ"
# Further single look-alikes to Latin.
EXTRA = {"υ": "u", "ι": "i", "ρ": "p", "κ": "k", "χ": "x", "γ": "y", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ґ": "r", "ϲ": "c", "ϳ": "j"}

# Letters of the other scripts that carry marks, by rule: the look-alike of their base with the same marks, if that is one letter.
_BASES = {b: a for alphabet in (GREEK, CYRILLIC) for a, b in zip(LATIN, alphabet, strict=True) if b != "."} | EXTRA
for _c in map(chr, [*range(0x370, 0x530), *range(0x1F00, 0x2000)]):
    _base, *_marks = unicodedata.normalize("NFD", _c)
    if _marks and _base in _BASES and len(_whole := unicodedata.normalize("NFC", _BASES[_base] + "".join(_marks))) == 1:
        EXTRA.setdefault(unicodedata.normalize("NFC", _c), _whole)

SCRIPTS = {"Latin": LATIN, "Cyrillic": CYRILLIC, "Greek": GREEK}
TOKEN = r"[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}\p{Mn}]+"
#: A letter of the three scripts; what is most frequent elsewhere is passed over first.
LETTER = r"[[^\x{0}-@\x{600}-\x{6FF}]&&[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}]]"
#: A token as it may be stored: with invisible characters inside.
STORED = LETTER + r"[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}\p{Mn}\p{Cf}]*"
#: A text that may hold mixed tokens.
OTHER = r"[[^\x{0}-\x{24F}\x{600}-\x{6FF}]&&[\p{IsCyrillic}\p{IsGreek}]]"
MIXED = r"\p{IsLatin}\p{Mn}*[\p{IsCyrillic}\p{IsGreek}]|\p{IsCyrillic}\p{Mn}*[\p{IsLatin}\p{IsGreek}]|\p{IsGreek}\p{Mn}*[\p{IsLatin}\p{IsCyrillic}]"


def _to(script: str, token: Column) -> Column:
    src, dst = "", ""
    for other, alphabet in SCRIPTS.items():
        if other != script:
            for a, b in zip(alphabet, SCRIPTS[script], strict=True):
                if a != "." and b != "." and a not in src:
                    src, dst = src + a, dst + b
    if script == "Latin":
        for a, b in EXTRA.items():
            if a not in src:
                src, dst = src + a, dst + b
    return F.translate(token, src, dst)


def _count(script: str, token: Column) -> Column:
    return F.length(F.regexp_replace(token, rf"[^\p{{Is{script}}}]", ""))


def repairs(mixed: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, repaired) for the column ``token`` of mixed tokens; ``vocabulary`` has the column ``word``, lower case.

    Tokens without a valid replacement have no row. Of several valid scripts the one with most letters in the
    token wins, ties by the order Latin, Cyrillic, Greek.
    """
    options = F.array(*[F.struct(_count(s, F.col("token")).alias("n"), F.lit(-k).alias("k"), _to(s, F.col("token")).alias("to"), F.lit(s).alias("script")) for k, s in enumerate(SCRIPTS)])
    whole = F.expr(" OR ".join(f"(o.script = '{s}' AND o.to RLIKE '^[\\\\p{{Is{s}}}\\\\p{{Mn}}]+$')" for s in SCRIPTS))
    found = mixed.filter(F.col("token").isNotNull()).select("token").distinct().select("token", F.explode(options).alias("o")).filter(whole).select("token", "o", F.lower("o.to").alias("word"))
    twice = found.groupBy("word").agg(F.countDistinct("token").alias("spellings")).filter("spellings > 1").select("word")
    known = vocabulary.select("word").join(found.select("word").distinct(), "word", "left_semi").unionByName(twice).distinct()
    return found.join(known, "word", "left_semi").groupBy("token").agg(F.max_by("o.to", F.struct("o.n", "o.k")).alias("repaired"))


def latin_words(df: DataFrame, text: str) -> DataFrame:
    """(word): distinct lower-case unmixed tokens of the three scripts in the column ``text``."""
    tokens = F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(TOKEN), F.lit(0))).alias("word")
    has = F.col(text).rlike(r"[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}]")
    return df.filter(has).select(tokens).distinct().filter(~F.col("word").rlike(MIXED))


def shaped_words(df: DataFrame, text: str) -> DataFrame:
    """(word): what :func:`latin_words` gives for the shaped texts. Only the distinct tokens are shaped."""
    stored = df.select(F.explode(F.regexp_extract_all(text, F.lit(f"({STORED})"), F.lit(1))).alias("stored")).distinct()
    return latin_words(with_columns(stored, {"shaped": ("string", lambda v: [forms.shape(x) for x in v])}, "stored", drop=("stored",)), "shaped")


def repair(df: DataFrame, text: str, vocabulary: DataFrame) -> DataFrame:
    """``df`` with look-alikes of the mixed tokens in the column ``text`` repaired.

    Only rows with a mixed token are shuffled, by their text; the others pass. Nulls stay null. Row number, order
    of columns and all other columns are kept.
    """
    is_mixed = F.coalesce(F.col(text).rlike(MIXED), F.lit(False))
    rest, mixed = df.filter(~is_mixed), df.filter(is_mixed)
    texts = mixed.select(F.col(text).alias("__text")).distinct()
    per_token = texts.select("__text", F.explode(F.array_distinct(F.regexp_extract_all("__text", F.lit(TOKEN), F.lit(0)))).alias("token")).filter(F.col("token").rlike(MIXED))
    found = repairs(per_token, vocabulary)
    fixes = per_token.join(found, "token").groupBy("__text").agg(F.map_from_entries(F.collect_list(F.struct("token", "repaired"))).alias("__fix"))
    pieces = F.regexp_extract_all("__text", F.lit(rf"{TOKEN}|[^\p{{IsLatin}}\p{{IsCyrillic}}\p{{IsGreek}}\p{{Mn}}]+"), F.lit(0))
    fixed = fixes.select("__text", F.array_join(F.transform(pieces, lambda x: F.coalesce(F.try_element_at("__fix", x), x)), "").alias("__fixed"))
    done = mixed.withColumn("__text", F.col(text)).join(fixed, "__text", "left").withColumn(text, F.coalesce("__fixed", text)).select(*df.columns)
    return rest.unionByName(done)


# --- the same repair for one text against a given, bounded vocabulary ---
_TABLES = {s: str.maketrans({b: a for o, alphabet in SCRIPTS.items() if o != s for a, b in zip(SCRIPTS[s], alphabet, strict=True) if a != "." and b != "."} | (EXTRA if s == "Latin" else {})) for s in SCRIPTS}
_WORD = re.compile(r"[^\W\d_]+(?:[̀-ͯ][^\W\d_]*)*")
_OTHER = re.compile(r"[Ͱ-ԯ]")


def repair_text(text: str, vocabulary: frozenset[str] | set[str]) -> str:
    """``text``, in the consistent form, with each token that holds Greek or Cyrillic letters replaced by its Latin,
    Cyrillic or Greek reading where that is in ``vocabulary`` (lower case)."""

    def one(m: re.Match) -> str:
        token = m.group()
        if not _OTHER.search(token):
            return token
        for table in _TABLES.values():
            if (to := token.translate(table)) != token and to.lower() in vocabulary:
                return to
        return token

    return _WORD.sub(one, text) if _OTHER.search(text) else text
