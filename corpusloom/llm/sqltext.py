"""DuckDB text of the consistent form and of the queries that SQL can express, for the side-by-side checks.

Differences that do not show in the tables: look-alike letters are always read as Latin in tokens that also hold
Latin letters (no vocabulary), and presentation letters drawn apart get no half-space.
"""

from __future__ import annotations

from corpusloom.llm import forms, lookalikes
from corpusloom.llm.forms import VOWELS, ZWJ, ZWNJ

W = r"\p{L}\p{N}"
MARKS = forms.MARKS.pattern[1:-1]


def _translate(x: str, table: dict[int, str | None]) -> str:
    """Single characters by translate, the few longer forms by replace."""
    one = {k: v for k, v in table.items() if v is not None and len(v) == 1}
    gone = [k for k, v in table.items() if not v]
    quoted = lambda t: t.replace("'", "''")
    out = f"translate({x}, '{quoted(''.join(map(chr, [*one, *gone])))}', '{quoted(''.join(one.values()))}')"
    for k, v in table.items():
        if v and len(v) > 1:
            out = f"replace({out}, '{chr(k)}', '{v}')"
    return out


def plain_form(x: str) -> str:
    """Without half-space and look-alike rules."""
    first, second, _ = forms.tables()
    few = {k: v for k, v in first.items() if not v or len(v) == 1 or k == 0x2026 or 0xFEF5 <= k <= 0xFEFC}
    y = f"nfc_normalize({_translate(x, few)})"
    return rf"regexp_replace({_translate(y, second)}, '([اوی])[ٕٔ]', '\1', 'g')"


def _joining() -> tuple[str, str]:
    arabic = [chr(c) for c in range(0x620, 0x6D6)]
    return "".join(c for c in arabic if forms.joins_after(c)), "".join(c for c in arabic if forms.joins_before(c))


def latin(x: str) -> str:
    src, dst = "", ""
    for alphabet in (lookalikes.CYRILLIC, lookalikes.GREEK):
        for a, b in zip(alphabet, lookalikes.LATIN, strict=True):
            if a != "." and a not in src:
                src, dst = src + a, dst + b
    for a, b in lookalikes.EXTRA.items():
        if a not in src:
            src, dst = src + a, dst + b
    return f"CASE WHEN regexp_matches({x}, '[\\p{{Greek}}\\p{{Cyrillic}}]') AND regexp_matches({x}, '[a-zA-Z]') THEN translate({x}, '{src}', '{dst}') ELSE {x} END"


def form(x: str) -> str:
    """The whole consistent form of an expression."""
    dual, joined = _joining()
    y = f"regexp_replace({plain_form(x)}, '[{ZWNJ}{ZWJ}]+', '{ZWNJ}', 'g')"
    y = rf"regexp_replace({y}, '{ZWNJ}([^{joined}]|$)', '\1', 'g')"
    y = rf"regexp_replace({y}, '(^|[^{dual}{MARKS}])([{MARKS}]*){ZWNJ}', '\1\2', 'g')"
    return f"trim({latin(y)}, ' ' || chr(10))"


def letters(x: str) -> str:
    return f"regexp_replace(lower(regexp_replace({x}, '[{VOWELS}\\p{{Cf}}]', '', 'g')), '[^{W}]', '', 'g')"


def words(x: str) -> str:
    """A list of the words of a text."""
    return f"list_filter(regexp_split_to_array(lower(regexp_replace({x}, '[{VOWELS}\\p{{Cf}}]', '', 'g')), '[^{W}]+'), lambda w: w <> '')"


_SETS = "SELECT DISTINCT {cols}, unnest({words}) AS w FROM (SELECT DISTINCT {cols}, cleaned_text FROM {tab} WHERE cleaned_text IS NOT NULL)"


def _sets(name: str, tab: str, cols: str) -> str:
    return f"{name} AS ({_SETS.format(cols=cols, words=words('cleaned_text'), tab=tab)}), {name}n AS (SELECT id, count(DISTINCT w) AS n FROM {name} GROUP BY 1 HAVING count(DISTINCT w) >= 8)"


def _raw_letters() -> str:
    """(tab, id, k): letters and digits of the texts of raw_clips and train_clips."""
    return f"""SELECT tab, id, {letters('f')} AS k FROM (SELECT 'raw_clips' AS tab, id, {form('text_raw')} AS f FROM raw_clips UNION ALL SELECT 'train_clips', id, {form('cleaned_text')} FROM train_clips)"""


def p2() -> str:
    return f"""WITH t AS (SELECT DISTINCT id, text_raw FROM raw_clips WHERE text_raw IS NOT NULL), f AS (SELECT id, text_raw, {form('text_raw')} AS f FROM t), g AS (SELECT * FROM f WHERE length({letters('f')}) >= 15)
        SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM g a JOIN g b ON a.f = b.f AND a.id < b.id AND a.text_raw <> b.text_raw"""


def p3() -> str:
    return f"""WITH {_sets('v', 'val_clips', 'id')}, {_sets('t', 'train_clips', 'id')}, c AS (SELECT v.id AS x, t.id AS y, count(*) AS k FROM v JOIN vn USING (id) JOIN t ON t.w = v.w JOIN tn ON tn.id = t.id GROUP BY 1, 2),
        p AS (SELECT x, y FROM c JOIN vn ON vn.id = x JOIN tn ON tn.id = y WHERE k * 5 >= (vn.n + tn.n - k) * 3 UNION SELECT v.id, t.id FROM val_clips v JOIN train_clips t ON t.id = v.id)
        SELECT DISTINCT s.split, s.source, least(x, y) AS id_a, greatest(x, y) AS id_b FROM p JOIN val_clips s ON s.id = p.x"""


def p4() -> str:
    return f"""WITH {_sets('t', 'train_clips', 'id')}, l AS (SELECT t.* FROM t JOIN tn USING (id)), c AS (SELECT a.id AS x, b.id AS y, count(*) AS k FROM l a JOIN l b ON a.w = b.w AND a.id < b.id GROUP BY 1, 2)
        SELECT x AS id_a, y AS id_b FROM c JOIN tn a ON a.id = x JOIN tn b ON b.id = y WHERE k * 5 >= (a.n + b.n - k) * 3"""


def p5() -> str:
    return f"""WITH RECURSIVE r AS (SELECT id, speaker_id, recording_id, cleaned_text FROM train_clips UNION ALL SELECT id, speaker_id, recording_id, cleaned_text FROM val_clips),
        t AS (SELECT id, {letters(form('cleaned_text'))} AS k FROM r WHERE cleaned_text IS NOT NULL),
        keys AS (SELECT id, 's' || speaker_id AS k FROM r WHERE trim(speaker_id) NOT IN ('', 'unknown') UNION SELECT id, 'r' || recording_id FROM r WHERE recording_id IS NOT NULL UNION SELECT id, 't' || k FROM t WHERE length(k) >= 15),
        e AS (SELECT DISTINCT id AS a, min(id) OVER (PARTITION BY k) AS b FROM keys), edges AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
        cc(id, comp) USING KEY (id) AS (SELECT DISTINCT a, a FROM edges UNION (SELECT u.id, min(v.comp) FROM recurring.cc u JOIN edges ON edges.a = u.id JOIN cc v ON v.id = edges.b WHERE v.comp < u.comp GROUP BY u.id))
        SELECT id, comp AS group_id FROM cc"""


def p6() -> str:
    value = f"""CASE json_type(j, '$."' || x || '"') WHEN 'NULL' THEN 'n' WHEN 'VARCHAR' THEN 's' || {letters(form('''json_extract_string(j, '$."' || x || '"')'''))} ELSE 'd' || CAST(CAST(json_extract_string(j, '$."' || x || '"') AS DOUBLE) AS VARCHAR) END"""
    return f"""WITH t AS ({_raw_letters()}), m AS (SELECT line_id AS id, CAST(payload AS JSON) AS j FROM manifest_lines WHERE json_valid(payload)),
        u AS (SELECT id, j, unnest(json_keys(j)) AS x FROM m), v AS (SELECT id, string_agg(lower(x) || '=' || {value}, '|' ORDER BY lower(x)) AS k FROM u GROUP BY 1),
        a AS (SELECT tab, id, k FROM t WHERE length(k) >= 15 UNION SELECT 'manifest_lines', id, k FROM v), g AS (SELECT tab, id, min(id) OVER (PARTITION BY tab, k) AS keep_id FROM a)
        SELECT DISTINCT tab, keep_id, id AS copy_id FROM g WHERE keep_id < id"""


def p7() -> str:
    def runs(name: str, key: str, tab: str) -> str:
        w = f"list_transform({words(plain_form('text'))}, lambda t: {latin('t')})"
        return f"{name}w AS (SELECT {key}, {w} AS w FROM {tab} WHERE text IS NOT NULL), {name} AS (SELECT DISTINCT {key}, array_to_string(w[i:i + 11], ' ') AS run FROM (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS i FROM {name}w))"

    return f"WITH {runs('d', 'doc_id', 'documents')}, {runs('i', 'item_id', 'heldout_items')} SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (run)"


def _forms() -> str:
    return f"t AS (SELECT id, text_raw FROM raw_clips WHERE text_raw IS NOT NULL), f AS (SELECT id, text_raw, {form('text_raw')} AS f FROM t)"


def p2_report() -> str:
    return f"WITH {_forms()} SELECT count(*) AS n_texts, count(DISTINCT text_raw) AS n_stored, count(DISTINCT f) AS n_forms, count(*) FILTER (f <> text_raw) AS n_changed FROM f"


def p2_classes() -> str:
    return f"""WITH {_forms()}, g AS (SELECT DISTINCT * FROM f WHERE length({letters('f')}) >= 15), c AS (SELECT f, min(id) AS class_id, count(*) AS n FROM g GROUP BY 1 HAVING count(DISTINCT text_raw) > 1),
        a AS (SELECT f, text_raw, count(*) AS alike FROM g GROUP BY 1, 2) SELECT id, class_id, sum(n - alike)::BIGINT AS n_links FROM g JOIN c USING (f) JOIN a USING (f, text_raw) GROUP BY 1, 2"""


def p3_report() -> str:
    return f"""WITH {_sets('v', 'val_clips', 'id')}, {_sets('t', 'train_clips', 'id')}, c AS (SELECT v.id AS x, t.id AS y, count(*) AS k FROM v JOIN vn USING (id) JOIN t ON t.w = v.w JOIN tn ON tn.id = t.id GROUP BY 1, 2),
        p AS (SELECT x, y FROM c JOIN vn ON vn.id = x JOIN tn ON tn.id = y WHERE k * 5 >= (vn.n + tn.n - k) * 3 UNION SELECT v.id, t.id FROM val_clips v JOIN train_clips t ON t.id = v.id),
        q AS (SELECT DISTINCT s.split, s.source, x, y FROM p JOIN val_clips s ON s.id = p.x)
        SELECT split, source, count(DISTINCT x) AS n_held, count(DISTINCT y) AS n_train, count(*) AS n_pairs, count(*) FILTER (x = y) AS n_same_id FROM q GROUP BY 1, 2"""


def p3_classes() -> str:
    return f"""WITH {_sets('v', 'val_clips', 'id')}, {_sets('t', 'train_clips', 'id')}, c AS (SELECT v.id AS x, t.id AS y, count(*) AS k FROM v JOIN vn USING (id) JOIN t ON t.w = v.w JOIN tn ON tn.id = t.id GROUP BY 1, 2),
        p AS (SELECT x, y FROM c JOIN vn ON vn.id = x JOIN tn ON tn.id = y WHERE k * 5 >= (vn.n + tn.n - k) * 3 UNION SELECT v.id, t.id FROM val_clips v JOIN train_clips t ON t.id = v.id),
        k AS (SELECT id, string_agg(w, ' ' ORDER BY w) AS k FROM v JOIN vn USING (id) GROUP BY 1), m AS (SELECT id, min(id) OVER (PARTITION BY k) AS class_id FROM k),
        q AS (SELECT DISTINCT s.split, s.source, x, y FROM p JOIN val_clips s ON s.id = p.x)
        SELECT split, source, x AS held_id, coalesce(any_value(class_id), x) AS class_id, count(DISTINCT y) AS n_links FROM q LEFT JOIN m ON m.id = x GROUP BY 1, 2, 3"""


def p4_groups() -> str:
    return f"""WITH RECURSIVE t AS (SELECT DISTINCT id, list_sort(list_distinct({words('cleaned_text')})) AS w FROM train_clips WHERE cleaned_text IS NOT NULL), l AS (SELECT * FROM t WHERE len(w) >= 8),
        cls AS (SELECT w, min(id) AS c FROM l GROUP BY 1), u AS (SELECT c, len(w) AS n, unnest(w) AS x FROM cls), h AS (SELECT a.c AS a, b.c AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM u a JOIN u b ON a.x = b.x AND a.c <> b.c GROUP BY 1, 2),
        e AS (SELECT a, b FROM h WHERE k * 5 >= (na + nb - k) * 3),
        cc(c, g) USING KEY (c) AS (SELECT c, c FROM cls UNION (SELECT u.c, min(v.g) FROM recurring.cc u JOIN e ON e.a = u.c JOIN cc v ON v.c = e.b WHERE v.g < u.g GROUP BY u.c))
        SELECT l.id, cls.c AS class_id, cc.g AS group_id, (SELECT count(*) FROM e WHERE e.a = cls.c) AS n_links FROM l JOIN cls USING (w) JOIN cc ON cc.c = cls.c"""


SQL = {
    "p2_found": p2(), "p2_form_report": p2_report(), "p2_classes": p2_classes(), "p3_found": p3(), "p3_overlap_report": p3_report(), "p3_classes": p3_classes(), "p4_found": p4(), "p4_groups": p4_groups(), "p5_found": p5(), "p6_found": p6(), "p7_found": p7(),
    "p6_copy_counts": f"SELECT tab, keep_id, count(*) AS n_copies FROM ({p6()}) GROUP BY 1, 2",
    "p7_leak_report": f"SELECT i.split, i.item_id, count(*) AS n_docs, min(doc_id) AS first_doc FROM ({p7()}) l JOIN heldout_items i USING (item_id) GROUP BY 1, 2",
}
