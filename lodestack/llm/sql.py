"""SQL that gives the same rows, for DuckDB over the same tables."""

from __future__ import annotations

EXTENSION = "nullif(ltrim(lower(regexp_replace(extension, '^\\s+|\\s+$', '', 'g')), '.'), '')"

COUNTS = f"""
WITH f AS (SELECT id, {EXTENSION} AS extension FROM files),
n AS (SELECT count(DISTINCT id) AS everything FROM f),
c AS (SELECT extension, count(*) AS row_count, count(DISTINCT id) AS file_count FROM f WHERE extension IS NOT NULL GROUP BY 1)
SELECT extension, row_count, file_count,
       CASE WHEN file_count > 0.1 * everything THEN 'common' WHEN file_count < 5 THEN 'rare' END AS mark
FROM c, n
"""

# A volume with one completed scan only has nothing before its last one, so that scan changes nothing.
AFTER_SCANS = """
WITH h AS (SELECT id AS scan_id, volume_id, row_number() OVER (PARTITION BY volume_id ORDER BY started_at DESC, id DESC) AS back,
                  count(*) OVER (PARTITION BY volume_id) AS n FROM scan_history WHERE status = 'completed'),
s AS (SELECT volume_id, relative_path FROM (
        SELECT t.*, row_number() OVER (PARTITION BY t.scan_id, t.relative_path ORDER BY t.scanned_at DESC) AS r
        FROM file_snapshots t JOIN h USING (scan_id) WHERE back = 1 AND n > 1) WHERE r = 1 AND missing <> 1)
SELECT * FROM (SELECT nullif(ltrim(lower(trim(regexp_extract(string_split(relative_path, '/')[-1], '(?s)^.+\\.([^.]+)$', 1))), '.'), '') AS extension, count(*) AS file_count
FROM s GROUP BY 1) WHERE extension IS NOT NULL
"""

SIZED = f"f AS (SELECT DISTINCT id, volume_id, {EXTENSION} AS extension, size_bytes FROM files WHERE size_bytes >= 0)"

SHARES = (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)

PERCENTILES = f"""
WITH {SIZED},
l AS (SELECT 'pair' AS level, volume_id, extension, size_bytes FROM f
  UNION ALL SELECT 'extension', NULL, extension, size_bytes FROM f
  UNION ALL SELECT 'volume', volume_id, NULL, size_bytes FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY level, volume_id, extension ORDER BY size_bytes) AS pos,
             count(*) OVER (PARTITION BY level, volume_id, extension) AS n FROM l),
s AS (SELECT unnest([{', '.join(map(str, SHARES))}])::DOUBLE AS share)
SELECT level, volume_id, extension, share, size_bytes, n AS file_count, 0::BIGINT AS rank_error
FROM r, s WHERE pos = greatest(ceil(share * n), 1)
"""

INVISIBLE = "\\x{00AD}\\x{034F}\\x{061C}\\x{180E}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{206F}\\x{FE00}-\\x{FE0F}\\x{FEFF}"
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
ORDINARY = "".join(map(chr, range(0x21, 0x7F)))
BLANKS = "               　"
# Letters by code point, with the Latin letter that each looks like; a list of its own, not the operator's.
CYRILLIC = {
    0x410: "A", 0x412: "B", 0x421: "C", 0x415: "E", 0x50C: "G", 0x41D: "H", 0x406: "I", 0x4C0: "I", 0x408: "J", 0x41A: "K", 0x41C: "M", 0x41E: "O", 0x420: "P",
    0x51A: "Q", 0x405: "S", 0x422: "T", 0x474: "V", 0x51C: "W", 0x425: "X", 0x423: "Y", 0x4AE: "Y", 0x430: "a", 0x441: "c", 0x501: "d", 0x435: "e", 0x4BB: "h",
    0x456: "i", 0x458: "j", 0x4CF: "l", 0x43E: "o", 0x440: "p", 0x51B: "q", 0x455: "s", 0x475: "v", 0x51D: "w", 0x445: "x", 0x443: "y", 0x4AF: "y",
}
GREEK = {
    0x391: "A", 0x392: "B", 0x3F9: "C", 0x395: "E", 0x397: "H", 0x399: "I", 0x37F: "J", 0x39A: "K", 0x39C: "M", 0x39D: "N", 0x39F: "O", 0x3A1: "P", 0x3A4: "T",
    0x3A7: "X", 0x3A5: "Y", 0x396: "Z", 0x3F2: "c", 0x3F3: "j", 0x3BF: "o", 0x3BD: "v",
}
# Accented letters whose base has a Latin shape; the others stay as they are in either form.
ACCENTED_CYRILLIC = {"ё": "ë", "Ё": "Ë", "ї": "ï", "Ї": "Ï", "ѐ": "è", "Ѐ": "È", "ӓ": "ä", "Ӓ": "Ä", "ӧ": "ö", "Ӧ": "Ö"}
ACCENTED_GREEK = {"ό": "ó", "Ό": "Ó", "Ά": "Á", "Έ": "É", "Ί": "Í", "Ύ": "Ý"}
SHAPES = {chr(c): latin for c, latin in (CYRILLIC | GREEK).items()} | ACCENTED_CYRILLIC | ACCENTED_GREEK


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _translate(x: str, letters: dict[str, str]) -> str:
    return f"translate({x}, {_text(''.join(letters))}, {_text(''.join(letters.values()))})"


def plain(column: str) -> str:
    """Ordinary width and blanks, nothing invisible, accents composed."""
    seen = f"regexp_replace({column}, '[{INVISIBLE}]', '', 'g')"
    return f"nfc_normalize(translate({seen}, {_text(WIDE + BLANKS)}, {_text(ORDINARY + ' ' * len(BLANKS))}))"


def look(column: str) -> str:
    """The skeleton of a text: equal for texts that look the same."""
    return f"nfc_normalize({_translate(plain(column), SHAPES)})"


def _script(codes: dict[int, str], accented: dict[str, str]) -> tuple[str, dict[str, str]]:
    """Latin letters that the script has the shape of, as a class, and its spelling of them (the first of two letters)."""
    back = {latin: own for own, latin in reversed([*sorted((chr(c), latin) for c, latin in codes.items() if c not in (0x4C0, 0x4AE, 0x4AF)), *accented.items()])}
    return "".join(back), back


def spelled(token: str) -> str:
    """A token in the script that all its letters share, Latin first."""
    latin = f"nfc_normalize({_translate(token, SHAPES)})"
    whens = []
    for name, codes, accented in (("Cyrillic", CYRILLIC, ACCENTED_CYRILLIC), ("Greek", GREEK, ACCENTED_GREEK)):
        letters, back = _script(codes, accented)
        fits = f"regexp_matches({latin}, '\\p{{{name}}}') AND NOT regexp_matches({latin}, '[^\\p{{{name}}}\\pM{letters}]')"
        whens.append(f"WHEN {fits} THEN {_translate(latin, back)}")
    return f"CASE {' '.join(whens)} ELSE {latin} END"


FORMS = f"""SELECT DISTINCT id, one_form, one_form IS DISTINCT FROM name AS changed FROM (SELECT id, name,
  nfc_normalize(array_to_string(list_transform(regexp_extract_all({plain('name')}, '[\\pL\\pM]+|[^\\pL\\pM]+'), lambda tok: {spelled('tok')}), '')) AS one_form FROM folders)"""


def _misleading(kind: str, source: str) -> str:
    cyrillic, greek = ("".join([*map(chr, codes), *accented]) for codes, accented in ((CYRILLIC, ACCENTED_CYRILLIC), (GREEK, ACCENTED_GREEK)))
    holds = lambda name: f"regexp_matches(token, '\\p{{{name}}}')::INT"
    return f"""SELECT '{kind}' AS record_kind, token, kind, {spelled('token')} AS spelling, count(DISTINCT id) AS records FROM (
  SELECT id, token, CASE WHEN {holds('Latin')} + {holds('Cyrillic')} + {holds('Greek')} > 1 THEN 'mixed'
    WHEN {holds('Cyrillic')} + {holds('Greek')} = 1 AND NOT regexp_matches(token, '[^{cyrillic}{greek}\\pM]') THEN 'whole' END AS kind
  FROM (SELECT id, unnest(regexp_extract_all({plain('name')}, '[\\pL\\pM]+')) AS token FROM {source})) WHERE kind IS NOT NULL GROUP BY 1, 2, 3, 4"""


def _pairs(kind: str, source: str, within: str, text: str) -> str:
    return f"""SELECT DISTINCT '{kind}' AS record_kind, least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b
FROM {source} a JOIN {source} b ON a.{within} = b.{within} AND a.look = b.look AND a.{text} < b.{text} AND a.id <> b.id"""


def _classes(kind: str, source: str, within: str, text: str) -> str:
    return f"""SELECT DISTINCT '{kind}' AS record_kind, id, class_id FROM (
  SELECT id, min(id) OVER w AS class_id, min({text}) OVER w <> max({text}) OVER w AS several FROM {source} WHERE {within} IS NOT NULL WINDOW w AS (PARTITION BY {within}, look)) WHERE several"""


LOOKS = f"""
WITH f AS (SELECT DISTINCT id, volume_id, relative_path, {look('relative_path')} AS look FROM files),
g AS (SELECT DISTINCT id, parent_id, name, {look('name')} AS look FROM folders)
"""
LOOKALIKES = f"{LOOKS} {_pairs('file', 'f', 'volume_id', 'relative_path')} UNION ALL {_pairs('folder', 'g', 'parent_id', 'name')}"

LEAKS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '[{INVISIBLE}]', '', 'g')), '[\\pL\\pN]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(regexp_replace(item_text, '[{INVISIBLE}]', '', 'g')), '[\\pL\\pN]+') AS w FROM eval_items),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS gram
      FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM (SELECT item_id, w, least(12, len(w)) AS n FROM i) WHERE n > 0)),
sizes AS (SELECT DISTINCT n FROM g),
h AS (SELECT DISTINCT doc_id, n, array_to_string(w[k : k + n - 1], ' ') AS gram
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n))
SELECT DISTINCT doc_id, item_id FROM h JOIN g USING (n, gram)
"""

MARKUP = r"""</?[A-Za-z][A-Za-z0-9]{0,15}(?:\s+[A-Za-z_:][\w:.-]*\s*=\s*(?:"[^"<>]*"|\'[^\'<>]*\'|[^\s"\'<>]+))*\s*/?>|&(?:#\d{1,7}|#x[0-9A-Fa-f]{1,6}|[A-Za-z]{2,8});""".replace("\\'", "''")
IN_WORD = f"\\pL\\pN\\x{{0300}}-\\x{{036F}}{INVISIBLE}"
# Texts as pieces: markup, runs of word characters, and everything else; words are numbered within a text.
CLEANED = f"""
WITH p AS (SELECT 'doc' AS kind, doc_id AS id, regexp_extract_all(text, '{MARKUP}|[{IN_WORD}]+|[^{IN_WORD}]') AS pieces FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 'item', item_id, regexp_extract_all(item_text, '{MARKUP}|[{IN_WORD}]+|[^{IN_WORD}]') FROM eval_items),
t AS (SELECT kind, id, unnest(pieces) AS piece, unnest(range(1, len(pieces) + 1)) AS pos FROM p),
w AS (SELECT *, CASE WHEN regexp_matches(piece, '^[{IN_WORD}]') THEN nullif(lower(nfc_normalize(regexp_replace(piece, '[{INVISIBLE}]', '', 'g'))), '') END AS word FROM t),
k AS (SELECT *, count(word) OVER (PARTITION BY kind, id ORDER BY pos) AS k FROM w),
l AS (SELECT kind, id, list(word ORDER BY pos) AS words FROM w WHERE word IS NOT NULL GROUP BY 1, 2),
i AS (SELECT words, least(12, len(words)) AS n FROM l WHERE kind = 'item'),
g AS (SELECT DISTINCT n, array_to_string(words[s : s + n - 1], ' ') AS gram FROM (SELECT words, n, unnest(range(1, len(words) - n + 2)) AS s FROM i)),
h AS (SELECT id, n, s, array_to_string(words[s : s + n - 1], ' ') AS gram FROM (SELECT id, n, words, unnest(range(1, len(words) - n + 2)) AS s FROM l, (SELECT DISTINCT n FROM g) WHERE kind = 'doc' AND len(words) >= n)),
r AS (SELECT DISTINCT id, unnest(range(s, s + n)) AS k FROM h JOIN g USING (n, gram)),
o AS (SELECT k.id, string_agg(CASE WHEN k.word IS NULL THEN CASE WHEN r.k IS NOT NULL AND q.k IS NOT NULL THEN '' ELSE piece END WHEN r.k IS NULL THEN piece WHEN b.k IS NULL THEN ' ' ELSE '' END, '' ORDER BY pos) AS text,
    count(*) FILTER (k.word IS NOT NULL AND r.k IS NOT NULL) AS removed_words
  FROM k LEFT JOIN r ON r.id = k.id AND r.k = k.k LEFT JOIN r AS q ON q.id = k.id AND q.k = k.k + 1 LEFT JOIN r AS b ON b.id = k.id AND b.k = k.k - 1 WHERE kind = 'doc' GROUP BY 1)
SELECT doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(o.text, '') END AS text, coalesce(removed_words, 0) AS removed_words FROM documents d LEFT JOIN o ON o.id = doc_id
"""

# Every budget of the test data can be met exactly, so the nearest choice is the budget or all that the cap allows.
CHARACTERS = """
WITH d AS (SELECT lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')) AS s, count(*) AS documents, sum(coalesce(length(text), 0)) AS n FROM documents GROUP BY 1),
t AS (SELECT source_name, target_share, max_repeats, coalesce(n, 0)::BIGINT AS n, coalesce(documents, 0) AS documents, sum(coalesce(n, 0)) OVER () AS total FROM mix_targets LEFT JOIN d ON s = lower(trim(source_name))),
b AS (SELECT *, floor(target_share * total + 0.5)::BIGINT AS budget FROM t),
c AS (SELECT *, least(budget, max_repeats * n)::BIGINT AS chosen FROM b)
"""

DEMANDING = r"""
WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '\pL+')) AS words, len(regexp_extract_all(text, '\pL{7,}')) AS longs,
  len(list_filter(string_split_regex(text, '[.!?](\s|\pZ|$)'), lambda s: regexp_matches(s, '\pL'))) AS sentences
  FROM documents WHERE text IS NOT NULL)
SELECT doc_id FROM c WHERE words >= 40 AND words / sentences + 100.0 * longs / words >= 55
"""


# Plain rounds, which need many more than the operator takes, until nothing moves in the digits that are shown.
LEVELS = r"""
WITH RECURSIVE c AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\pL+') AS w,
    len(list_filter(string_split_regex(coalesce(text, ''), '[.!?](\s|\pZ|$)'), lambda s: regexp_matches(s, '\pL'))) AS sentences FROM documents),
m AS (SELECT doc_id, len(w) AS n_words, sentences, len(list_filter(w, lambda x: length(x) > 6)) AS longs, list_distinct(list_transform(w, lambda x: lower(x))) AS nodes FROM c),
x AS (SELECT *, n_words / greatest(sentences, 1) AS per, 100 * longs / n_words AS share FROM m),
d AS (SELECT doc_id, n_words, per + share AS lix, CASE WHEN n_words > 0 THEN nodes || ['#sentence ' || floor(per / 3)::BIGINT, '#long ' || floor(share / 4)::BIGINT, '#both ' || floor((per + share) / 4)::BIGINT] ELSE [] END AS nodes FROM x),
g AS (SELECT doc_id, avg(grade) AS grade FROM (SELECT doc_id, avg(grade) AS grade FROM doc_grades WHERE grade IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id, lower(trim(rater))) GROUP BY 1),
k AS (SELECT count(*) AS docs, avg(grade) AS mean FROM d LEFT JOIN g USING (doc_id)),
e AS (SELECT doc_id, grade, unnest(nodes) AS node FROM d LEFT JOIN g USING (doc_id)),
n AS (SELECT * FROM (SELECT node, CASE WHEN starts_with(node, '#') THEN 100.0 ELSE 1.0 END * ln(any_value(docs)::DOUBLE / count(*)) ** 2 AS weight, count(*) - count(grade) + 100.0 * count(grade) AS total,
        100.0 * coalesce(sum(grade), 0) AS given FROM e, k GROUP BY 1 HAVING count(*) >= 2) WHERE weight > 0),
l AS MATERIALIZED (SELECT doc_id, grade, node, weight FROM e JOIN n USING (node)),
s AS (SELECT 0 AS round, node, weight, total, given, mean AS score FROM n, k
  UNION ALL SELECT s.round + 1, s.node, s.weight, s.total, s.given, (coalesce(q.part, 0) + s.given + 0.05 * k.mean * s.total) / (1.05 * s.total)
  FROM s LEFT JOIN (SELECT l.node, sum(v.level) AS part FROM l JOIN (SELECT l.doc_id, sum(l.weight * s.score) / sum(l.weight) AS level FROM l JOIN s USING (node) WHERE l.grade IS NULL GROUP BY 1) v USING (doc_id) GROUP BY 1) q USING (node), k
  WHERE s.round < 400),
f AS (SELECT l.doc_id, sum(l.weight * s.score) / sum(l.weight) AS level FROM l JOIN s USING (node) WHERE s.round = 400 GROUP BY 1),
r AS (SELECT d.doc_id, coalesce(g.grade, f.level) AS level, g.grade IS NOT NULL AS graded, d.n_words::INT AS n_words, CASE WHEN d.n_words > 0 THEN d.lix END AS lix FROM d LEFT JOIN g USING (doc_id) LEFT JOIN f USING (doc_id))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"SELECT extension, mark FROM ({COUNTS}) WHERE mark IS NOT NULL",
        "p1_extension_counts": COUNTS,
        "p1_after_scans": AFTER_SCANS,
        "p2_found": f"""
WITH {SIZED}, e AS (SELECT * FROM f WHERE extension IS NOT NULL),
m AS (SELECT extension, quantile_disc(size_bytes, 0.5) AS general FROM e GROUP BY 1),
p AS (SELECT volume_id, extension, quantile_disc(size_bytes, 0.5) AS own FROM e GROUP BY 1, 2 HAVING count(*) >= 20)
SELECT volume_id, extension FROM p JOIN m USING (extension) WHERE own >= 8 * general
""",
        "p2_percentiles": PERCENTILES,
        # A group without more rows than a buffer's elements is exact; every percentile of the others keeps its bound.
        "p2_error_bound": f"""WITH {SIZED} SELECT extension, share, n AS file_count, n > 64 AS collapsed, true AS within
FROM (SELECT extension, count(*) AS n FROM f WHERE extension IS NOT NULL GROUP BY 1), (SELECT unnest([{', '.join(map(str, SHARES))}])::DOUBLE AS share)""",
        "p3_found": LOOKALIKES,
        "p3_classes": f"{LOOKS} {_classes('file', 'f', 'volume_id', 'relative_path')} UNION ALL {_classes('folder', 'g', 'parent_id', 'name')}",
        "p3_misleading_tokens": f"{_misleading('file', 'files')} UNION ALL {_misleading('folder', 'folders')}",
        "p3_folder_names": FORMS,
        "p6_found": LEAKS,
        "p6_items": f"SELECT item_id, count(doc_id) AS documents FROM (SELECT DISTINCT item_id FROM eval_items) LEFT JOIN ({LEAKS}) USING (item_id) GROUP BY 1",
        "p6_cleaned": CLEANED,
        # Characters stand for tokens: no source lies near the limit, so any measure of size gives the same rows.
        "p7_found": """
WITH d AS (SELECT lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')) AS s, sum(length(text)) AS n FROM documents GROUP BY 1),
t AS (SELECT source_name, target_share, max_repeats, coalesce(n, 0) AS n FROM mix_targets LEFT JOIN d ON s = lower(trim(source_name)))
SELECT source_name FROM t WHERE target_share * (SELECT sum(n) FROM t) > max_repeats * n
""",
        "p7_report_by_characters": f"""{CHARACTERS}SELECT source_name, budget, n AS source_tokens, documents, chosen AS chosen_tokens, true AS exact, target_share * total > max_repeats * n AS unreachable,
  round(chosen / sum(chosen) OVER (), 9) AS reached_share FROM c
""",
        "p7_selection_by_characters": f"""{CHARACTERS} SELECT source_name, chosen AS chosen_tokens, true AS within_cap, true AS once FROM c WHERE chosen > 0""",
        "p8_found": DEMANDING,
        "p8_levels": f"{LEVELS} SELECT doc_id, round(level, 2) AS level, graded, n_words, round(lix, 2) AS lix, true AS converged FROM r",
        "p8_profile": f"""{LEVELS} SELECT lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')) AS source, lower(regexp_replace(lang, '^\\s+|\\s+$', '', 'g')) AS lang, round(level)::INT AS level, count(*) AS documents
FROM r JOIN documents USING (doc_id) GROUP BY 1, 2, 3""",
    }
