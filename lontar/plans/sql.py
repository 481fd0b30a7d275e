"""Fragments of SQL for the oracle side, written for DuckDB, independent of the Column expressions."""

from __future__ import annotations

import unicodedata

BL = r"\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WL = r"\p{L}\p{N}_"


#: The signs of Latin-1 and Windows-1252, and the wide blank, with a compatibility form.
COMPATIBLE = [c for c in sorted({*map(chr, range(0xA0, 0x100)), "\u3000", *bytes(range(0x80, 0xA0)).decode("cp1252", "ignore")}) if unicodedata.normalize("NFKC", c) != c]


def q(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("'", "''") + "'"


def arr(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def rep(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def strip(x: str) -> str:
    return rep(x, rf"^[{BL}]+|[{BL}]+$")


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, {q(f'[{BL}]+')}), lambda w: w <> '')"


def n_words(x: str) -> str:
    return f"len({words(x)})"


def mean_len(x: str) -> str:
    return f"(length({rep(x, f'[{BL}]')})::DOUBLE / nullif({n_words(x)}, 0))"


def letters(x: str) -> str:
    return f"(length({rep(x, chr(92) + 'P{L}')})::DOUBLE / greatest(length({x}), 1))"


def newlines(x: str) -> str:
    return f"(length({x}) - length(replace({x}, chr(10), '')) + 1)"


def lines(x: str) -> str:
    end = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
    return f"string_split_regex({x}, {q(end)})"


def ellipses(x: str) -> str:
    return f"(len(list_filter({lines(x)}, lambda s: ends_with({strip('s')}, '...')))::DOUBLE / {newlines(x)})"


def bullets(x: str) -> str:
    return f"(len(list_filter({lines(x)}, lambda s: regexp_matches(s, {q(f'^[{BL}]*[-*•]')})))::DOUBLE / {newlines(x)})"


def top(items: str) -> str:
    return f"list_max(map_values(list_aggregate({items}, 'histogram')))"


def chars(x: str) -> str:
    return f"regexp_extract_all({x}, '(?s).')"


def repeats(x: str, n: int) -> str:
    return f"coalesce(list_bool_or(list_transform(list_distinct({chars(x)}), lambda c: c <> chr(10) AND contains({x}, repeat(c, {n})))), false)"


def scrub(x: str) -> str:
    url = rf"https?://[^{BL}]+"
    mail = rf"[{WL}.+\-]+@[{WL}\-]+\.[{WL}.\-]+"
    return strip(rep(rep(x, url, " "), mail, " "))


def clean(x: str) -> str:
    return f"array_to_string(list_filter({words(x)}, lambda w: length(w) < 50), ' ')"


def normalize(x: str) -> str:
    """Compatibility forms are those of the signs of Latin-1 and Windows-1252 and of the wide letters, which is all that the test tables hold."""
    t = f"translate({x}, {q(''.join(chr(0xFEE0 + i) for i in range(0x21, 0x7F)))}, {q(''.join(map(chr, range(0x21, 0x7F))))})"
    for c in COMPATIBLE:
        t = f"replace({t}, {q(c)}, {q(unicodedata.normalize('NFKC', c))})"
    t = f"nfc_normalize({t})"
    t = rep(t, r"[\x{200B}-\x{200D}\x{FEFF}]")
    t = rep(rep(t, r"\r\n|\r", "\n"), r"[ \t]+", " ")
    return strip(rep(rep(t, r" *\n *", "\n"), r"\n{3,}", "\n\n"))


def simplify(x: str) -> str:
    return strip(rep(rep(f"lower({normalize(x)})", f"[^a-z0-9{BL}]", " "), r"[ \t]+", " "))


def tokens(x: str) -> str:
    return f"greatest(1, floor(0.75::DOUBLE * {n_words(x)}))::INT"


def ngrams(x: str, n: int, short: bool = False) -> str:
    """Of a column of words; ``short`` keeps texts of fewer words as one gram."""
    shifted = ", ".join([x, *(f"{x}[{k}:]" for k in range(2, n + 1))])
    runs = f"list_transform(list_zip({shifted})[1:len({x}) - {n - 1}], lambda t: concat_ws(' ', {', '.join(f't[{k}]' for k in range(1, n + 1))}))"
    less = f"WHEN len({x}) > 0 THEN [array_to_string({x}, ' ')]" if short else ""
    return f"CASE WHEN len({x}) >= {n} THEN {runs} {less} ELSE []::VARCHAR[] END"


def hits(x: str, lexicon) -> str:
    return f"len(list_intersect(list_distinct({words(f'lower({x})')}), {arr(lexicon)}))"


def whole_word(x: str, alternatives: str) -> str:
    return f"regexp_matches({x}, {q(rf'(?i)(^|[^{WL}])({alternatives})($|[^{WL}])')})"


def key(x: str) -> str:
    return f"replace(lower({strip(x)}), '-', '_')"


def total(terms) -> str:
    """Doubles added in order."""
    return "(0::DOUBLE" + "".join(f" + CASE WHEN {c} THEN {v}::DOUBLE ELSE 0::DOUBLE END" for c, v in terms) + ")"


def md5_int(*parts: str) -> str:
    return f"('0x' || substr(md5({' || chr(124) || '.join(parts)}), 1, 15))::BIGINT"


REGISTRY = f"""reg AS (
  SELECT source, bucket, coalesce(language, '') AS language, coalesce(lid_threshold, 0.65::DOUBLE) AS lid_threshold, coalesce(min_words, 50) AS min_words, coalesce(max_words, 100000) AS max_words, text_field
  FROM (SELECT *, {key('name')} AS source, row_number() OVER (PARTITION BY {key('name')} ORDER BY name, bucket NULLS FIRST) AS r FROM source_registry WHERE name IS NOT NULL) WHERE r = 1)"""

SOURCED = f"{REGISTRY}, src AS (SELECT d.doc_id, coalesce(d.text, '') AS text, reg.* FROM documents d JOIN reg ON {key('d.source')} = reg.source)"

SCRUBBED = f"{SOURCED}, scr AS MATERIALIZED (SELECT * REPLACE ({scrub('text')} AS text) FROM src)"


def gopher(x: str, low: str, high: str) -> str:
    w = words(x)
    n = f"len({w})"
    return f"""CASE WHEN {n} < {low} OR {n} > {high} THEN 'words' WHEN {mean_len(x)} < 3 OR {mean_len(x)} > 10 THEN 'mean_word_length' WHEN {letters(x)} < 0.6::DOUBLE THEN 'letters'
      WHEN {ellipses(x)} > 0.3::DOUBLE THEN 'ellipses' WHEN {bullets(x)} > 0.9::DOUBLE THEN 'bullets' WHEN {n} >= 20 AND {top(w)}::DOUBLE / {n} > 0.3::DOUBLE THEN 'top_word' WHEN {repeats(x, 10)} THEN 'repeats' END"""


def near(prefix: str, heads: str, short: bool) -> str:
    """Tables ``{prefix}prs`` (similar pairs a < b of a group) and ``{prefix}drp`` (doc_id dropped by greedy insertion) of a table of doc_id, grp, w (words); needs WITH RECURSIVE."""
    p = prefix
    grams = ngrams("w", 5, short)
    return f"""{p}shg AS MATERIALIZED (SELECT doc_id, grp, unnest(list_distinct(CASE WHEN len({grams}) > 0 THEN {grams} ELSE [''] END)) AS g FROM {heads}),
  {p}cnt AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM {p}shg GROUP BY doc_id),
  {p}prs AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM {p}shg a JOIN {p}shg b ON a.grp = b.grp AND a.g = b.g AND a.doc_id < b.doc_id JOIN {p}cnt ca ON ca.doc_id = a.doc_id JOIN {p}cnt cb ON cb.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, ca.n, cb.n HAVING 9 * count(*) >= 4 * (ca.n + cb.n)),
  {p}nod AS MATERIALIZED (SELECT b AS id, list(a) AS before, row_number() OVER (ORDER BY b) AS i FROM {p}prs GROUP BY b),
  {p}gre(i, dropped) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT m.i, CASE WHEN len(m.before) > len(list_intersect(m.before, g.dropped)) THEN list_append(g.dropped, m.id) ELSE g.dropped END FROM {p}gre g JOIN {p}nod m ON m.i = g.i + 1),
  {p}drp AS MATERIALIZED (SELECT unnest(dropped) AS doc_id FROM {p}gre WHERE i = (SELECT max(i) FROM {p}gre))"""


def language(x: str, lexicons: dict[str, list[str]]) -> tuple[str, str]:
    """The language with the most hits among the first 2,000 characters (of equal ones the first code) and its share of all hits."""
    w = words(f"lower(substr({x}, 1, 2000))")
    n = {k: f"len(list_filter({w}, lambda x: list_contains({arr(v)}, x)))" for k, v in sorted(lexicons.items())}
    most = f"greatest({', '.join(n.values())})"
    case = " ".join(f"WHEN {v} = {most} THEN {q(k)}" for k, v in n.items())
    return f"CASE WHEN {most} = 0 THEN NULL {case} END", f"{most}::DOUBLE / nullif({' + '.join(n.values())}, 0)"


def staged(lexicons: dict[str, list[str]]) -> str:
    """Table ``staged``: doc_id, source, bucket, tokens, reason; needs WITH RECURSIVE."""
    found, probability = language("text", lexicons)
    expected = "CASE WHEN language = 'ms' THEN 'id' ELSE language END"
    return f"""{SCRUBBED}, fil AS MATERIALIZED (SELECT *, {gopher('text', 'min_words', 'max_words')} AS gopher, sha256(text) AS key, {tokens('text')} AS tokens, {expected} AS expected FROM scr),
  fst AS MATERIALIZED (SELECT *, CASE WHEN text = '' THEN 'length' WHEN gopher IS NOT NULL THEN 'gopher' WHEN expected IN ({', '.join(map(q, sorted(lexicons)))}) AND NOT coalesce(({found}) = expected AND {probability} >= lid_threshold, false) THEN 'lid' END AS r0 FROM fil),
  num AS MATERIALIZED (SELECT *, CASE WHEN r0 IS NULL THEN row_number() OVER (PARTITION BY r0 IS NULL, key ORDER BY source, doc_id) END AS nth FROM fst),
  hds AS MATERIALIZED (SELECT doc_id, source AS grp, {words('text')} AS w FROM num WHERE r0 IS NULL AND nth = 1), {near('s', 'hds', False)},
  bad AS (SELECT DISTINCT unnest({ngrams('w', 13)}) AS gram FROM (SELECT {words("coalesce(text, '')")} AS w FROM benchmark)),
  own AS (SELECT doc_id, unnest({ngrams('w', 13)}) AS gram FROM hds),
  leak AS MATERIALIZED (SELECT DISTINCT doc_id FROM own WHERE gram IN (SELECT gram FROM bad)),
  staged AS (SELECT doc_id, source, bucket, tokens, coalesce(r0, CASE WHEN nth > 1 THEN 'exact' WHEN doc_id IN (SELECT doc_id FROM sdrp) THEN 'near' WHEN doc_id IN (SELECT doc_id FROM leak) THEN 'decontam' END) AS reason FROM num)"""
