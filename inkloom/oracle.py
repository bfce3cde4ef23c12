"""The queries once more, as SQL for DuckDB over the same tables, written without look-around, which its patterns lack."""

from __future__ import annotations

from inkloom.functions import text as T
from inkloom.queries import DECORATION
from inkloom.rules import lexicons as L
from inkloom.rules.catalog import TYPES, catalog


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


WS = r"[\s\x0b\x{85}\p{Z}]"
CLOSE = r"""['")\]]*"""
ABBREVIATED = "|".join(a.replace(".", r"\.") for a in T.ABBREVIATIONS)


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{WS}+|{WS}+$')}, '', 'g')"


def words(x: str) -> str:
    return f"len(regexp_extract_all({x}, {q(T.WORD)}))"


def sentences(x: str) -> str:
    """Protect what must not be cut (twice, since a match eats its context), then cut."""
    keep = q(rf"(^|[^\p{{L}}\p{{N}}_.])((?i:{ABBREVIATED})|\p{{L}})([.!?]+{CLOSE})({WS})")
    low = q(rf"(^|[^.!?])(\.{CLOSE})({WS}+)(\p{{Ll}})")
    t = x
    for _ in range(2):
        t = f"regexp_replace({t}, {keep}, '\\1\\2\\3' || chr(2) || '\\4', 'g')"
    for _ in range(2):
        t = f"regexp_replace({t}, {low}, '\\1\\2' || chr(2) || '\\3\\4', 'g')"
    t = f"regexp_replace({t}, {q(f'([.!?]+{CLOSE}){WS}+')}, '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({t}, chr(1)), lambda s: {strip('replace(s, chr(2), chr(32)[1:0])')}), lambda s: s <> '')"


def occurrences(x: str, what: str) -> str:
    return f"((length({x}) - length(replace({x}, {q(what)}, ''))) // {len(what)})"


def dump(x: str) -> str:
    return f"({occurrences(x, '·')} >= 2 OR {occurrences(x, '](http')} >= 2)"


def syllables(x: str) -> str:
    w = f"regexp_replace(lower({x}), {q('^[' + chr(39) + '’]+|[' + chr(39) + '’]+$')}, '', 'g')"
    core = f"regexp_replace(regexp_replace({w}, '(?:[^laeiouy]es|ed|[^laeiouy]e)$', ''), '^y', '')"
    return f"(CASE WHEN {w} = '' THEN 0 ELSE greatest(1, len(regexp_extract_all({core}, '[aeiouy]+'))) END)"


def snippet(x: str, at: int = 0) -> str:
    s = strip(f"substr({x}, {max(0, at - 30) + 1})")
    s = f"regexp_replace({'chr(8230) || ' if at > 30 else ''}{s}, {q(WS + '+')}, ' ', 'g')"
    return f"(CASE WHEN length({s}) <= 90 THEN {s} ELSE regexp_replace(substr({s}, 1, 89), {q(WS + '+$')}, '') || chr(8230) END)"


def places(x: str, pattern: str) -> str:
    """Offsets of all matches, counted from 0."""
    m, g = f"regexp_extract_all({x}, {q(pattern)})", f"regexp_split_to_array({x}, {q(pattern)})"
    return f"list_transform(range(1, len({m}) + 1), lambda k: CAST(list_sum(list_transform(({g})[1:k], lambda y: length(y))) + coalesce(list_sum(list_transform(({m})[1:k-1], lambda y: length(y))), 0) AS BIGINT))"


_K = "regexp_replace(lower(coalesce(kind, '')), '[^a-z0-9]', '', 'g')"
_KIND = f"CASE WHEN {_K} IN ('listitem', 'li') THEN 'list_item' WHEN {_K} IN ('tablecell', 'td', 'th') THEN 'table_cell' WHEN {_K} = 'heading' OR regexp_full_match({_K}, 'h[1-6]') THEN 'heading' WHEN {_K} = 'title' THEN 'title' WHEN {_K} = 'notes' THEN 'notes' ELSE 'paragraph' END"


def _blocks(text: str = "text") -> str:
    return f"""
    u AS (SELECT DISTINCT ON (file_id, block_id) *, {text} AS txt FROM blocks WHERE file_id IS NOT NULL),
    k AS (SELECT file_id AS doc_id, pos, coalesce(txt, '') AS text, {_KIND} AS kind, coalesce(line_no, 0) AS line, coalesce(col_no, 1) AS col, coalesce(block_label, '') AS label,
                 coalesce(head_level, 0) AS level, coalesce(bold_lead, false) AS bold FROM u),
    b AS MATERIALIZED (SELECT *, {words('text')} AS words, kind IN ('paragraph', 'list_item', 'table_cell', 'notes') AS prose, {dump('text')} AS dump FROM k),
    f AS (SELECT file_id AS doc_id, path, lower(trim(file_format)) AS format, doc_type FROM files WHERE file_id IS NOT NULL)"""


def _decorated() -> str:
    cases = " ".join(f"WHEN (file_id + pos) % {n} = 0 THEN {q(s)}" for n, s in DECORATION)
    return f"CASE WHEN kind = 'paragraph' AND (CASE {cases} ELSE '' END) <> '' THEN text || ' ' || (CASE {cases} ELSE '' END) ELSE text END"


B, D = _blocks(), _blocks(_decorated())
CLOSING = _blocks("CASE WHEN kind = 'paragraph' AND (file_id + pos) % 3 = 0 THEN text || ' So it holds for all of them.' ELSE text END")
NUMBERED = _blocks("CASE WHEN kind = 'heading' THEN 'Step ' || ((pos * 7 + file_id) % 9 + 1) || ': ' || text ELSE text END")
VERSIONED = _blocks("CASE WHEN kind = 'heading' THEN CASE pos % 3 WHEN 0 THEN '1.' || (file_id % 5) || '.' || (pos % 7) || ' - 2026-01-0' || (pos % 9 + 1) WHEN 1 THEN 'Added' ELSE 'Other' END ELSE text END")
CAPITALISED = _blocks("CASE WHEN kind = 'heading' AND (file_id + pos) % 5 = 0 THEN 'Understanding The Impact Of Modern Technology' ELSE text END")
EVEN = _blocks("CASE WHEN kind = 'paragraph' THEN repeat('even words ', CAST(100 + pos % 5 AS INT)) || 'end.' ELSE text END")
BOLDED = _blocks("CASE WHEN pos % 2 = 0 THEN '**' || text || '**' ELSE text END")
S = f"s AS MATERIALIZED (SELECT doc_id, pos, line, col, kind, dump, unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS sent_no FROM (SELECT *, {sentences('text')} AS l FROM b WHERE prose)), sn AS (SELECT *, {words('sentence')} AS n FROM s)"
NOT_DECK = "doc_id IN (SELECT doc_id FROM f WHERE format IS NULL OR format <> 'pptx')"


def _cols(value: str = "CAST(NULL AS DOUBLE)") -> str:
    return f"doc_id, CAST(pos AS BIGINT) AS pos, CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS col, {'round(CAST(' + value + ' AS DOUBLE), 6)' if 'NULL' not in value else value} AS value"


def _at(offset: str) -> str:
    """Line and column of an offset of text, as the engine gives them."""
    before = f"substr(text, 1, {offset})"
    last = f"list_extract(string_split({before}, chr(10)), -1)"
    return f"CAST(line + length({before}) - length(replace({before}, chr(10), '')) AS BIGINT) AS line, CAST(CASE WHEN {offset} = 0 THEN 1 ELSE length({last}) + 1 END AS BIGINT) AS col"


def _divider(body: str) -> str:
    first = f"array_to_string(list_slice(regexp_split_to_array({strip(body)}, '{WS}+'), 1, 3), ' ')"
    return f"({strip(body)} = '' OR regexp_matches({first}, '(?i)^(?:part|section|chapter|module|act|unit)\\s+(?:\\d{{1,3}}|[ivxlc]{{1,6}})\\b'))"


_SECTIONS = r"""
    h AS (SELECT doc_id, pos, level, text AS title, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS sec_no FROM b WHERE kind = 'heading'),
    ends AS (SELECT doc_id, max(pos) AS last, min(pos) FILTER (WHERE kind NOT IN ('heading', 'title')) AS first_body, min(pos) FILTER (WHERE kind = 'heading') AS first_h FROM b GROUP BY 1),
    hs AS (SELECT h.*, coalesce((SELECT min(y.pos) FROM h y WHERE y.doc_id = h.doc_id AND y.pos > h.pos) - 1, e.last) AS own_end,
                  coalesce((SELECT min(y.pos) FROM h y WHERE y.doc_id = h.doc_id AND y.pos > h.pos AND y.level <= h.level) - 1, e.last) AS sub_end,
                  (SELECT max(y.pos) FROM h y WHERE y.doc_id = h.doc_id AND y.pos < h.pos AND y.level < h.level) AS parent_pos FROM h JOIN ends e USING (doc_id)),
    x AS (SELECT doc_id, sec_no, level, title, pos AS title_pos, pos + 1 AS own_start, own_end, sub_end, parent_pos FROM hs
          UNION ALL SELECT doc_id, 0, 0, NULL, NULL, 0, coalesce(first_h - 1, last), coalesce(first_h - 1, last), NULL FROM ends WHERE first_body IS NOT NULL AND first_body <= coalesce(first_h - 1, last)),
    body AS (SELECT x.doc_id, x.sec_no, string_agg(b.text, chr(10) || chr(10) ORDER BY b.pos) FILTER (WHERE b.text <> '') AS body, sum(b.words) FILTER (WHERE b.prose) AS prose_words
             FROM x JOIN b ON b.doc_id = x.doc_id AND b.pos BETWEEN x.own_start AND x.sub_end AND b.kind NOT IN ('heading', 'title') GROUP BY 1, 2),
    kids AS (SELECT doc_id, parent_pos AS title_pos, count(*) AS children FROM x WHERE parent_pos IS NOT NULL GROUP BY 1, 2),
    sec AS (SELECT x.*, coalesce(body, '') AS body, coalesce(prose_words, 0) AS prose_words, coalesce(children, 0) AS children FROM x LEFT JOIN body USING (doc_id, sec_no) LEFT JOIN kids USING (doc_id, title_pos)),
    secs AS (SELECT *, @DIVIDER@ AS divider FROM sec)
""".replace("@DIVIDER@", _divider("body"))  # fmt: skip

_PEERS = f"WITH {B}, {_SECTIONS}, p AS (SELECT *, count(*) OVER (PARTITION BY doc_id, level) AS n_level FROM secs WHERE title IS NOT NULL AND NOT divider), pp AS (SELECT *, min(level) OVER (PARTITION BY doc_id) AS peer_level FROM p WHERE n_level >= 4)"
_PAIRED = _PEERS.replace("n_level >= 4", "n_level >= 2")


def _gate_counts() -> str:
    rows = [r for r in catalog() if r.applies_to or r.skip_for]
    lists = ", ".join(f"({q(r.code)}, {list(r.applies_to)}::VARCHAR[], {list(r.skip_for)}::VARCHAR[])" for r in rows)
    return f"""WITH {B}, r(code, applies_to, skip_for) AS (VALUES {lists})
        SELECT code, coalesce(doc_type, '') AS doc_type, count(*) AS documents FROM f, r
        WHERE doc_type IS NULL OR (NOT list_contains(skip_for, doc_type) AND (len(applies_to) = 0 OR list_contains(applies_to, doc_type))) GROUP BY ALL"""


def _asked(rules: list[tuple[str, bool, float, list[str], list[str]]]) -> str:
    """asked: each block that is asked, with each rule that is asked of it, and the answer of the stand-in."""
    lists = ", ".join(f"({q(code)}, {str(fragments).lower()}, CAST({limit} AS DOUBLE), {only}::VARCHAR[], {skip}::VARCHAR[])" for code, fragments, limit, only, skip in rules)
    return f"""{B}, r(code, fragments, lim, applies_to, skip_for) AS (VALUES {lists}),
        asked AS (SELECT doc_id, pos, text, code, lim, length(text) // 4 + 1 AS tokens, ((length(text) * 31 + 7 * CAST(code[4:] AS BIGINT) + 13) % 100) / 100 AS p FROM b JOIN f USING (doc_id), r
            WHERE prose AND NOT dump AND words >= CASE WHEN format = 'pptx' THEN 4 ELSE 8 END AND (words >= 8 OR fragments)
              AND (doc_type IS NULL OR (NOT list_contains(skip_for, doc_type) AND (len(applies_to) = 0 OR list_contains(applies_to, doc_type)))))"""


_BLOCK_RULES = [(r.code, r.fragments, r.threshold, list(r.applies_to), list(r.skip_for)) for r in catalog() if r.kind == "semantic" and r.default and r.scope == "block"]
_SHARED = [(code, fragments, 0.95, only, skip) for code, fragments, _, only, skip in _BLOCK_RULES if code == "JEV013"]


def _gated(scope: str, view: str = "text") -> str:
    """Number of the default rules of a scope and view that a document is asked, as an expression of doc_type."""
    some = [r for r in catalog() if r.kind == "semantic" and r.default and r.scope == scope and r.view == view]
    one = lambda r: f"CAST(doc_type IS NULL OR (NOT list_contains({list(r.skip_for)}::VARCHAR[], doc_type) AND ({not r.applies_to} OR list_contains({list(r.applies_to)}::VARCHAR[], doc_type))) AS INT)"
    return "(" + " + ".join(map(one, some) if some else ["0"]) + ")"


def _units() -> str:
    """All units by document, scope and view. A deck's sections are its slides."""
    return f"""WITH {B}, {_SECTIONS},
        sl AS (SELECT doc_id, line, string_agg(text, ' ' ORDER BY pos) FILTER (WHERE kind IN ('heading', 'title')) AS title, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY pos) FILTER (WHERE kind NOT IN ('heading', 'title') AND text <> ''), '') AS body
               FROM b WHERE doc_id IN (SELECT doc_id FROM f WHERE format = 'pptx') GROUP BY ALL),
        t AS (SELECT doc_id, title, body FROM secs WHERE title IS NOT NULL AND {NOT_DECK} UNION ALL SELECT doc_id, title, body FROM sl WHERE title IS NOT NULL),
        j AS (SELECT *, {_divider('body')} AS divider FROM t JOIN f USING (doc_id)), body_ AS (SELECT doc_id, string_agg(text, chr(10)) AS text FROM b WHERE prose AND NOT dump GROUP BY 1),
        al AS (SELECT doc_id, 'block' AS unit_scope, 'text' AS view, count(DISTINCT pos) AS n, count(*) AS asked FROM (WITH {_asked(_BLOCK_RULES)} SELECT * FROM asked) GROUP BY 1
            UNION ALL SELECT doc_id, 'title', 'text', count(*), sum({_gated('title')}) FROM j WHERE NOT divider AND {words('title')} >= 2 AND {_gated('title')} > 0 GROUP BY 1
            UNION ALL SELECT doc_id, 'section', 'text', count(*), sum({_gated('section')}) FROM j WHERE NOT divider AND {words('body')} >= 2 * CASE WHEN format = 'pptx' THEN 4 ELSE 8 END AND {_gated('section')} > 0 GROUP BY 1
            UNION ALL SELECT doc_id, 'document', 'text', 1, {_gated('document')} FROM body_ JOIN f USING (doc_id) WHERE {strip('text')} <> '' AND {_gated('document')} > 0
            UNION ALL SELECT doc_id, 'document', 'outline', 1, max({_gated('document', 'outline')}) FROM j WHERE {_gated('document', 'outline')} > 0 GROUP BY 1 HAVING count(*) >= 3)
        SELECT doc_id, unit_scope, view, CAST(n AS BIGINT) AS n, CAST(asked AS BIGINT) AS asked FROM al"""


_GRADE = f"(0.39 * (w / n) + 11.8 * (y / w) - 15.59)"
_GRADED = f"g AS (SELECT doc_id, pos, line, col, text, CAST(words AS DOUBLE) AS w, CAST(len({sentences('text')}) AS DOUBLE) AS n, CAST(list_sum(list_transform(regexp_extract_all(text, {q(T.WORD)}), lambda t: {syllables('t')})) AS DOUBLE) AS y FROM b WHERE prose AND words >= 30)"
_TOKENS = f"t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), {q(L.REGISTER_WORD)})) AS w FROM b WHERE kind = 'paragraph' AND NOT dump)"
_FIRST = "first AS (SELECT doc_id, min(pos) AS pos, arg_min(line, pos) AS line, arg_min(col, pos) AS col FROM b WHERE @COND@ GROUP BY 1)"
_PAIRS = "p AS (SELECT t.doc_id AS pair_id, s.text AS source, t.text AS rewrite FROM documents t JOIN documents s ON t.doc_id = s.doc_id + 1 WHERE s.text IS NOT NULL AND t.text IS NOT NULL)"



def _claims(side: str) -> str:
    """{side}_t: every claim of one side, as (pair_id, kind, token)."""
    fenced = f"regexp_replace({side}, {q(L.FENCED)}, ' ', 'g')"
    spans = f"regexp_replace({fenced}, {q(L.CODE_SPAN)}, ' ', 'g')"
    body = f"regexp_replace({spans}, {q(L.URL)}, ' ', 'g')"
    # what stands around a number is matched with it, so blanks are doubled first; a name must not open a line or a sentence
    number = r"(?:^|[^\p{L}\p{N}_.])([+−-]?\d[\d,]*(?:\.\d+)?%?)(?:$|[^\p{L}\p{N}_])"
    spaced = "regexp_replace(regexp_replace(body, '([0-9%,])([+−-])', '\\1\\2 ', 'g'), '([^0-9\\p{L}_.,%+−-])', '\\1\\1', 'g')"
    foreign = r"[\p{Arabic}\p{Cyrillic}\p{Greek}\p{Hebrew}\p{Devanagari}\p{Thai}\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2AF}]"  # letters beside which a name has no boundary
    spelled = f"list_transform(regexp_extract_all(body, {q('(?i)' + chr(92) + 'b(?:' + '|'.join(L.NUMBER_WORDS) + ')' + chr(92) + 'b')}), lambda x: CAST(list_position({list(L.NUMBER_WORDS)}, lower(x)) - 1 AS VARCHAR))"
    digits = f"list_transform(regexp_extract_all({spaced}, {q(number)}, 1), lambda x: regexp_replace(replace(x, ',', ''), '^\\++', ''))"
    lines = f"list_transform(regexp_split_to_array(body, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: regexp_replace(x, '^[#>*+ \\t-]+', ''))"
    rest = f"list_transform(flatten(list_transform({lines}, lambda x: {sentences('x')})), lambda s: regexp_extract_all(regexp_replace(regexp_replace(s, {q(foreign)}, '_', 'g'), {q('^' + L.CAPITALIZED)}, ' '), {q(L.CAPITALIZED)}))"
    small = lambda p: f"list_transform(regexp_extract_all(body, {q(p)}), lambda x: lower(x))"
    kinds = {
        "number": f"list_concat({digits}, {spelled})",
        "name": f"list_filter(flatten({rest}), lambda w: NOT list_contains({list(L.NOT_NAMES)}, w))",
        "quoted": f"list_transform(regexp_extract_all(body, {q(L.QUOTED)}, 1), lambda x: {strip('x')})",
        "verbatim": f"list_transform(held, lambda x: {strip('x')})",
        "superlative": small(L.SUPERLATIVE),
        "scope": f"list_transform(regexp_extract_all(body, {q(L.SCOPE)}), lambda x: regexp_replace(lower(x), {q(WS + '+')}, ' ', 'g'))",
        "negation": small(L.NEGATION),
        "hedge": small(L.HEDGE),
    }
    each = " UNION ALL ".join(f"SELECT pair_id, '{k}' AS kind, unnest({x}) AS token FROM {side}_k" for k, x in kinds.items())
    first = f"{_PAIRS}, " if side == "source" else ""
    return f"""{first}{side}_k AS MATERIALIZED (SELECT pair_id, list_concat(regexp_extract_all({side}, {q(L.FENCED)}), list_concat(regexp_extract_all({fenced}, {q(L.CODE_SPAN)}), regexp_extract_all({spans}, {q(L.URL)}))) AS held, {body} AS body FROM p), {side}_t AS ({each})"""


_PART = f"{strip('body')}"
_HYPHEN = L.PREDICATE_HYPHEN.replace("(?=", "(?:")


def _opening(x: str) -> str:
    outer = "[,;:.\"'()“”‘’]+"
    return f"regexp_replace(array_to_string(list_slice(regexp_split_to_array({strip('lower(' + x + ')')}, {q(WS + '+')}), 1, 2), ' '), {q('^' + outer + '|' + outer + '$')}, '', 'g')"


def _has_run(units: str) -> str:
    """Whether three units in a row open alike; the first may merely contain the key."""
    key = lambda i: _opening(f"({units})[{i}]")
    return f"len(list_filter(range(3, len({units}) + 1), lambda i: {key('i')} <> '' AND {key('i')} = {key('i - 1')} AND ({key('i - 1')} = {key('i - 2')} OR contains(' ' || lower(({units})[i - 2]) || ' ', ' ' || {key('i - 1')} || ' ')))) > 0"


def _plain(x: str) -> str:
    """Without inline markup; emphasis is taken off twice, since a match eats what stands around it."""
    t = x
    steps = [(r"!\[([^\]]*)\]\([^)]*\)", r"\1"), (r"\[([^\]]+)\]\([^)]*\)", r"\1"), (r"\[([^\]]+)\]\[[^\]]*\]", r"\1"), (r"`([^`]*)`", r"\1"), (r"\*\*(.+?)\*\*|__(.+?)__", r"\1\2")]
    steps += [(r"(^|[^\p{L}\p{N}_])(?:\*([^\s*]|[^\s].*?[^\s])\*|_([^\s_]|[^\s].*?[^\s])_)($|[^\p{L}\p{N}_])", r"\1\2\3\4")] * 2
    steps += [(r"<[^>]+>", ""), (r"[ \t]{2,}", " ")]
    for pattern, keep in steps:
        t = f"regexp_replace({t}, {q(pattern)}, '{keep}', 'g')"
    return strip(t)


ORACLE_SQL = {
    "strip_markup": f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, line, {_plain('line')} AS plain FROM l) SELECT doc_id, CAST(sum(length(line)) AS BIGINT) AS raw_chars, CAST(sum(length(plain)) AS BIGINT) AS plain_chars, CAST(sum({words('plain')}) AS BIGINT) AS words FROM s GROUP BY 1",
    "word_stats": f"WITH {B} SELECT doc_id, count(*) AS blocks, CAST(sum(words) AS BIGINT) AS words, CAST(sum(length(text) // 4 + 1) AS BIGINT) AS tokens, CAST(sum(CASE WHEN prose THEN words ELSE 0 END) AS BIGINT) AS prose_words FROM b GROUP BY 1",
    "sentence_split": f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, line_no, {sentences('line')} AS s FROM l) SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(len(s) AS BIGINT) AS n, array_to_string(s, '|') AS joined FROM x WHERE len(s) > 0",
    "readability": f"WITH {B}, {_GRADED} SELECT doc_id, CAST(pos AS BIGINT) AS pos, round({_GRADE}, 6) AS grade FROM g WHERE n >= 3",
    "snippets": f"WITH {B} SELECT doc_id, CAST(pos AS BIGINT) AS pos, {snippet('text')} AS head, {snippet('text', 50)} AS tail FROM b",
    "link_dumps": f"WITH {B} SELECT doc_id, CAST(pos AS BIGINT) AS pos FROM b WHERE dump",
    "clr001": f"WITH {B}, {S} SELECT {_cols('n')} FROM sn WHERE NOT dump AND n > 30",
    "clr002": f"WITH {B}, {_GRADED} SELECT {_cols(_GRADE)} FROM g WHERE n >= 3 AND w >= 40 AND {occurrences('text', '·')} < 2 AND {_GRADE} > 12",
    "clr003": f"WITH {B}, x AS (SELECT *, row_number() OVER w AS k, first_value(pos) OVER w AS first_pos FROM (SELECT *, array_to_string(list_transform(regexp_extract_all(text, {q(T.WORD)}), lambda t: lower(t)), ' ') AS key FROM b WHERE prose AND words >= 8) WINDOW w AS (PARTITION BY doc_id, key ORDER BY pos)) SELECT {_cols('first_pos')} FROM x WHERE k > 1",
    "clr004": f"WITH {D}, x AS (SELECT *, sum(words) OVER (PARTITION BY doc_id) AS total, sum(h) OVER (PARTITION BY doc_id) AS n FROM (SELECT *, len(regexp_extract_all(text, {q(L.CONTRAST)})) AS h FROM b WHERE prose AND NOT dump)), e AS (SELECT *, unnest(range(h)) FROM x WHERE n >= 3 AND n * 1000 / total > 2.5) SELECT {_cols('n * 1000 / total')} FROM e",
    "clr005": f"WITH {B}, {S}, {_FIRST.replace('@COND@', 'prose')}, x AS (SELECT doc_id, stddev_pop(n) / avg(n) AS cv FROM sn WHERE NOT dump AND n > 0 GROUP BY 1 HAVING count(*) >= 25 AND stddev_pop(n) / avg(n) < 0.45) SELECT {_cols('cv')} FROM x JOIN first USING (doc_id)",
    "clr006": f"WITH {B}, {_FIRST.replace('@COND@', 'prose AND words >= 15 AND NOT dump')}, x AS (SELECT doc_id, stddev_pop(words) / avg(words) AS cv FROM b WHERE prose AND words >= 15 AND NOT dump GROUP BY 1 HAVING count(*) >= 8 AND stddev_pop(words) / avg(words) < 0.40) SELECT {_cols('cv')} FROM x JOIN first USING (doc_id)",
    "clr007": f"WITH {CLOSING}, p AS (SELECT *, list_extract(l, -1) AS last FROM (SELECT *, {sentences('text')} AS l FROM b WHERE prose AND words >= 40 AND NOT dump) WHERE len(l) >= 3), x AS (SELECT *, regexp_matches(last, {q(L.CLOSER)}) AS hit, count(*) OVER (PARTITION BY doc_id) AS n, sum(CAST(regexp_matches(last, {q(L.CLOSER)}) AS INT)) OVER (PARTITION BY doc_id) AS hits FROM p) SELECT {_cols('hits / n')} FROM x WHERE hit AND n >= 6 AND hits >= 3 AND hits / n >= 0.15",
    "clr008": f"{_PEERS.replace(B, EVEN).replace('FROM secs WHERE', 'FROM secs WHERE ' + NOT_DECK + ' AND')}, y AS (SELECT doc_id, min(title_pos) AS pos, stddev_pop(prose_words) / avg(prose_words) AS cv FROM pp WHERE level = peer_level GROUP BY 1 HAVING sum(prose_words) >= 500 AND min(prose_words) > 0 AND stddev_pop(prose_words) / avg(prose_words) < 0.30) SELECT {_cols('cv')} FROM y JOIN (SELECT doc_id, pos, line, col FROM b) USING (doc_id, pos)",
    "clr009": f"WITH {B} SELECT {_cols('n')} FROM (SELECT *, len({sentences('text')}) AS n FROM b WHERE kind = 'paragraph') WHERE n > 8",
    "clr011": f"WITH {B}, {_FIRST.replace('@COND@', 'true')}, x AS (SELECT doc_id, sum(words) AS total FROM b GROUP BY 1 HAVING sum(words) >= 400 AND NOT bool_or(kind IN ('heading', 'list_item'))) SELECT {_cols('total')} FROM x JOIN first USING (doc_id)",
    "clr013": f"WITH {D}, {_TOKENS}, {_FIRST.replace('@COND@', chr(107) + 'ind = ' + q('paragraph') + ' AND NOT dump')}, x AS (SELECT doc_id, 100 * count(*) FILTER (WHERE list_contains({list(L.REGISTER)}, w)) / count(*) AS v FROM t GROUP BY 1 HAVING count(*) >= 150 AND 100 * count(*) FILTER (WHERE list_contains({list(L.REGISTER)}, w)) / count(*) > 1.0) SELECT {_cols('v')} FROM x JOIN first USING (doc_id)",
    "rif001": f"WITH {D}, c AS (SELECT *, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) - 1 AS place FROM b WHERE regexp_matches(text, {q(L.DECORATIVE)})), m AS (SELECT * FROM c WHERE regexp_matches(ch, {q(L.DECORATIVE)}) AND NOT (regexp_matches(ch, '[‘’“”]') AND (({strip('text')} <> '' AND regexp_replace(text, '[“”‘’ \\n]', '', 'g') = '') OR (regexp_full_match(text, {q(f'(?s){WS}*[“‘][^“”]*[”’]{WS}*')}) AND place IN (length(text) - length(regexp_replace(text, {q(f'^{WS}+')}, '')), length(regexp_replace(text, {q(f'{WS}+$')}, '')) - 1))))) SELECT doc_id, CAST(pos AS BIGINT) AS pos, {_at('place')}, CAST(NULL AS DOUBLE) AS value FROM m",
    "rif002": f"WITH {CAPITALISED}, x AS (SELECT *, regexp_extract_all(text, {q(T.WORD)}) AS ws FROM b WHERE kind IN ('heading', 'title')), y AS (SELECT *, list_filter(ws, lambda w: NOT list_contains({list(L.MINOR_WORDS)}, lower(w)) AND NOT (upper(w) = w AND regexp_matches(w, '[A-Za-z]'))) AS major FROM x) SELECT {_cols()} FROM y WHERE len(ws) >= 4 AND len(major) >= 3 AND len(list_filter(major, lambda w: NOT regexp_matches(w, '^[A-Z]'))) = 0",
    "rif003": f"WITH {B}, x AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, sum(CAST(bold AS INT)) OVER (PARTITION BY doc_id) AS k FROM b WHERE kind = 'list_item') SELECT {_cols('k / n')} FROM x WHERE n >= 3 AND k / n >= 0.6 AND bold",
    "rif004": f"WITH {D}, m AS (SELECT *, unnest({places('text', L.REVISION_NOTE)}) AS place FROM b WHERE regexp_matches(text, {q(L.REVISION_NOTE)})) SELECT doc_id, CAST(pos AS BIGINT) AS pos, {_at('place')}, CAST(NULL AS DOUBLE) AS value FROM m",
    "rif006": f"""WITH {B}, {_SECTIONS}, hd AS (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM b WHERE kind = 'heading' AND {NOT_DECK}),
        ones AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM hd WHERE level = 1)
        SELECT {_cols('level')} FROM hd WHERE level > before + 1 UNION ALL SELECT {_cols('1')} FROM ones WHERE k > 1
        UNION ALL SELECT {_cols('0')} FROM hd WHERE (doc_id, pos) IN (SELECT (c.doc_id, c.title_pos) FROM secs c JOIN secs p ON p.doc_id = c.doc_id AND p.title_pos = c.parent_pos WHERE p.children = 1 AND p.level > 1)""",
    "rif007": f"WITH {B} SELECT {_cols()} FROM b WHERE kind = 'heading' AND {NOT_DECK} AND (regexp_matches(text, {q(L.NUMBERED)}) OR regexp_matches(text, {q(L.EMOJI)}) OR contains(list_extract(string_split(text, chr(10)), 1), ']('))",
    "rif009": f"WITH {B}, x AS (SELECT *, lag(kind) OVER w AS before, lead(kind) OVER w AS after FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) SELECT {_cols()} FROM x WHERE kind = 'list_item' AND coalesce(before, '') <> 'list_item' AND coalesce(after, '') <> 'list_item'",
    "sentence_rhythm": f"WITH {B}, {S} SELECT doc_id, count(*) AS sentences, CAST(sum(n) AS BIGINT) AS words, round(stddev_pop(n) / avg(n), 6) AS variation FROM sn WHERE NOT dump AND n > 0 GROUP BY 1 HAVING count(*) >= 25",
    "paragraph_rhythm": f"WITH {B} SELECT doc_id, count(*) AS paragraphs, round(stddev_pop(words) / avg(words), 6) AS variation FROM b WHERE prose AND words >= 15 AND NOT dump GROUP BY 1 HAVING count(*) >= 4",
    "sections": f"WITH {B}, {_SECTIONS} SELECT doc_id, CAST(sec_no AS BIGINT) AS sec_no, CAST(level AS BIGINT) AS level, CAST(own_start AS BIGINT) AS own_start, CAST(own_end AS BIGINT) AS own_end, CAST(sub_end AS BIGINT) AS sub_end, CAST(prose_words AS BIGINT) AS prose_words, CAST(children AS BIGINT) AS children, coalesce(title, '') AS title, CAST(coalesce(parent_pos, -1) AS BIGINT) AS parent_pos FROM secs",
    "dividers": f"WITH {B}, {_SECTIONS} SELECT doc_id, CAST(sec_no AS BIGINT) AS sec_no, title FROM secs WHERE title IS NOT NULL AND divider",
    "section_rhythm": f"{_PAIRED} SELECT doc_id, count(*) AS sections, round(stddev_pop(prose_words) / avg(prose_words), 6) AS variation FROM pp WHERE level = peer_level GROUP BY 1 HAVING sum(prose_words) > 0",
    "peer_sections": f"{_PAIRED} SELECT doc_id, CAST(max(peer_level) AS BIGINT) AS peer_level, count(*) AS sections, CAST(sum(prose_words) AS BIGINT) AS words FROM pp WHERE level = peer_level GROUP BY 1",
    "rules_catalog": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{s}', {str(o).lower()}, CAST({n} AS BIGINT))" for (k, s, o), n in sorted(__import__("collections").Counter((r.kind, r.scope, r.default) for r in catalog()).items())) + ") AS t(kind, scope, is_default, rules)",
    "rule_applies": _gate_counts(),
    "doc_types": f"WITH {B} SELECT CASE WHEN format = 'pptx' THEN 'presentation' ELSE coalesce(doc_type, '') END AS doc_type, CASE WHEN format = 'pptx' THEN 'format' WHEN doc_type IS NOT NULL THEN 'given' ELSE 'unresolved' END AS doc_type_source, count(*) AS documents FROM f GROUP BY ALL",
    "custom_phrase": f"WITH {B}, m AS (SELECT doc_id, pos, len(regexp_extract_all(text, {q(f'(?i)(?:^|[^' + chr(92) + 'p{L}' + chr(92) + f'p{{N}}_-])(?:near{WS}+the{WS}+gate|side{WS}+room|don[' + chr(39) + '’]t)(?:$|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_-])')})) AS n FROM b WHERE prose) SELECT doc_id, CAST(sum(n) AS BIGINT) AS hits, CAST(min(pos) AS BIGINT) AS first_pos FROM m WHERE n > 0 GROUP BY 1",
    "custom_regex": f"WITH {B}, m AS (SELECT *, unnest({places('text', '[0-9]+ (?:months|minutes)')}) AS place FROM b WHERE regexp_matches(text, '[0-9]+ (?:months|minutes)')), x AS (SELECT doc_id, pos, {_at('place')} FROM m) SELECT doc_id, CAST(pos AS BIGINT) AS pos, col FROM x",
    "plan_block_units": f"WITH {_asked(_BLOCK_RULES)} SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(tokens AS BIGINT) AS tokens, count(*) AS asked FROM asked GROUP BY ALL",
    "plan_units": _units(),
    "score_findings": f"WITH {_asked(_BLOCK_RULES)} SELECT code, count(*) AS findings FROM asked WHERE code <> 'JEV013' AND p >= lim GROUP BY 1 UNION ALL SELECT code, count(*) FROM (SELECT doc_id, code FROM asked WHERE code = 'JEV013' GROUP BY 1, 2 HAVING count(*) >= 8 AND count(*) FILTER (WHERE p >= lim) / count(*) <= 0.1) GROUP BY 1",
    "model_answers": f"WITH {_asked(_BLOCK_RULES)} SELECT doc_id, CAST(pos AS BIGINT) AS pos, code, round(p, 2) AS probability FROM asked",
    "run_stats": f"WITH {_asked(_BLOCK_RULES)}, x AS (SELECT DISTINCT doc_id, pos, tokens FROM asked) SELECT doc_id, count(*) FILTER (WHERE tokens <= 24000) AS calls, CAST(coalesce(sum(tokens) FILTER (WHERE tokens <= 24000), 0) AS BIGINT) AS input_tokens, count(*) FILTER (WHERE tokens > 24000) AS skipped, CAST(0 AS BIGINT) AS context_exceeded, CAST(0 AS BIGINT) AS errors FROM x GROUP BY 1",
    "share_below": f"WITH {_asked(_SHARED)}, x AS (SELECT doc_id, code FROM asked GROUP BY 1, 2 HAVING count(*) >= 8 AND count(*) FILTER (WHERE p >= lim) / count(*) <= 0.1) SELECT doc_id, code, CAST(coalesce((SELECT min(pos) FROM b WHERE b.doc_id = x.doc_id AND prose), (SELECT min(pos) FROM b WHERE b.doc_id = x.doc_id)) AS BIGINT) AS pos FROM x",
    "classified_types": f"""WITH {B}, t AS (SELECT doc_id, sum(words) AS w, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS text FROM b WHERE prose GROUP BY 1 HAVING sum(words) > 0),
        c AS (SELECT doc_id, format, doc_type, CASE WHEN text IS NOT NULL THEN ({list(TYPES)})[CAST((length(text) + w) % {len(TYPES)} + 1 AS BIGINT)] END AS choice FROM f LEFT JOIN t USING (doc_id))
        SELECT CASE WHEN format = 'pptx' THEN 'presentation' ELSE coalesce(doc_type, choice, '') END AS doc_type, CASE WHEN format = 'pptx' THEN 'format' WHEN doc_type IS NOT NULL THEN 'given' WHEN choice IS NOT NULL THEN 'classified' ELSE 'unresolved' END AS doc_type_source, count(*) AS documents FROM c GROUP BY ALL""",
    "txt_blocks": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL),
        i AS (SELECT *, {strip('line')} = '' AS blank, sum(CAST({strip('line')} = '' AS INT)) OVER (PARTITION BY doc_id ORDER BY n) AS isle FROM l),
        p AS (SELECT doc_id, isle, min(n) AS line, sum({words('line')}) AS words FROM i WHERE NOT blank GROUP BY 1, 2)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS BIGINT) AS pos, CAST(line AS BIGINT) AS line, CAST(words AS BIGINT) AS words FROM p""",
    "stream_long_sentences": f"WITH x AS (SELECT doc_id, {sentences('text')} AS s FROM documents WHERE text IS NOT NULL), y AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS sent_no FROM x) SELECT doc_id, CAST(sent_no AS BIGINT) AS sent_no, CAST({words('sentence')} AS BIGINT) AS words FROM y WHERE {words('sentence')} > 30",
    "stream_windows": f"SELECT strftime(CAST(timezone('UTC', added_at) AS DATE), '%Y-%m-%d') AS window_day, coalesce(source, '') AS source, count(*) AS documents, CAST(sum({words('text')}) AS BIGINT) AS words FROM documents WHERE text IS NOT NULL AND added_at IS NOT NULL GROUP BY ALL",
    "compare_features": f"WITH {_claims('source')}, {_claims('rewrite')} SELECT pair_id, side, kind, count(*) AS n, count(DISTINCT token) AS distinct_tokens FROM (SELECT *, 'source' AS side FROM source_t UNION ALL SELECT *, 'rewrite' FROM rewrite_t) GROUP BY ALL",
    "compare_changes": f"""WITH {_claims('source')}, {_claims('rewrite')}, a AS (SELECT pair_id, kind, token, count(*) AS a FROM source_t WHERE NOT contains(lower(token), 'friday') GROUP BY ALL), z AS (SELECT pair_id, kind, token, count(*) AS z FROM rewrite_t WHERE NOT contains(lower(token), 'friday') GROUP BY ALL),
        j AS (SELECT pair_id, kind, token, coalesce(a, 0) AS a, coalesce(z, 0) AS z FROM a FULL JOIN z USING (pair_id, kind, token)),
        c AS (SELECT pair_id, kind, sum(a) AS a, sum(z) AS z FROM j WHERE kind IN ('superlative', 'scope', 'negation', 'hedge') GROUP BY ALL HAVING sum(z) < sum(a)),
        al AS (SELECT pair_id, CASE WHEN z = 0 THEN 'LOST' ELSE 'ADDED' END AS direction, kind, a, z FROM j WHERE kind IN ('number', 'name', 'quoted', 'verbatim') AND (a = 0 OR z = 0) UNION ALL SELECT pair_id, 'COUNT', kind, a, z FROM c)
        SELECT pair_id, direction, kind, count(*) AS changes, CAST(sum(a) AS BIGINT) AS source_n, CAST(sum(z) AS BIGINT) AS rewrite_n FROM al GROUP BY ALL""",
    "clr010": f"WITH {BOLDED}, {_FIRST.replace('@COND@', 'prose')}, x AS (SELECT doc_id, sum(list_sum(list_transform(regexp_extract_all(replace(text, chr(10), ' '), '\\*\\*.+?\\*\\*|__.+?__'), lambda m: {words('m')}))) / sum(words) AS v FROM b WHERE prose AND doc_id IN (SELECT doc_id FROM f WHERE format = 'md') GROUP BY 1 HAVING sum(words) >= 500) SELECT {_cols('v')} FROM x JOIN first USING (doc_id) WHERE v > 0.30",
    "clr012": f"""WITH {B}, {_SECTIONS},
        sl AS (SELECT doc_id, min(pos) FILTER (WHERE kind IN ('heading', 'title')) AS pos, line, 1 AS col, string_agg(text, ' ' ORDER BY pos) FILTER (WHERE kind IN ('heading', 'title')) AS title, sum(CASE WHEN prose THEN words ELSE 0 END) AS pw, sum(CAST(kind = 'list_item' AS INT)) AS bullets
               FROM b WHERE doc_id IN (SELECT doc_id FROM f WHERE format = 'pptx') GROUP BY doc_id, line),
        tops AS (SELECT s.doc_id, s.title_pos AS pos, t.line, t.col, s.title, s.prose_words AS pw, (SELECT count(*) FROM b WHERE b.doc_id = s.doc_id AND b.pos BETWEEN s.own_start AND s.sub_end AND b.kind = 'list_item') AS bullets
               FROM secs s JOIN b t ON t.doc_id = s.doc_id AND t.pos = s.title_pos WHERE s.title IS NOT NULL AND s.parent_pos IS NULL AND s.{NOT_DECK}),
        al AS (SELECT * FROM sl WHERE title IS NOT NULL UNION ALL SELECT * FROM tops)
        SELECT {_cols('CASE WHEN pw > 40 THEN pw ELSE bullets END')} FROM al WHERE pw > 40 OR bullets > 5
        UNION ALL SELECT {_cols(words('title'))} FROM al WHERE {words('title')} > 0 AND {words('title')} NOT BETWEEN 3 AND 20""",
    "clr014": f"""WITH {D}, {S}, t AS (SELECT doc_id, pos, line, col, sent_no, regexp_extract_all(lower(sentence), {q(L.ECHO_WORD)}) AS w FROM s WHERE kind = 'paragraph' AND NOT dump),
        pr AS (SELECT * FROM (SELECT *, lag(w) OVER (PARTITION BY doc_id, pos ORDER BY sent_no) AS a FROM t) WHERE a IS NOT NULL AND least(len(a), len(w)) >= 6),
        x AS (SELECT doc_id, pos, line, col, sent_no, least(len(a), len(w)) AS short, w, unnest(a) AS aw, generate_subscripts(a, 1) AS i FROM pr),
        y AS (SELECT *, unnest(w) AS bw, generate_subscripts(w, 1) AS j FROM x), m AS (SELECT *, i - j AS d FROM y WHERE aw = bw),
        g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, pos, sent_no, d ORDER BY i) AS g FROM m), r AS (SELECT doc_id, pos, line, col, sent_no, short, count(*) AS run FROM g GROUP BY doc_id, pos, line, col, sent_no, short, d, g),
        best AS (SELECT doc_id, pos, line, col, sent_no, short, max(run) AS run FROM r GROUP BY ALL)
        SELECT {_cols('run / short')} FROM best WHERE run >= 5 AND run * 2 >= short QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY sent_no) = 1""",
    "clr015": f"""WITH {D}, t AS MATERIALIZED (SELECT doc_id, pos, line, col, {sentences('text')} AS l FROM b WHERE kind = 'paragraph' AND NOT dump),
        un AS (SELECT doc_id, pos, line, col, 0 AS k, l AS units FROM t UNION ALL SELECT doc_id, pos, line, col, k, list_filter(list_transform(regexp_split_to_array(x, '[,;]\\s+'), lambda z: {strip('z')}), lambda z: z <> '') FROM (SELECT *, unnest(l) AS x, generate_subscripts(l, 1) AS k FROM t)),
        h AS (SELECT doc_id, pos, line, col, min(k) AS k FROM un WHERE len(units) >= 3 AND {_has_run('units')} GROUP BY ALL) SELECT {_cols('k')} FROM h""",
    "rif005": f"""WITH {NUMBERED}, {_SECTIONS}, w AS (SELECT *, title || ' ' || array_to_string(list_slice(regexp_split_to_array({_PART}, {q(WS + '+')}), 1, 8), ' ') AS wh FROM secs WHERE title IS NOT NULL AND {NOT_DECK}),
        n AS (SELECT doc_id, sec_no, title_pos AS pos, CAST(regexp_extract(wh, {q(L.PART)}, 2) AS INT) AS n, rtrim(lower(regexp_extract(wh, {q(L.PART)}, 1)), 's') AS what FROM w WHERE regexp_matches(wh, {q(L.PART)})),
        r AS (SELECT *, max(n) OVER (PARTITION BY doc_id, what ORDER BY sec_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM n) SELECT {_cols('n')} FROM r JOIN (SELECT doc_id, pos, line, col FROM b) USING (doc_id, pos) WHERE n < seen""",
    "rif008": f"""WITH {VERSIONED}, {_SECTIONS}, t AS (SELECT doc_id, sec_no, title_pos AS pos, parent_pos, title, own_start, own_end, regexp_replace({strip('title')}, '^#+', '') AS hd FROM secs WHERE title IS NOT NULL AND {NOT_DECK}),
        v AS (SELECT *, regexp_matches({strip('hd')}, {q(L.VERSION)}) AS is_version, regexp_extract({strip('hd')}, {q(L.VERSION)}, 1) AS version, regexp_extract({strip('hd')}, {q(L.VERSION)}, 2) AS dated, contains(lower(hd), 'unreleased') AS unrel FROM t),
        d AS (SELECT *, count(*) FILTER (WHERE is_version) OVER (PARTITION BY doc_id) AS versions FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sec_no) AS k FROM d WHERE versions >= 2 AND (is_version OR unrel)),
        o AS (SELECT *, list_transform(string_split(version, '.'), lambda x: CAST(x AS INT)) AS key FROM r WHERE is_version), p AS (SELECT *, lag(key) OVER (PARTITION BY doc_id ORDER BY sec_no) AS before FROM o),
        gr AS (SELECT g.*, (SELECT count(*) FROM b WHERE b.doc_id = g.doc_id AND b.pos BETWEEN g.own_start AND g.own_end AND b.kind NOT IN ('heading', 'title')) AS own FROM d g JOIN r ON r.doc_id = g.doc_id AND r.pos = g.parent_pos),
        al AS (SELECT doc_id, pos, 1 AS n FROM r WHERE NOT is_version AND k > 1 UNION ALL SELECT doc_id, pos, 2 FROM p WHERE key > before
               UNION ALL SELECT doc_id, pos, 3 FROM o WHERE dated <> '' AND NOT regexp_full_match(trim(dated, '() '), '\\d{{4}}-\\d{{2}}-\\d{{2}}') UNION ALL SELECT doc_id, pos, CASE WHEN list_contains({list(L.CHANGE_GROUPS)}, {strip('lower(title)')}) THEN 5 ELSE 4 END FROM gr WHERE own = 0 OR NOT list_contains({list(L.CHANGE_GROUPS)}, {strip('lower(title)')}))
        SELECT {_cols('n')} FROM al JOIN (SELECT doc_id, pos, line, col FROM b) USING (doc_id, pos)""",
    "rif010": f"WITH {D}, m AS (SELECT *, unnest({places('text', _HYPHEN)}) AS place, unnest(regexp_extract_all(text, {q(_HYPHEN)}, 1)) AS hit FROM b WHERE prose AND regexp_matches(text, {q(_HYPHEN)})), x AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM m WHERE NOT regexp_matches(hit, {q(L.KEEPS_HYPHEN)})) SELECT doc_id, CAST(pos AS BIGINT) AS pos, {_at('place')}, CAST(n AS DOUBLE) AS value FROM x WHERE n >= 2",
    "slide_sections": f"""WITH {B}, sl AS (SELECT doc_id, line, min(pos) AS own_start, string_agg(text, ' ' ORDER BY pos) FILTER (WHERE kind IN ('heading', 'title')) AS title, sum(CASE WHEN prose THEN words ELSE 0 END) AS prose_words, sum(CAST(kind = 'list_item' AS INT)) AS bullets
        FROM b WHERE doc_id IN (SELECT doc_id FROM f WHERE format = 'pptx') GROUP BY ALL)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY own_start) AS BIGINT) AS sec_no, 'slide ' || line AS label, coalesce(title, '') AS title, CAST(prose_words AS BIGINT) AS prose_words, CAST(bullets AS BIGINT) AS bullets FROM sl""",
    "outline": f"""WITH {B}, {_SECTIONS}, own AS (SELECT s.*, (SELECT count(*) FROM b WHERE b.doc_id = s.doc_id AND b.pos BETWEEN s.own_start AND s.own_end AND b.kind NOT IN ('heading', 'title')) AS own, coalesce((SELECT b.label FROM b WHERE b.doc_id = s.doc_id AND b.pos = s.title_pos), '') AS label FROM secs s)
        SELECT doc_id, CAST(sec_no AS BIGINT) AS k, repeat(' ', CAST(2 * greatest(level, 1) AS INT)) || CASE WHEN label <> '' THEN label || ' ' ELSE '' END || coalesce(title, '(untitled)') || ' [' || own || ' blocks, ' || len(list_filter(regexp_split_to_array(body, '\\s+'), lambda x: x <> '')) || ' words]' AS line_text FROM own
        UNION ALL SELECT doc_id, -1, path || ' (' || coalesce(format, '?') || ': ' || CAST(sum(own) AS BIGINT) || ' blocks, ' || count(*) || ' sections)' FROM own JOIN f USING (doc_id) GROUP BY doc_id, path, format""",
}


def _all_default() -> str:
    """Findings of the exact rules that are on, over the tables as they are: the single rules' SQL without what was added to the texts for their sake."""
    parts = []
    for r in catalog():
        if r.kind == "static" and r.default:
            sql = ORACLE_SQL[r.code.lower()]
            for changed in (D, CLOSING, NUMBERED, VERSIONED, EVEN, BOLDED, CAPITALISED):
                sql = sql.replace(changed, B)
            if r.code == "CLR001":
                sql = sql.replace("n > 30", "n > 45")
            parts.append(f"SELECT {q(r.code)} AS code, doc_id FROM ({sql})")
    return " UNION ALL ".join(parts)


ORACLE_SQL["summary_top_codes"] = f"SELECT code, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, code) AS rank FROM ({_all_default()}) GROUP BY 1 QUALIFY rank <= 6"
ORACLE_SQL["bench_by_label"] = f"SELECT code, label, count(*) AS documents FROM (SELECT DISTINCT code, doc_id FROM ({_all_default()})) JOIN (SELECT DISTINCT file_id AS doc_id, nature AS label FROM labels WHERE nature IS NOT NULL) USING (doc_id) GROUP BY ALL"

_GATES = ", ".join(f"({q(r.code)}, {list(r.applies_to)}::VARCHAR[], {list(r.skip_for)}::VARCHAR[])" for r in catalog() if r.kind == "static")
ORACLE_SQL["gated_findings"] = f"""WITH r(code, applies_to, skip_for) AS (VALUES {_GATES}), t AS (SELECT file_id AS doc_id, CASE WHEN lower(trim(file_format)) = 'pptx' THEN 'presentation' ELSE doc_type END AS doc_type FROM files)
    SELECT code, count(*) AS findings, count(DISTINCT doc_id) AS documents FROM ({_all_default()}) JOIN t USING (doc_id) JOIN r USING (code)
    WHERE doc_type IS NULL OR (NOT list_contains(skip_for, doc_type) AND (len(applies_to) = 0 OR list_contains(applies_to, doc_type))) GROUP BY 1"""
