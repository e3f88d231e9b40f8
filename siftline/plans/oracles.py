"""The queries said in DuckDB's SQL, put together from the same registries.

RE2 has no lookahead, so two patterns are given in an equivalent form.
"""

from __future__ import annotations

from siftline.functions.detectors import PERSONAL, SECRETS, Detector
from siftline.functions.text import DIGIT
from siftline.operators.routing import BINARY, FIXTURE_PARTS, IDE_PARTS, SUPPORTED, VCR_PARTS
from siftline.plans import samples

_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"
#: existence is what these decide; neither kind's redaction shows the value
_WITHOUT_LOOKAHEAD = {
    "US Social Security Number (SSN)": r"\b(?:00[1-9]|0[1-9]\d|[1-578]\d{2}|6(?:[0-57-9]\d|6[0-57-9]))[- ]?(?:0[1-9]|[1-9]\d)[- ]?(?:000[1-9]|00[1-9]\d|0[1-9]\d{2}|[1-9]\d{3})\b",
    "Non-loopback IPv4 address": rf"\b(?:25[0-4]|2[0-4]\d|1[013-9]\d|12[0-689]|0\d\d|\d\d|[1-9])(?:\.{_OCTET}){{3}}\b",
}


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    """A SELECT over VALUES; columns column0, column1, ..."""
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(text(x) if isinstance(x, str) else f"{x}::BIGINT" for x in r) + ")" for r in rows) + ") AS v(" + ", ".join(f"column{i}" for i in range(len(rows[0]))) + ")"


def names(xs: list[str]) -> str:
    return "(" + ", ".join(map(text, xs)) + ")"


def regex(d: Detector) -> str:
    return text(_WITHOUT_LOOKAHEAD.get(d.name, d.regex))


def matches(d: Detector, line: str = "text") -> str:
    return f"regexp_matches({line}, {regex(d)})"


def value(d: Detector, line: str = "text") -> str:
    return f"regexp_extract({line}, {regex(d)}, {d.group})"


def entropy(x: str) -> str:
    p = f"((length({x}) - length(replace({x}, c, ''))) / length({x})::DOUBLE)"
    return f"(CASE WHEN {x} = '' THEN 0.0::DOUBLE ELSE list_sum(list_transform(list_distinct(string_split({x}, '')), lambda c: -{p} * log2({p}))) END)"


def rounded(x: str) -> str:
    return f"round_even({x}, 2)::DOUBLE"


def redact_secret(x: str) -> str:
    return f"(CASE WHEN length({x}) <= 4 THEN '****' ELSE left({x}, 4) || '****' END)"


def redact_personal(d: Detector, x: str) -> str:
    if "Email" in d.name:
        return f"(CASE WHEN contains({x}, '@') THEN '****@' || substr({x}, position('@' in {x}) + 1) ELSE '[REDACTED:EMAIL]' END)"
    if "Phone" in d.name or "Credit card" in d.name:
        digits = f"regexp_replace({x}, '\\D', '', 'g')"
        return f"(CASE WHEN length({digits}) >= 4 THEN '****' || right({digits}, 4) ELSE '****' END)"
    return text(f"[REDACTED:{d.name.split()[0].upper()}]")


def looks_like_value(x: str) -> str:
    has = lambda p: f"regexp_matches({x}, {text(p)})"
    return f"(NOT contains({x}, '/') AND NOT contains({x}, '\\') AND NOT ({has(r'^\pL+$')} AND {has(r'\p{Ll}')} AND NOT {has(r'\p{Lu}|\p{Lt}')}) AND ({has(DIGIT)} OR ({has(r'\p{Lu}')} AND {has(r'\p{Ll}')})))"


_SPLIT = "string_split(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), chr(10))"


def _numbered(source: str, key: str, body: str) -> str:
    """key, line, text of each line of `body`."""
    parts = _SPLIT.format(x=body)
    cut = f"(CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END)"
    return f"SELECT {key}, unnest(range(1, len(parts) + 1))::BIGINT AS line, unnest(parts) AS text FROM (SELECT {key}, {cut} AS parts FROM {source})"


LINES = f"WITH lines AS ({_numbered('documents', 'doc_id', 'text')}) "
_DELIMITERS = text(r"""[\s="',:{}\[\]()]+""")
TOKENS = LINES[:-1] + f", tokens AS (SELECT doc_id, line, regexp_split_to_array(text, {_DELIMITERS}) AS toks FROM lines), long_tokens AS (SELECT * FROM (SELECT doc_id, line, unnest(toks) AS token FROM tokens) WHERE length(token) >= 10) "


def lines_of(rows: list[tuple]) -> str:
    """Samples as lines: id, file, text."""
    return f"WITH lines AS (SELECT column0 AS id, column1 AS file, column2 AS text FROM ({values(rows)})) "


def basename(p: str) -> str:
    return f"regexp_extract({p}, '([^/]*)/*$', 1)"


def suffix(p: str) -> str:
    return f"regexp_extract({basename(p)}, '^\\.*[^.].*(\\.[^.]+)$', 1)"


def extension(p: str) -> str:
    return f"lower({suffix(p)})"


def _any(p: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({p}, {text(x)})" for x in parts) + ")"


def route(p: str) -> str:
    ext, slashed = extension(p), f"replace({p}, '\\', '/')"
    return (
        f"(CASE WHEN {ext} IN {names(BINARY)} THEN 'binary' WHEN {ext} NOT IN {names(SUPPORTED)} THEN 'skipped' WHEN {ext} = '.ipynb' THEN 'notebook' WHEN {_any(slashed, IDE_PARTS)} THEN 'ide' "
        f"WHEN {_any(slashed, VCR_PARTS)} AND (contains({slashed}, 'cassette') OR contains(lower({slashed}), 'vcr')) THEN 'vcr' WHEN {_any(slashed, FIXTURE_PARTS)} THEN 'fixture' "
        f"WHEN {ext} = '.env' OR starts_with(lower({basename(p)}), '.env') THEN 'env' ELSE 'default' END)"
    )


def binary(rows: list[tuple]) -> str:
    ext = suffix("column0")
    said = f"'Binary build artifact (' || {ext} || ') staged for commit. Binary files may contain embedded secrets that are invisible to text scanners. Add this extension to .gitignore.'"
    return f"SELECT column0 AS file, 0::BIGINT AS line, 'P-06' AS type, 'HIGH' AS severity, {ext} || '****' AS match_redacted, {said} AS description, 'payload' AS source, 0.0::DOUBLE AS entropy FROM ({values(rows)}) WHERE {route('column0')} = 'binary'"


def one_detector(d: Detector) -> str:
    redacted = redact_secret(value(d)) if d in SECRETS else redact_personal(d, value(d))
    return f"SELECT doc_id, line, {text(d.severity)} AS severity, {redacted} AS match_redacted FROM lines WHERE {matches(d)}"


def _secrets(key: str, source: str, env: str) -> str:
    """For each type the first detector that matches a line."""
    out = []
    for kind in dict.fromkeys(d.type for d in SECRETS):
        of = [d for d in SECRETS if d.type == kind]
        case = lambda what: "CASE " + " ".join(f"WHEN {matches(d)} THEN {what(d)}" for d in of) + " END"  # noqa: B023, E731
        gate = f" AND {env}" if kind == "P-02" else ""
        out.append(f"SELECT {key}, {text(kind)} AS type, {case(lambda d: text(d.severity))} AS severity, {case(value)} AS value, {case(lambda d: text(d.description))} AS description FROM {source} WHERE ({' OR '.join(map(matches, of))}){gate}")
    return f"SELECT {key}, type, severity, {redact_secret('value')} AS match_redacted, description, {rounded(entropy('value'))} AS entropy FROM ({' UNION ALL '.join(out)})"


def secret_findings(key: str) -> str:
    return _secrets(key, "lines", f"contains(lower({basename('file')}), '.env')")


def _entropies(key: str, source: str) -> str:
    first = f"list_filter(regexp_split_to_array(text, {_DELIMITERS}), lambda t: length(t) >= 23 AND {looks_like_value('t')} AND {entropy('t')} > 4.5)[1]"
    score = entropy("tok")
    said = f"'High-entropy string detected (entropy score: ' || format('{{:.2f}}', {rounded(score)}) || ', threshold: 4.5). Likely a hardcoded secret.'"
    return f"SELECT {key}, 'P-01' AS type, 'HIGH' AS severity, left(tok, 4) || '****' AS match_redacted, {said} AS description, 'payload' AS source, {rounded(score)} AS entropy FROM (SELECT {key}, {first} AS tok FROM {source}) WHERE tok IS NOT NULL"


ENTROPY_FINDINGS = _entropies("id", "lines")


def _personal(key: str, source: str) -> str:
    return " UNION ALL ".join(f"SELECT {key}, {i} AS ord, {text(d.severity)} AS severity, {redact_personal(d, value(d))} AS match_redacted, {text(d.description)} AS description FROM {source} WHERE {matches(d)}" for i, d in enumerate(PERSONAL))


def personal_findings(key: str) -> str:
    return f"SELECT {key}, severity, match_redacted, description FROM ({_personal(key, 'lines')})"


def first_label(key: str) -> str:
    return f"SELECT {key}, severity, match_redacted, description FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ord) AS n FROM ({_personal(key, 'lines')})) WHERE n = 1"


_HAS_PII = "(" + " OR ".join(matches(d) for d in PERSONAL) + ")"
_PER_FILE = f"SELECT file, count(*)::BIGINT AS n_lines, sum(CASE WHEN {_HAS_PII} THEN 1 ELSE 0 END)::BIGINT AS n_pii_lines FROM lines WHERE {route('file')} IN ('vcr', 'fixture') GROUP BY file"
DENSITY = f"SELECT *, round_even(n_pii_lines / n_lines::DOUBLE, 4) AS density FROM ({_PER_FILE})"


def _scan(lines: str) -> str:
    """All findings of `lines` (file, line, text): secrets, entropy, personal data; escalated; one of a type on a line."""
    env = f"contains(lower({basename('file')}), '.env')"
    return f"""
    WITH src AS ({lines}), routed AS (SELECT *, {route('file')} AS route FROM src),
    secret AS ({_secrets('file, line, route', 'routed', env)}),
    high AS (SELECT * FROM ({_entropies('file, line, route', 'routed')}) AS e WHERE NOT EXISTS (SELECT 1 FROM secret s WHERE s.file = e.file AND s.line = e.line)),
    pii AS ({_personal('file, line, route', "(SELECT * FROM routed WHERE route IN ('vcr', 'fixture'))")}),
    share AS (SELECT file, sum(CASE WHEN {_HAS_PII} THEN 1 ELSE 0 END) / count(*)::DOUBLE AS share FROM routed WHERE route IN ('vcr', 'fixture') GROUP BY file),
    found AS (
        SELECT file, line, CASE route WHEN 'ide' THEN 'P-08' ELSE type END AS type, severity, match_redacted, description, entropy, 0 AS phase, CASE type WHEN 'P-01' THEN 1 WHEN 'P-02' THEN 2 WHEN 'P-07' THEN 3 ELSE 4 END AS ord FROM secret
        UNION ALL SELECT file, line, type, severity, match_redacted, description, entropy, 1, 0 FROM high
        UNION ALL SELECT file, line, 'P-04', severity, match_redacted, description, 0.0, 2, ord FROM pii),
    up AS (SELECT f.*, s.share, (s.share >= 0.2 AND type IN ('P-04', 'P-07') AND severity = 'MEDIUM') AS up FROM found f LEFT JOIN share s USING (file)),
    one AS (SELECT *, row_number() OVER (PARTITION BY file, line, type ORDER BY phase, ord) AS n FROM up)
    SELECT file, line, type, CASE WHEN up THEN 'HIGH' ELSE severity END AS severity, match_redacted,
        CASE WHEN up THEN description || ' [escalated: ' || round_even(share * 100, 0)::BIGINT || '% of file is PII]' ELSE description END AS description,
        'payload' AS source, entropy::DOUBLE AS entropy FROM one WHERE n = 1"""


_OF_SAMPLES = "SELECT file, id AS line, text FROM lines"
SAMPLE_SCAN = f"SELECT file, line, type, severity, match_redacted, description, entropy FROM ({_scan(_OF_SAMPLES)})"
ESCALATED = f"SELECT file, line, type, severity, match_redacted, description FROM ({_scan(_OF_SAMPLES)})"
_FILE = "(CASE doc_id % 4 WHEN 0 THEN 'src/' WHEN 1 THEN 'fixtures/' WHEN 2 THEN 'cassettes/' ELSE 'app/' END || doc_id || '.txt')"
SCAN_DOCUMENTS = f"SELECT * FROM ({_scan(f'SELECT {_FILE} AS file, line, text FROM ({_numbered("documents", "doc_id", "text")})')})"
PAGE_SCAN = f"SELECT * FROM ({_scan(f"SELECT 'fixtures/' || page_id || '.txt' AS file, line, text FROM ({_numbered('pages', 'page_id', 'html')})")})"

#: at every line end that Unicode knows
_CELL_PARTS = "string_split(regexp_replace(text, '\\r\\n|[\\r\\n\\x{b}\\x{c}\\x{1c}-\\x{1e}\\x{85}\\x{2028}\\x{2029}]', chr(10), 'g'), chr(10))"
NOTEBOOK_LINES = f"""WITH cells AS (SELECT conv_id || '.ipynb' AS file, turn, '[Cell ' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) || '/' || role || '] ' AS cell,
    CASE WHEN {_CELL_PARTS}[-1] = '' THEN {_CELL_PARTS}[:-2] ELSE {_CELL_PARTS} END AS parts FROM conversations),
    flat AS (SELECT file, turn, cell, unnest(range(1, len(parts) + 1)) AS pos, unnest(parts) AS text FROM cells),
    nb AS (SELECT file, cell, text, row_number() OVER (PARTITION BY file ORDER BY turn, pos)::BIGINT AS line FROM flat) """


def notebook_findings() -> str:
    rows = samples.SECRET_LINES + [(100 + i, f, t) for i, f, t in samples.PERSONAL_LINES]
    return f"""
    WITH lines AS (SELECT 'all.ipynb' AS file, sum(CASE WHEN column2 = '' THEN 0 ELSE 1 END) OVER (ORDER BY column0)::BIGINT AS line, '[Cell ' || row_number() OVER (ORDER BY column0) || '/code] ' AS cell, column2 AS text FROM ({values(rows)})),
    full_lines AS (SELECT * FROM lines WHERE text <> ''),
    secret AS ({_secrets('file, line, cell', 'full_lines', 'false')}),
    found AS (
        SELECT file, line, cell, type, severity, match_redacted, description, 0 AS phase, 0 AS ord FROM secret
        UNION ALL SELECT file, line, cell, 'P-05', severity, match_redacted, description, 1, 0 FROM ({_entropies('file, line, cell', 'full_lines')}) WHERE line NOT IN (SELECT line FROM secret)
        UNION ALL SELECT file, line, cell, 'P-05', severity, match_redacted, description, 2, ord FROM ({_personal('file, line, cell', 'full_lines')})),
    one AS (SELECT *, row_number() OVER (PARTITION BY file, line, type ORDER BY phase, ord) AS n FROM found)
    SELECT file, line, type, severity, match_redacted, cell || description AS description FROM one WHERE n = 1"""


def notebook_scan() -> str:
    """All findings of conversations as notebooks."""
    return f"""
    {NOTEBOOK_LINES},
    secret AS ({_secrets('file, line, cell', 'nb', 'false')}),
    found AS (
        SELECT file, line, cell, type, severity, match_redacted, description, entropy, 0 AS phase, 0 AS ord FROM secret
        UNION ALL SELECT file, line, cell, 'P-05', severity, match_redacted, description, entropy, 1, 0 FROM ({_entropies('file, line, cell', 'nb')}) e WHERE NOT EXISTS (SELECT 1 FROM secret s WHERE s.file = e.file AND s.line = e.line)
        UNION ALL SELECT file, line, cell, 'P-05', severity, match_redacted, description, 0.0, 2, ord FROM ({_personal('file, line, cell', 'nb')})),
    one AS (SELECT *, row_number() OVER (PARTITION BY file, line, type ORDER BY phase, ord) AS n FROM found)
    SELECT file, line, type, severity, match_redacted, cell || description AS description, 'payload' AS source, entropy::DOUBLE AS entropy FROM one WHERE n = 1"""


def probe_secrets() -> str:
    return f"SELECT doc_id::VARCHAR AS target, line, type, match_redacted FROM ({_secrets('doc_id, line', 'lines', 'true')})"


#: documents as files of which every third is missing and every third is no notebook
ERRORS = "SELECT 'n/' || doc_id || (CASE doc_id % 3 WHEN 1 THEN '.ipynb' ELSE '.txt' END) AS file, (CASE doc_id % 3 WHEN 1 THEN 'parse' ELSE 'open' END) AS stage FROM documents WHERE doc_id % 3 <> 2"
SCAN_ODD = _scan(f"SELECT {_FILE} AS file, line, text FROM ({_numbered('(SELECT * FROM documents WHERE doc_id % 5 <> 0)', 'doc_id', 'text')})")


def redact_personal_rows() -> str:
    return " UNION ALL ".join(f"SELECT id, {text(d.name)} AS label, {redact_personal(d, 'text')} AS redacted FROM lines" for d in PERSONAL)


def pattern_join(detectors: list[Detector]) -> str:
    hits = " UNION ALL ".join(f"SELECT doc_id, line, {i} AS ord, {text(d.name)} AS name FROM lines WHERE {matches(d)}" for i, d in enumerate(detectors) if d.type == "P-01")
    return f"SELECT doc_id, line, arg_min(name, ord) AS name, count(*)::BIGINT AS n_patterns FROM ({hits}) GROUP BY doc_id, line"


def graph(where: str, starts: str) -> str:
    return f"""WITH RECURSIVE nodes AS (SELECT 'n' || n_nationkey AS id, CASE n_regionkey WHEN 0 THEN 'test' WHEN 1 THEN 'prod' ELSE 'dev' END AS env FROM nation),
    all_edges AS (SELECT 'n' || n_nationkey AS src, 'n' || (n_nationkey + 1) AS dst, 'CALLS' AS edge_type FROM nation WHERE n_nationkey % 5 <> 4
        UNION ALL SELECT 'n' || n_nationkey, 'n' || (n_nationkey // 2), 'DEPENDS_ON' FROM nation WHERE n_nationkey > 0),
    edges AS (SELECT DISTINCT src, dst FROM all_edges {where}),
    walk(start, node, hops, path) AS (
        SELECT id, id, 0, [id] FROM ({starts})
        UNION ALL SELECT w.start, e.dst, w.hops + 1, list_append(w.path, e.dst) FROM walk w JOIN edges e ON e.src = w.node WHERE NOT list_contains(w.path, e.dst)) """
