"""A query for each operator over the driver's tables, with the same said in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.detectors import PERSONAL, SECRETS, Detector, build_detectors, java
from siftline.functions.scan import folded, hit, may_match, scan_entropy, scan_personal, scan_secrets
from siftline.functions.text import LEAST_TOKEN, entropy, half_even, looks_like_value, redact_personal, redact_secret, tokens
from siftline.operators.findings import binary_findings, deduplicated, density, per_file, scan_lines, split_lines
from siftline.operators.routing import BINARY, SUPPORTED, basename, env_file, extension, route
from siftline.plans import oracles as sql
from siftline.plans import samples
from siftline.plans.graph import import_chains, patched, reachable, read_graph, taint
from siftline.plans.probes import present, secrets_in
from siftline.plans.scan import rollup, scan_cells, scan_files, scan_texts
from siftline.plans.shared import shared_path, written
from siftline.sources.diffs import diff_lines
from siftline.sources.files import bounded_batches
from siftline.streaming.scan import scan_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str) -> Callable[[Query], Query]:
    def kept(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return kept


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line, text of documents."""
    return _cut(_table(spark, sf_dir, "documents"))


def _cut(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(split_lines(F.col("text"))).alias("pos", "text")).select("doc_id", (F.col("pos") + 1).cast("long").alias("line"), "text")


def _samples(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "id bigint, file string, text string")


def _file() -> Column:
    """A path for a document, by which all four kinds of text route occur."""
    d = F.col("doc_id")
    return F.concat(F.when(d % 4 == 0, "src/").when(d % 4 == 1, "fixtures/").when(d % 4 == 2, "cassettes/").otherwise("app/"), d.cast("string"), F.lit(".txt"))


def _of(name: str) -> Detector:
    return next(d for d in [*SECRETS, *PERSONAL] if d.name == name)


@query(sql.LINES + "SELECT doc_id, line, length(text)::BIGINT AS n_chars FROM lines")
def line_explode(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line", F.length("text").cast("long").alias("n_chars"))


@query(sql.TOKENS + "SELECT doc_id, line, len(toks)::BIGINT AS n_tokens, len(list_filter(toks, lambda t: length(t) >= 10))::BIGINT AS n_long FROM tokens")
def tokenize(spark, sf_dir):
    parts = _lines(spark, sf_dir).select("doc_id", "line", tokens(F.col("text")).alias("toks"))
    return parts.select("doc_id", "line", F.size("toks").cast("long").alias("n_tokens"), F.size(F.filter("toks", lambda t: F.length(t) >= LEAST_TOKEN)).cast("long").alias("n_long"))


def _long_tokens(spark, sf_dir):
    parts = _lines(spark, sf_dir).select("doc_id", "line", F.explode(tokens(F.col("text"))).alias("token"))
    return parts.filter(F.length("token") >= LEAST_TOKEN)


@query(sql.TOKENS + f"SELECT doc_id, line, token, round_even({sql.entropy('token')}, 4) AS entropy FROM long_tokens")
def token_entropy(spark, sf_dir):
    return _long_tokens(spark, sf_dir).select("doc_id", "line", "token", half_even(entropy(F.col("token")), 4).alias("entropy"))


@query(sql.TOKENS + f"SELECT doc_id, round_even(max({sql.entropy('token')}), 4) AS max_entropy, count(*)::BIGINT AS n FROM long_tokens GROUP BY doc_id")
def doc_max_entropy(spark, sf_dir):
    return _long_tokens(spark, sf_dir).groupBy("doc_id").agg(half_even(F.max(entropy(F.col("token"))), 4).alias("max_entropy"), F.count(F.lit(1)).alias("n"))


@query(sql.TOKENS + f"SELECT token, {sql.looks_like_value('token')} AS value_like, count(*)::BIGINT AS n FROM (SELECT token FROM long_tokens UNION ALL SELECT column0 FROM ({sql.values([(v,) for v in samples.VALUES])})) GROUP BY token")
def looks_like_value_tokens(spark, sf_dir):
    more = spark.createDataFrame([(v,) for v in samples.VALUES], "token string")
    return _long_tokens(spark, sf_dir).select("token").unionByName(more).groupBy("token").agg(F.count(F.lit(1)).alias("n")).select("token", looks_like_value(F.col("token")).alias("value_like"), "n")


@query(f"SELECT column0 AS value, round_even({sql.entropy('column0')}, 2) AS entropy, {sql.entropy('column0')} > 4.5 AS high FROM ({sql.values([(v,) for v in samples.VALUES])})")
def value_entropy(spark, sf_dir):
    rows = spark.createDataFrame([(v,) for v in samples.VALUES], "value string")
    return rows.select("value", half_even(entropy(F.col("value"))).alias("entropy"), (entropy(F.col("value")) > F.lit(4.5)).alias("high"))


@query(f"SELECT column0 AS value, {sql.redact_secret('column0')} AS redacted FROM ({sql.values([(v,) for v in samples.VALUES])})")
def redact_secret_values(spark, sf_dir):
    return spark.createDataFrame([(v,) for v in samples.VALUES], "value string").select("value", redact_secret(F.col("value")).alias("redacted"))


@query(sql.lines_of(samples.SECRET_LINES) + sql.ENTROPY_FINDINGS)
def entropy_findings(spark, sf_dir):
    return _samples(spark, samples.SECRET_LINES).select("id", F.inline(scan_entropy(F.col("text"))))


@query(sql.lines_of(samples.SECRET_LINES) + sql.secret_findings("id"))
def secret_first_per_type(spark, sf_dir):
    return _samples(spark, samples.SECRET_LINES).select("id", F.inline(scan_secrets(F.col("text"), env_file(F.col("file"))))).select("id", "type", "severity", "match_redacted", "description", "entropy")


@query(sql.LINES + sql.one_detector(_of("secret-or-token")))
def secret_token_documents(spark, sf_dir):
    return _one(spark, sf_dir, _of("secret-or-token"))


def _one(spark: SparkSession, sf_dir: str, d: Detector) -> DataFrame:
    value = F.regexp_extract("text", java(d.regex), d.group)
    redacted = redact_secret(value) if d in SECRETS else redact_personal(value, d.name)
    return _lines(spark, sf_dir).filter(F.regexp_like("text", F.lit(java(d.regex)))).select("doc_id", "line", F.lit(d.severity).alias("severity"), redacted.alias("match_redacted"))


@query(sql.LINES + sql.one_detector(PERSONAL[0]))
def pii_email(spark, sf_dir):
    return _one(spark, sf_dir, PERSONAL[0])


@query(sql.LINES + sql.one_detector(PERSONAL[2]))
def pii_credit_card(spark, sf_dir):
    return _one(spark, sf_dir, PERSONAL[2])


@query(sql.LINES + sql.one_detector(PERSONAL[3]))
def pii_phone(spark, sf_dir):
    return _one(spark, sf_dir, PERSONAL[3])


@query(sql.LINES + sql.one_detector(PERSONAL[4]))
def pii_ipv4(spark, sf_dir):
    return _one(spark, sf_dir, PERSONAL[4])


@query(sql.LINES + sql.personal_findings("doc_id, line"))
def pii_all_labels(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line", F.inline(scan_personal(F.col("text")))).select("doc_id", "line", "severity", "match_redacted", "description")


@query(sql.lines_of(samples.PERSONAL_LINES) + sql.personal_findings("id"))
def pii_labels_samples(spark, sf_dir):
    return _samples(spark, samples.PERSONAL_LINES).select("id", F.inline(scan_personal(F.col("text")))).select("id", "severity", "match_redacted", "description")


@query(sql.LINES + sql.first_label("doc_id, line"))
def pii_first_label(spark, sf_dir):
    first = F.get(scan_personal(F.col("text")), F.lit(0))
    return _lines(spark, sf_dir).select("doc_id", "line", first.alias("x")).filter("x is not null").select("doc_id", "line", "x.severity", "x.match_redacted", "x.description")


def _sample_files(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """The samples as lines of files, numbered by id."""
    lines = _samples(spark, rows).select("file", route(F.col("file")).alias("route"), F.col("id").alias("line"), "text", F.lit(None).cast("string").alias("cell"))
    return per_file(scan_lines(lines))


@query(sql.lines_of(samples.PERSONAL_LINES) + sql.DENSITY)
def pii_density(spark, sf_dir):
    files = _sample_files(spark, samples.PERSONAL_LINES).filter("route in ('vcr', 'fixture')")
    return files.select("file", "n_lines", "n_pii_lines", half_even(density(F.col("n_pii_lines"), F.col("n_lines")), 4).alias("density"))


@query(sql.lines_of(samples.PERSONAL_LINES) + sql.ESCALATED)
def density_escalation(spark, sf_dir):
    from siftline.operators.findings import findings

    return findings(_sample_files(spark, samples.PERSONAL_LINES)).select("file", "line", "type", "severity", "match_redacted", "description")


@query(f"SELECT column0 AS path, {sql.extension('column0')} AS ext, {sql.basename('column0')} AS base, {sql.route('column0')} AS route FROM ({sql.values([(p,) for p in samples.PATHS])})")
def route_classify(spark, sf_dir):
    rows = spark.createDataFrame([(p,) for p in samples.PATHS], "path string")
    return rows.select("path", extension(F.col("path")).alias("ext"), basename(F.col("path")).alias("base"), route(F.col("path")).alias("route"))


@query(f"SELECT column0 AS path FROM ({sql.values([(p,) for p in samples.PATHS])}) WHERE {sql.extension('column0')} IN {sql.names(SUPPORTED)}")
def extension_guard_semi(spark, sf_dir):
    known = spark.createDataFrame([(x,) for x in SUPPORTED], "ext string")
    rows = spark.createDataFrame([(p,) for p in samples.PATHS], "path string").withColumn("ext", extension(F.col("path")))
    return rows.join(F.broadcast(known), "ext", "left_semi").select("path")


@query(f"SELECT column0 AS path FROM ({sql.values([(p,) for p in samples.PATHS])}) WHERE {sql.extension('column0')} NOT IN {sql.names(SUPPORTED)} AND {sql.extension('column0')} NOT IN {sql.names(BINARY)}")
def extension_guard_anti(spark, sf_dir):
    known = spark.createDataFrame([(x,) for x in SUPPORTED + BINARY], "ext string")
    rows = spark.createDataFrame([(p,) for p in samples.PATHS], "path string").withColumn("ext", extension(F.col("path")))
    return rows.join(F.broadcast(known), "ext", "left_anti").select("path")


@query(sql.binary([(p,) for p in samples.PATHS]))
def binary_artifact(spark, sf_dir):
    rows = spark.createDataFrame([(p,) for p in samples.PATHS], "file string")
    return binary_findings(rows.filter(route(F.col("file")) == "binary"))


@query(f"SELECT column0 AS path, contains(lower({sql.basename('column0')}), '.env') AS env_file FROM ({sql.values([(p,) for p in samples.PATHS])})")
def env_gate(spark, sf_dir):
    return spark.createDataFrame([(p,) for p in samples.PATHS], "path string").select("path", env_file(F.col("path")).alias("env_file"))


@query(sql.lines_of(samples.SECRET_LINES) + sql.SAMPLE_SCAN)
def findings_union_all(spark, sf_dir):
    """Secrets, entropy where no secret is, retyped on IDE files; one of a type on a line."""
    from siftline.operators.findings import findings

    return findings(_sample_files(spark, samples.SECRET_LINES)).select("file", "line", "type", "severity", "match_redacted", "description", "entropy")


@query(sql.lines_of(samples.SECRET_LINES) + "SELECT * FROM (" + sql.SAMPLE_SCAN + ") WHERE contains(file, '.vscode')")
def ide_retag(spark, sf_dir):
    return findings_union_all(spark, sf_dir).filter(F.col("file").contains(".vscode"))


@query(sql.lines_of(samples.SECRET_LINES) + f"SELECT id FROM lines WHERE id NOT IN (SELECT id FROM ({sql.secret_findings('id')})) AND id IN (SELECT id FROM ({sql.ENTROPY_FINDINGS}))")
def entropy_without_secret(spark, sf_dir):
    rows = _samples(spark, samples.SECRET_LINES)
    flagged = rows.filter(F.size(scan_secrets(F.col("text"), env_file(F.col("file")))) > 0)
    return rows.filter(F.size(scan_entropy(F.col("text"))) > 0).join(flagged, "id", "left_anti").select("id")


@query("SELECT file, line, type, match_redacted FROM (SELECT *, row_number() OVER (PARTITION BY file, line, type ORDER BY phase, ord) AS n FROM (SELECT 'f' || (l_orderkey % 50) AS file, l_linenumber::BIGINT AS line, 'P-0' || (l_suppkey % 3) AS type, l_quantity::BIGINT AS phase, l_orderkey * 10 + l_linenumber AS ord, 'm' || l_orderkey AS match_redacted FROM lineitem)) WHERE n = 1")
def dedup_first(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("f"), (F.col("l_orderkey") % 50).cast("string")).alias("file"), F.col("l_linenumber").cast("long").alias("line"), F.concat(F.lit("P-0"), (F.col("l_suppkey") % 3).cast("string")).alias("type"),
        F.col("l_quantity").cast("long").alias("phase"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.concat(F.lit("m"), F.col("l_orderkey").cast("string")).alias("match_redacted"),
    )
    return deduplicated(rows, ["phase", "ord"]).select("file", "line", "type", "match_redacted")


@query(sql.NOTEBOOK_LINES + "SELECT file, line, cell, length(text)::BIGINT AS n_chars FROM nb")
def notebook_virtual_lines(spark, sf_dir):
    from siftline.sources.tables import cells_of

    return cells_of(_table(spark, sf_dir, "conversations"), *_notebook()).select("file", "line", "cell", F.length("text").cast("long").alias("n_chars"))


def _notebook() -> tuple[Column, ...]:
    return F.concat(F.col("conv_id").cast("string"), F.lit(".ipynb")), F.col("turn"), F.col("role"), F.col("text")


@query(sql.notebook_findings())
def notebook_findings(spark, sf_dir):
    cells = _samples(spark, samples.SECRET_LINES + [(100 + i, f, t) for i, f, t in samples.PERSONAL_LINES])
    found = scan_cells(cells, F.lit("all.ipynb"), F.col("id"), F.lit("code"), F.col("text"))
    return found.select("file", "line", "type", "severity", "match_redacted", "description")


@query(sql.lines_of(samples.PERSONAL_LINES) + sql.redact_personal_rows())
def redact_pii_values(spark, sf_dir):
    from functools import reduce

    rows = _samples(spark, samples.PERSONAL_LINES)
    return reduce(DataFrame.unionByName, (rows.select("id", F.lit(d.name).alias("label"), redact_personal(F.col("text"), d.name).alias("redacted")) for d in PERSONAL))


@query(sql.SCAN_DOCUMENTS)
def scan_documents(spark, sf_dir):
    """The flagship: documents as files on all routes."""
    return scan_texts(_table(spark, sf_dir, "documents"), _file(), F.col("text"))


def _files(spark: SparkSession, rows: DataFrame) -> tuple[str, DataFrame]:
    """Writes `rows` (name, text) as files under a new folder that all tasks see: the folder, and names with their places in it."""
    folder = shared_path(spark, "files")

    def put(batches):
        from pyarrow import fs

        for batch in batches:
            for name, text in zip(batch.column("name"), batch.column("text"), strict=True):
                path = f"{folder}/{name}"
                store, inner = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
                store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(inner) as f:
                    f.write(text.as_buffer() or b"")
            yield batch.select(["name"])

    bounded_batches(spark)
    named = written(rows.mapInArrow(put, "name string"), "names")
    return folder, named.select("name", F.concat(F.lit(folder + "/"), "name").alias("file"))


def _inside(df: DataFrame, folder: str) -> DataFrame:
    """The places of files as names under the folder."""
    return df.withColumn("file", F.substring("file", len(folder) + 2, 1 << 30))


@query(sql.SCAN_DOCUMENTS)
def scan_paths(spark, sf_dir):
    """Documents as real files, found by path: opened, decoded, cut into lines and scanned by the tasks."""
    folder, named = _files(spark, _table(spark, sf_dir, "documents").select(_file().alias("name"), "text"))
    found, _ = scan_files(spark, named.select(F.lit(0).cast("long").alias("file_ord"), "file"))
    return _inside(found, folder)


@query(sql.ERRORS)
def scan_errors(spark, sf_dir):
    """Faults stay with their file: of documents as files every third is missing, and every third no notebook."""
    d = F.col("doc_id")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    name = F.concat(F.lit("n/"), d.cast("string"), F.when(d % 3 == 1, ".ipynb").otherwise(".txt"))
    folder, named = _files(spark, docs.filter(d % 3 != 0).select(name.alias("name"), F.concat(F.lit("no notebook: "), F.col("text")).alias("text")))
    gone = docs.filter(d % 3 == 0).select(F.concat(F.lit(f"{folder}/"), name).alias("file"))
    _, errors = scan_files(spark, named.select("file").unionByName(gone).select(F.lit(0).cast("long").alias("file_ord"), "file"))
    return _inside(errors, folder).select("file", "stage")


@query(f"SELECT *, row_number() OVER (ORDER BY try_cast(regexp_extract(file, '([0-9]+)', 1) AS BIGINT) DESC, line, type)::BIGINT AS pos FROM ({sql.SCAN_DOCUMENTS})")
def ordered_findings(spark, sf_dir):
    """Findings in the order of the paths given, here the largest id first."""
    from pyspark.sql import Window as W

    paths = _table(spark, sf_dir, "documents").select((-F.col("doc_id")).cast("long").alias("file_ord"), _file().alias("file"))
    found = scan_documents(spark, sf_dir)
    # a report in one order is one task's, of findings alone
    return found.join(paths.groupBy("file").agg(F.min("file_ord").alias("file_ord")), "file").withColumn("pos", F.row_number().over(W.orderBy("file_ord", "line", "type")).cast("long")).drop("file_ord")


@query(sql.notebook_scan())
def scan_notebook_json(spark, sf_dir):
    """Conversations as notebooks in JSON, a row each, with turns as cells, strings and lists as sources, and outputs."""
    turn = F.struct("turn", F.struct(F.col("role").alias("cell_type"), F.coalesce("text", F.lit("")).alias("source")).alias("cell"))
    books = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(turn)), lambda x: x["cell"]).alias("cells"))).alias("text"))
    return scan_texts(books, F.concat(F.col("conv_id").cast("string"), F.lit(".ipynb")), F.col("text"))


@query(f"SELECT DISTINCT file, 0::BIGINT AS line, 'P-06' AS type FROM (SELECT 'lib/' || doc_id || '.jar' AS file FROM documents WHERE doc_id % 5 = 0) UNION ALL SELECT file, line, type FROM ({sql.SCAN_ODD})")
def scan_mixed_table(spark, sf_dir):
    """A table whose rows are texts and, every fifth, binaries, which are found by name."""
    file = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("lib/"), F.col("doc_id").cast("string"), F.lit(".jar"))).otherwise(_file())
    return scan_texts(_table(spark, sf_dir, "documents"), file, F.col("text")).select("file", "line", "type")


@query(sql.SCAN_DOCUMENTS)
def scan_documents_stream(spark, sf_dir):
    """The scan as a stream of what is there, written out and read back."""
    out, docs = shared_path(spark, "stream"), _table(spark, sf_dir, "documents")
    stream = spark.readStream.schema(docs.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/documents.parquet*")
    found = scan_stream(stream, _file(), F.col("text"))
    found.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(found.schema).parquet(out)


@query(sql.LINES + "SELECT doc_id, line, 'X-01' AS type, 'LOW' AS severity, left(v, 4) || (CASE WHEN length(v) <= 4 THEN '' ELSE '****' END) AS match_redacted FROM (SELECT doc_id, line, regexp_extract(text, '([A-Z][a-z]{7,})\\.$', 1) AS v FROM lines WHERE regexp_matches(text, '([A-Z][a-z]{7,})\\.$'))")
def own_detectors(spark, sf_dir):
    """A registry of one's own; a record whose pattern doesn't compile is left out."""
    own = build_detectors([{"name": "word", "regex": r"([A-Z][a-z]{7,})\.$", "description": "a word", "severity": "LOW", "type": "X-01"}, {"name": "broken", "regex": "(", "description": "", "severity": "LOW", "type": "X-02"}])
    return _lines(spark, sf_dir).select("doc_id", "line", F.inline(scan_secrets(F.col("text"), detectors=own))).select("doc_id", "line", "type", "severity", "match_redacted")


@query("SELECT 'r/' || r_regionkey || '.py' AS file, (r_regionkey + 1)::BIGINT AS line, 'token = \"' || r_name || '\"' AS text FROM region WHERE r_regionkey % 2 = 0 UNION ALL SELECT 'r/' || r_regionkey || '.py', (r_regionkey + 3)::BIGINT, '+ more' FROM region WHERE r_regionkey % 2 = 0")
def diff_added_lines(spark, sf_dir):
    """Added lines of a diff, with their numbers in the new file: a hunk for each region, every second one of a picture."""
    regions = _table(spark, sf_dir, "region").select("r_regionkey", "r_name").orderBy("r_regionkey").collect()  # a diff is one text
    diff = ""
    for k, name in regions:
        path = f"r/{k}.py" if k % 2 == 0 else f"r/{k}.png"
        diff += f'diff --git a/{path} b/{path}\n--- a/{path}\n+++ b/{path}\n@@ -{k + 1},2 +{k + 1},4 @@\n+token = "{name}"\n kept\n-gone\n++ more\n'
    return diff_lines(spark, diff).select("file", "line", "text")


@query("SELECT 'file-present' AS probe, column0 AS target, column1 AS output FROM (VALUES ('/', 'true'), ('/none/such', 'false')) AS v(column0, column1)")
def probe_files(spark, sf_dir):
    return present(spark, ["/", "/none/such"])


@query(sql.LINES + sql.probe_secrets())
def probe_texts(spark, sf_dir):
    """Secrets in the lines of given files, here documents; detectors of environment files apply."""
    texts = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("target"), "text")
    return secrets_in(texts).select("target", "line", "type", "match_redacted")


@query("SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey AS file FROM nation")
def graph_json(spark, sf_dir):
    """Nodes of a graph file: JSON with an array of nodes and one of edges."""
    nodes, edges = _graph(spark, sf_dir)
    path = shared_path(spark, "graph")
    both = nodes.agg(F.collect_list(F.struct("id", "env", "file")).alias("nodes")).crossJoin(F.broadcast(edges.agg(F.collect_list(F.struct("src", "dst", "edge_type")).alias("edges"))))  # a row each
    both.select(F.to_json(F.struct("nodes", "edges"))).write.text(path)
    return read_graph(spark, path)[0].select("id", "file")


@query(f"SELECT type, severity, count(*)::BIGINT AS n, count(DISTINCT file)::BIGINT AS n_files FROM ({sql.SCAN_DOCUMENTS}) GROUP BY type, severity")
def findings_rollup(spark, sf_dir):
    return rollup(scan_documents(spark, sf_dir))


@query(sql.PAGE_SCAN)
def scan_pages(spark, sf_dir):
    """Long lines: pages as fixtures."""
    pages = _table(spark, sf_dir, "pages")
    return scan_texts(pages, F.concat(F.lit("fixtures/"), F.col("page_id").cast("string"), F.lit(".txt")), F.col("html"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def props_json_get(spark, sf_dir):
    get = lambda k: F.try_variant_get(F.try_parse_json("props"), f"$.{k}", "string")
    return _table(spark, sf_dir, "events").select("event_id", get("k").alias("k"), get("missing").alias("missing"))


@query(sql.LINES + sql.pattern_join(SECRETS))
def pattern_join(spark, sf_dir):
    """Lines joined with all patterns of a type that match them. The registry is known when the plan is made, so the join is an expression on the line: no row of a pattern is ever paired with one of a line."""
    of = [d for d in SECRETS if d.type == "P-01"]
    docs = _table(spark, sf_dir, "documents").filter(may_match(F.col("text"), of))
    lines = _cut(docs).withColumn("fold", folded(F.col("text")))
    hits = F.array_compact(F.array(*(F.when(hit(F.col("text"), d, F.col("fold")), F.lit(d.name)) for d in of)))
    return lines.select("doc_id", "line", hits.alias("names")).filter(F.size("names") > 0).select("doc_id", "line", F.col("names")[0].alias("name"), F.size("names").cast("long").alias("n_patterns"))


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations call the next one, those of the last key depend on half of it; the region decides the environment."""
    nation = _table(spark, sf_dir, "nation")
    key, said = F.col("n_nationkey").cast("long"), lambda k: F.concat(F.lit("n"), k.cast("string"))
    calls = nation.filter(key % 5 != 4).select(said(key).alias("src"), said(key + 1).alias("dst"), F.lit("CALLS").alias("edge_type"))
    needs = nation.filter(key > 0).select(said(key).alias("src"), said(F.floor(key / 2)).alias("dst"), F.lit("DEPENDS_ON").alias("edge_type"))
    nodes = nation.select(said(key).alias("id"), F.when(F.col("n_regionkey") == 0, "test").when(F.col("n_regionkey") == 1, "prod").otherwise("dev").alias("env"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("file"))
    return nodes, calls.unionByName(needs)


@query(sql.graph("", "SELECT id FROM nodes WHERE env = 'test'") + "SELECT start, node, min(hops)::BIGINT AS hops FROM walk WHERE hops > 0 GROUP BY start, node")
def graph_reachability(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return reachable(edges, nodes.filter("env = 'test'").select("id"))


@query(sql.graph("", "SELECT id FROM nodes WHERE env = 'test'") + "SELECT start, node, min(hops)::BIGINT AS hops FROM walk WHERE hops > 0 AND node IN (SELECT id FROM nodes WHERE env = 'prod') GROUP BY start, node")
def graph_taint(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return taint(edges, nodes, ["test"], ["prod"])


@query(sql.graph("WHERE edge_type = 'DEPENDS_ON'", "SELECT id FROM nodes") + "SELECT start, node, min(hops)::BIGINT AS hops FROM walk WHERE hops > 0 GROUP BY start, node")
def graph_import_chains(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return import_chains(edges, nodes.select("id"))


@query("SELECT 'n' || n_nationkey AS id, CASE n_regionkey WHEN 0 THEN 'test' WHEN 1 THEN 'prod' ELSE 'dev' END AS env, 'r' || n_regionkey AS file FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 'new' || n_nationkey, 'dev', 'r2' FROM nation WHERE n_regionkey = 2 AND n_nationkey % 2 = 0")
def graph_patch(spark, sf_dir):
    nodes, _ = _graph(spark, sf_dir)
    changed = _table(spark, sf_dir, "nation").filter("n_regionkey = 2 and n_nationkey % 2 = 0").select(F.concat(F.lit("new"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("dev").alias("env"), F.lit("r2").alias("file"))
    return patched(nodes, changed)
