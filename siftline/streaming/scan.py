"""The scan over a stream of texts: stateless, since a file is a record and density is a file's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.scan import first_of_type, scan_secrets
from siftline.operators.findings import COLUMNS, binary_findings, density, escalated, line_findings, personal_of, split_lines
from siftline.operators.routing import PLAIN_ROUTES, env_file
from siftline.sources.tables import routed_texts, unwrapped


def scan_stream(texts: DataFrame, file: Column, text: Column) -> DataFrame:
    """Findings of each arriving row, as `scan_texts` has them of a table. All lines of a row are looked at in array functions, so no state is kept; a binary that arrives again is found again."""
    files = routed_texts(texts, file, text)
    none = F.lit(None).cast("string").alias("cell")
    plain = files.filter(F.col("route").isin(*PLAIN_ROUTES)).select("file", "route", F.transform(split_lines(F.col("text")), lambda x: F.struct(none, x.alias("text"))).alias("lines"))
    cells = files.filter("route = 'notebook'").select("file", "route", unwrapped("text")["lines"].alias("lines"))
    route = F.col("route")
    # each lambda's argument is made once
    known = F.transform("lines", lambda x: F.struct(x["text"].alias("text"), x["cell"].alias("cell"), scan_secrets(x["text"], env_file(F.col("file"))).alias("secret"), personal_of(x["text"], route).alias("pii")))
    scanned = plain.unionByName(cells).select("file", "route", known.alias("lines"))
    share = density(F.size(F.filter("lines", lambda x: F.size(x["pii"]) > 0)).cast("double"), F.size("lines"))
    found = F.transform("lines", lambda x: line_findings(x["text"], route, x["cell"], x["secret"], x["pii"]))
    each = scanned.select("file", share.alias("share"), route.isin("vcr", "fixture").alias("where"), F.posexplode(found).alias("pos", "found")).filter(F.size("found") > 0)
    all_ = first_of_type(escalated(F.col("found"), F.col("share"), F.col("where")))
    return each.select("file", (F.col("pos") + 1).cast("long").alias("line"), F.inline(all_)).select(*COLUMNS).unionByName(binary_findings(files.filter("route = 'binary'").select("file")))
