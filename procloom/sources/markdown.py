"""Markdown files as tables: lines, blocks with heading paths, table cells, front matter, sections and excerpts.

A file is cut into lines, and all context (headings above a line, the run of table lines it is in) comes from
windows over the lines of one file. A heading closes a table; heading levels that are skipped leave no gap in
the path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procloom.functions import columns as C

HEADING = r"^(#{1,6})\s+(.+)$"


def lines(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """doc, line_no (from 1), line of each line of docs."""
    return docs.select(F.col(doc).alias("doc"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("at", "line")).select("doc", (F.col("at") + 1).alias("line_no"), "line")


def _upto() -> Window:
    return Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def with_headings(rows: DataFrame) -> DataFrame:
    """rows (doc, line_no, line) with level (0: no heading) and heading_path, the titles above and on each line."""
    level = F.length(F.regexp_extract("line", HEADING, 1))
    titled = rows.withColumn("level", level).withColumn("title", F.regexp_extract("line", HEADING, 2))
    seen = {k: F.last(F.when(F.col("level") == k, F.struct("line_no", "title")), ignorenulls=True).over(_upto()) for k in range(1, 7)}
    titled = titled.withColumns({f"_{k}": s for k, s in seen.items()})
    slots = []
    for k in range(1, 7):
        above = F.greatest(F.lit(0), *[F.coalesce(F.col(f"_{j}.line_no"), F.lit(0)) for j in range(1, k)]) if k > 1 else F.lit(0)
        slots.append(F.when(F.col(f"_{k}.line_no") > above, F.trim(F.col(f"_{k}.title"))))
    path = F.filter(F.array(*slots), lambda t: t.isNotNull())
    return titled.withColumn("heading_path", path).drop("title", *[f"_{k}" for k in range(1, 7)])


def blocks(rows: DataFrame) -> DataFrame:
    """doc, kind (TEXT or TABLE), line_start, line_end, heading_path, content of each run of lines; blank text is left out."""
    kind = F.when(F.col("level") > 0, "HEADING").when(F.trim("line").startswith("|"), "TABLE").otherwise("TEXT")
    order = Window.partitionBy("doc").orderBy("line_no")
    told = with_headings(rows).withColumn("kind", kind)
    turn = F.coalesce(F.lag("kind").over(order) != F.col("kind"), F.lit(True)) | (F.col("level") > 0)
    told = told.withColumn("island", F.sum(turn.cast("int")).over(_upto()))
    runs = told.where("level = 0").groupBy("doc", "island", "kind").agg(
        F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"), F.min_by("heading_path", "line_no").alias("heading_path"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("content"),
    )
    runs = runs.withColumn("content", F.trim(F.col("content"), F.lit(" \t\r\n")))
    return runs.where("content <> ''").drop("island")


def evidence(rows: DataFrame, sha: DataFrame) -> DataFrame:
    """Blocks with artifact_sha256 (from sha: doc, artifact_sha256), block_id and content_sha256."""
    found = blocks(rows).join(sha, "doc")
    place = F.concat(F.when(F.col("kind") == "TABLE", "md:table:").otherwise("md:"), F.concat_ws(":", F.col("line_start").cast("string"), F.col("line_end").cast("string")))
    return found.withColumn("block_id", C.block_id(F.col("artifact_sha256"), place)).withColumn("content_sha256", F.sha2("content", 256))


def cells(line: Column) -> Column:
    """Cells of a table row without its outer pipes."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(line), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(inner, r"\|"), lambda c: F.trim(c))


def is_rule(row: Column) -> Column:
    """Whether all cells of a row only rule a line under the header."""
    return F.forall(row, lambda c: c.rlike("^:?-{2,}:?$"))


def table_cells(rows: DataFrame) -> DataFrame:
    """doc, table_no, row_no (0: header), col_no, header, cell of each table in rows."""
    own = rows.withColumn("is_row", F.trim("line").startswith("|"))
    order = Window.partitionBy("doc").orderBy("line_no")
    start = F.col("is_row") & ~F.coalesce(F.lag("is_row").over(order), F.lit(False))
    own = own.withColumn("table_no", F.sum(start.cast("int")).over(_upto())).where("is_row").withColumn("row", cells(F.col("line"))).where(~is_rule(F.col("row")))
    own = own.withColumn("row_no", F.row_number().over(Window.partitionBy("doc", "table_no").orderBy("line_no")) - 1)
    head = own.where("row_no = 0").select("doc", "table_no", F.col("row").alias("header"))
    wide = own.join(head, ["doc", "table_no"]).select("doc", "table_no", "row_no", "header", F.posexplode("row").alias("col_no", "cell"))
    return wide.select("doc", "table_no", "row_no", "col_no", F.get("header", "col_no").alias("header"), "cell")


def front_matter(text: Column) -> Column:
    """Map of the key: value lines between --- lines at a text's start; empty without them."""
    body = F.regexp_extract(F.coalesce(text, F.lit("")), r"^---\n([\s\S]*?)\n---", 1)
    pairs = F.filter(F.split(body, "\n"), lambda line: line.rlike(r"^\s*[A-Za-z_][\w-]*\s*:"))
    return F.map_from_entries(F.transform(pairs, lambda line: F.struct(F.trim(F.substring_index(line, ":", 1)), F.trim(F.regexp_replace(line, r"^[^:]*:", "")))))


def section(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc, rule_id, content of each wanted rule_id: from the first heading that names it to the next of its level or above. An id is words joined by hyphens."""
    level = F.length(F.regexp_extract("line", HEADING, 1))
    heads = rows.withColumn("level", level).where("level > 0").select("doc", "line_no", "level", "line")
    ids = F.array_distinct(F.regexp_extract_all("line", F.lit(r"[A-Za-z0-9]+(?:-[A-Za-z0-9]+)+"), F.lit(0)))
    named = heads.withColumn("rule_id", F.explode(ids)).join(wanted, "rule_id").groupBy("doc", "rule_id").agg(F.min(F.struct("line_no", "level")).alias("h"))
    named = named.select("doc", "rule_id", F.col("h.line_no").alias("start"), F.col("h.level").alias("own"))
    ends = named.join(heads.select("doc", F.col("line_no").alias("next"), "level"), "doc").where("next > start and level <= own").groupBy("doc", "rule_id").agg(F.min("next").alias("stop"))
    spans = named.join(ends, ["doc", "rule_id"], "left")
    body = spans.join(rows, "doc").where("line_no >= start and (stop is null or line_no < stop)")
    return body.groupBy("doc", "rule_id").agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n"), F.lit(" \n")).alias("content"))


def excerpts(rows: DataFrame, size: int = 200) -> DataFrame:
    """doc, line_no, excerpt: each line with its neighbours, cut to size characters."""
    order = Window.partitionBy("doc").orderBy("line_no")
    whole = F.concat_ws("\n", F.lag("line").over(order), F.col("line"), F.lead("line").over(order))
    return rows.select("doc", "line_no", F.left(whole, F.lit(size)).alias("excerpt"))


def chunks(found: DataFrame, version: str = "1") -> DataFrame:
    """found (doc, artifact_sha256, line_start, line_end, heading_path, content, content_sha256) as numbered chunks: sequence, file, chunk_id, domain_tags, tokens, budget_status."""
    order = Window.partitionBy("doc").orderBy("line_start")
    place = F.to_json(F.struct("line_start", "line_end"))
    return found.select(
        "doc", F.row_number().over(order).alias("sequence"), F.concat(F.lpad(F.row_number().over(order).cast("string"), 4, "0"), F.lit(".md")).alias("file"),
        C.prefixed_id("C", F.concat_ws(":", "artifact_sha256", place, "content_sha256", F.lit(version))).alias("chunk_id"),
        C.domain_tags(F.col("heading_path"), F.col("content")).alias("domain_tags"), C.estimate_tokens(F.col("content")).alias("tokens"), "content",
    )


#: Headers of the columns that hold a process's level and name.
LEVEL_HEADER, NAME_HEADER = "(?i)层级|level", "(?i)名称|name"


def lookup(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc, code, level, name of the wanted (doc, code) by the tables of cells (see table_cells): the first row, of the first table with such a column, whose first cell
    names the code and that has a value."""
    first = cells.where("col_no = 0 and row_no > 0").select("doc", "table_no", "row_no", C.canonical_key(F.col("cell")).alias("own"), C.candidate_codes(F.col("cell")).alias("codes"))

    def values(pattern: str, whole: bool, name: str) -> DataFrame:
        columns = cells.where((F.col("row_no") == 0) & F.col("cell").rlike(pattern)).groupBy("doc", "table_no").agg(F.min("col_no").alias("col_no"))
        rows = cells.where("row_no > 0").join(columns, ["doc", "table_no", "col_no"]).where(F.trim("cell") != "").select("doc", "table_no", "row_no", F.trim("cell").alias("value")).join(first, ["doc", "table_no", "row_no"])
        named = rows.withColumn("code", F.explode(F.array_distinct(F.concat("codes", F.array("own")) if whole else F.col("codes"))))
        return named.groupBy("doc", "code").agg(F.min_by("value", F.struct("table_no", "row_no")).alias(name))

    key = C.canonical_key(F.col("code"))
    told = wanted.select("doc", key.alias("code")).distinct().join(values(LEVEL_HEADER, True, "level"), ["doc", "code"], "left").join(values(NAME_HEADER, False, "name"), ["doc", "code"], "left")
    short = F.upper(F.regexp_extract("level", "(?i)(L[0-9]+)", 1))
    return told.select("doc", "code", F.when(short != "", short).otherwise(F.col("level")).alias("level"), "name")


def page_locator(path: Column, page: Column, text: Column) -> Column:
    """struct(locator_type, locator, excerpt) of a page."""
    return F.struct(F.lit("PAGE").alias("locator_type"), F.concat(path, F.lit(":page-"), page.cast("string")).alias("locator"), F.substring(F.coalesce(text, F.lit("")), 1, 200).alias("excerpt"))


def element_locator(path: Column, element: Column, name: Column) -> Column:
    """struct(locator_type, locator, excerpt) of a diagram's element; one without a name shows its id."""
    return F.struct(F.lit("BPMN_ELEMENT").alias("locator_type"), F.concat(path, F.lit("#"), element).alias("locator"), F.coalesce(C.blank_null(name), element).alias("excerpt"))
