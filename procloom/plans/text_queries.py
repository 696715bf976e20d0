"""Queries on files and texts: scans, chunking, token budgets and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procloom.functions import columns as C
from procloom.operators import budget, candidates, packing, splitting
from procloom.operators.joins import null_safe
from procloom.plans import derived as D
from procloom.plans import models as M
from procloom.plans.registry import Registry, table
from procloom.sources import files, markdown

R = Registry()

_HAN, _ASCII = r"length(regexp_replace(coalesce({t}, ''), '[^\p{{Han}}]', '', 'g'))", r"length(regexp_replace(coalesce({t}, ''), '[^\x00-\x7F]', '', 'g'))"


def tokens_sql(t: str) -> str:
    han, ascii_ = _HAN.format(t=t), _ASCII.format(t=t)
    return f"CAST(ceil({han} / 1.5::DOUBLE + {ascii_} / 4.0::DOUBLE + (length(coalesce({t}, '')) - {han} - {ascii_})) AS BIGINT)"


def utf16_sql(t: str) -> str:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return f"(length({t}) + length(regexp_replace({t}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def status_sql(used: str, limit: float) -> str:
    return f"CASE WHEN {used} / {limit}::DOUBLE > 1.2 THEN 'BUDGET_SPLIT_REQUIRED' WHEN {used} / {limit}::DOUBLE >= 1.0 THEN 'BUDGET_ATTENTION' ELSE 'BUDGET_OK' END"


def greedy_sql(units: str, max_blocks: int, max_chars: int, table: str = "packed") -> str:
    """CTEs that end in a table of grp, ord, batch_no for units (grp, ord, chars); each unit counts as one block."""
    return f"""units AS ({units}), numbered AS (
            SELECT grp, ord, chars, row_number() OVER g AS n, sum(chars) OVER (PARTITION BY grp ORDER BY ord ROWS UNBOUNDED PRECEDING) AS cum FROM units WINDOW g AS (PARTITION BY grp ORDER BY ord)
        ), hops AS (
            SELECT a.grp, a.n, min(b.n) AS to_n FROM numbered a JOIN numbered b ON b.grp = a.grp AND b.n > a.n AND b.n <= a.n + {max_blocks}
            WHERE b.cum - a.cum + a.chars > {max_chars} OR b.n = a.n + {max_blocks} GROUP BY 1, 2
        ), starts AS (
            SELECT grp, 1::BIGINT AS n, 0::BIGINT AS batch_no FROM numbered WHERE n = 1
            UNION ALL SELECT h.grp, h.to_n, s.batch_no + 1 FROM starts s JOIN hops h ON h.grp = s.grp AND h.n = s.n
        ), {table} AS (SELECT n.grp, n.ord, s.batch_no FROM numbered n ASOF JOIN starts s ON s.grp = n.grp AND n.n >= s.n)"""


#: A null source is a group of its own: chr(1) stands for it.
DOC_UNITS = f"SELECT coalesce(source, chr(1)) AS grp, doc_id AS ord, {utf16_sql('coalesce(text, chr(32))')} - CASE WHEN text IS NULL THEN 1 ELSE 0 END AS chars FROM documents"


def by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("grp"), F.col("doc_id").alias("ord"), F.col("text").alias("content"))


@R.add("SELECT doc_id, sha256(coalesce(text, '')) AS artifact_sha256, 'A-' || sha256(coalesce(text, ''))[:12] AS artifact_id, strlen(coalesce(text, ''))::BIGINT AS size_bytes, 'B-' || sha256(sha256(coalesce(text, '')) || ':md:1:1')[:12] AS block_id FROM documents")
def artifact_hash_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 and the identities of §1.4."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    return files.manifest(docs).withColumnRenamed("path", "doc_id").withColumn("block_id", C.block_id(F.col("artifact_sha256"), F.lit("md:1:1")))


_FORMATS_SQL = ", ".join(f"('{e}', '{k}', '{m}', {'NULL' if c is None else repr(c)})" for e, k, m, c in files.FORMATS)
_EXT_SQL = r"lower(regexp_extract(path, '[^/\\.][^/\\]*?(\.[^./\\]*)$', 1))"


@R.add(f"""
    WITH f(extension, kind, parse_mode, capability) AS (VALUES {_FORMATS_SQL}), p AS (SELECT path, {_EXT_SQL} AS extension FROM {M.PATHS.sql})
    SELECT p.path, p.extension, coalesce(kind, 'UNKNOWN') AS kind, coalesce(parse_mode, 'UNSUPPORTED') AS parse_mode, capability,
           CASE WHEN kind IS NULL THEN 0.0 WHEN parse_mode = 'VISUAL_ONLY' THEN 0.5 ELSE 0.9 END::DOUBLE AS confidence
    FROM p LEFT JOIN f USING (extension)""")
def format_capability_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1, S2, S14."""
    return files.classified(M.PATHS.df(spark)).select("path", "extension", "kind", "parse_mode", "capability", "confidence")


def _in(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


@R.add(f"""
    WITH p AS (SELECT path, {_EXT_SQL} AS e FROM {M.PATHS.sql})
    SELECT 1 AS request, count(*) FILTER (e IN ({_in(files.ROUTED['ARCHITECTURE'])})) AS n_architecture, count(*) FILTER (e IN ({_in(files.ROUTED['DIAGRAM'])})) AS n_diagram,
           list_sort(list(path) FILTER (e NOT IN ({_in([*files.ROUTED['ARCHITECTURE'], *files.ROUTED['DIAGRAM']])}))) AS unclassified FROM p""")
def path_family_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6."""
    return files.routed_counts(M.PATHS.df(spark).withColumn("request", F.lit(1)))


@R.add(f"""
    SELECT file, CASE WHEN cell_count > 0 AND (editable OR raster) THEN 'MIXED' WHEN editable OR raster THEN 'DIAGRAM' ELSE 'ARCHITECTURE' END AS kind,
           CASE WHEN editable OR NOT raster THEN 'STRUCTURED' WHEN cell_count > 0 THEN 'SEMI_STRUCTURED' ELSE 'VISUAL_ONLY' END AS parse_mode,
           list_filter([CASE WHEN cell_count > 0 OR NOT (editable OR raster) THEN 'XLSX_TABLE' END, CASE WHEN editable THEN 'DRAWINGML_STRUCTURE' END, CASE WHEN raster AND NOT editable THEN 'VISUAL_ONLY' END], lambda c: c IS NOT NULL) AS capabilities,
           CASE WHEN editable THEN 0.9 WHEN raster THEN 0.5 WHEN cell_count > 0 THEN 0.85 ELSE 0.3 END::DOUBLE AS confidence
    FROM {M.WORKBOOKS.sql}""")
def xlsx_content_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3, S5."""
    return M.WORKBOOKS.df(spark).select("file", files.workbook_kind(F.col("cell_count"), F.col("editable"), F.col("raster")).alias("w")).select("file", "w.*")


_VISIBLE = r"""regexp_replace(regexp_replace(coalesce(html, ''), '<(script|style)\b.*?</(script|style)>', ' ', 'gis'), '<[^>]*>', ' ', 'g')"""


@R.add(rf"""
    WITH d AS (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS artifact, length(regexp_replace({_VISIBLE}, '\s+', '', 'g')) < 20 AS sparse FROM pages),
    n AS (SELECT artifact, count(*) AS n_pages, count(*) FILTER (sparse) AS n_visual FROM d GROUP BY artifact)
    SELECT artifact, n_pages, n_visual, CASE WHEN n_visual = n_pages THEN 'DIAGRAM' ELSE 'MIXED' END AS kind, CASE WHEN n_visual = n_pages THEN 'VISUAL_ONLY' ELSE 'SEMI_STRUCTURED' END AS parse_mode,
           CASE WHEN n_visual = n_pages THEN 0.4 WHEN n_visual > 0 THEN 0.7 ELSE 0.9 END::DOUBLE AS confidence FROM n""")
def page_visual_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 over the pages of each host."""
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("artifact"), files.visible_text(F.col("html")).alias("text"))
    return files.page_kinds(pages)


@R.add(rf"""
    WITH p AS (SELECT page_id, trim({_VISIBLE}) AS t, sha256(coalesce(html, '')) AS sha FROM pages),
    c AS (SELECT *, length(t) > 10 AS enough, CASE WHEN length(t) > 10 THEN t ELSE '[visual page] 1' END AS content FROM p)
    SELECT page_id, CASE WHEN enough THEN 'TEXT' ELSE 'VISUAL_ASSET' END AS modality, 'B-' || sha256(sha || CASE WHEN enough THEN ':pdf:' ELSE ':pdf:visual:' END || '1')[:12] AS block_id, sha256(content) AS content_sha256 FROM c""")
def page_evidence_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block for each page, text or placeholder."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.sha2(F.coalesce("html", F.lit("")), 256).alias("artifact_sha256"), F.lit(1).alias("page"), files.visible_text(F.col("html")).alias("text"))
    return files.page_blocks(pages, "page_id").select("page_id", "modality", "block_id", "content_sha256")


@R.add(f"SELECT doc_id, {_HAN.format(t='text')} AS han, {_ASCII.format(t='text')} AS ascii, {utf16_sql('coalesce(text, chr(32))')} - CASE WHEN text IS NULL THEN 1 ELSE 0 END AS utf16, {tokens_sql('text')} AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1."""
    han, ascii_, _ = C.token_parts(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", han.alias("han"), ascii_.alias("ascii"), C.utf16_length(F.coalesce("text", F.lit(""))).alias("utf16"), C.estimate_tokens(F.col("text")).alias("tokens"))


@R.add(f"""
    WITH t AS (SELECT source AS grp, CASE lang WHEN 'en' THEN 'content' WHEN 'fr' THEN 'fixed' ELSE 'metadata' END AS role, {tokens_sql('text')} AS tokens FROM documents),
    s AS (SELECT grp, coalesce(sum(tokens) FILTER (role = 'fixed'), 0)::BIGINT AS fixed, coalesce(sum(tokens) FILTER (role = 'content'), 0)::BIGINT AS content, coalesce(sum(tokens) FILTER (role = 'metadata'), 0)::BIGINT AS metadata FROM t GROUP BY grp)
    SELECT *, fixed + content + metadata AS total, round((fixed + content + metadata) / 40000.0::DOUBLE, 6) AS ratio, {status_sql('(fixed + content + metadata)', 40000.0)} AS status FROM s""")
def budget_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's budget, by the role of its texts."""
    role = F.when(F.col("lang") == "en", "content").when(F.col("lang") == "fr", "fixed").otherwise("metadata")
    return budget.context_budgets(table(spark, sf_dir, "documents").select(F.col("source").alias("grp"), role.alias("role"), "text"), 40_000)


@R.add(f"""
    WITH RECURSIVE {greedy_sql(DOC_UNITS, 12, 12000)}, t AS (SELECT source, doc_id, {tokens_sql('text')} AS tokens, {utf16_sql("coalesce(text, '')")} AS chars FROM documents)
    SELECT nullif(p.grp, chr(1)) AS grp, count(*) AS n_docs, max(batch_no) + 1 AS n_batches, count(*) FILTER (t.chars > 12000) AS n_split, sum(t.tokens)::BIGINT AS tokens
    FROM packed p JOIN t ON t.doc_id = p.ord GROUP BY p.grp""")
def greedy_batches_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of whole documents by source, and how many documents must be cut."""
    docs = by_source(spark, sf_dir).select("grp", "ord", C.utf16_length(F.coalesce("content", F.lit(""))).alias("chars"), C.estimate_tokens(F.col("content")).alias("tokens"))
    placed = packing.greedy(docs.select("grp", "ord", F.lit(1).cast("long").alias("blocks"), "chars"))
    told = null_safe(docs, placed, ["grp", "ord"])
    return told.groupBy("grp").agg(F.count("*").alias("n_docs"), (F.max("batch_no") + 1).alias("n_batches"), F.count_if(F.col("chars") > splitting.MAX_CHARS).alias("n_split"), F.sum("tokens").alias("tokens"))


@R.add(f"""
    WITH RECURSIVE {greedy_sql(DOC_UNITS, 12, 12000)},
    b AS (SELECT doc_id, 'B-' || sha256(sha256(coalesce(text, '')) || ':md:1:1')[:12] AS block_id, sha256(coalesce(text, '')) AS sha FROM documents)
    SELECT nullif(p.grp, chr(1)) AS grp, p.batch_no, 'EB-' || sha256(string_agg(b.block_id, ',' ORDER BY b.block_id))[:12] AS batch_id, sha256(string_agg(b.sha, ',' ORDER BY b.sha)) AS batch_sha256, count(*) AS n_blocks
    FROM packed p JOIN b ON b.doc_id = p.ord GROUP BY p.grp, p.batch_no""")
def batch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6."""
    docs = by_source(spark, sf_dir).select("grp", "ord", C.utf16_length(F.coalesce("content", F.lit(""))).alias("chars"), F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_sha256"))
    placed = packing.greedy(docs.select("grp", "ord", F.lit(1).cast("long").alias("blocks"), "chars"))
    members = null_safe(docs, placed, ["grp", "ord"]).withColumn("block_id", C.block_id(F.col("content_sha256"), F.lit("md:1:1")))
    return packing.batch_ids(members)


@R.add(f"""
    WITH RECURSIVE d AS (SELECT lang AS grp, doc_id AS ord, {tokens_sql('text')} AS tokens FROM documents WHERE source < 'src_1' OR lang = 'en'),
    {greedy_sql("SELECT grp, ord, CASE WHEN tokens > 2400 THEN 2001 ELSE least(tokens, 2000) END AS chars FROM d", 1 << 30, 2000)}
    SELECT d.grp, p.batch_no AS packet_no, 'MP-' || sha256(string_agg('C-' || d.ord, ',' ORDER BY 'C-' || d.ord))[:12] AS packet_id, CASE WHEN max(d.tokens) > 2400 THEN 'BLOCKED' ELSE 'RUNNABLE' END AS status, sum(d.tokens)::BIGINT AS tokens, count(*) AS n_chunks
    FROM packed p JOIN d USING (grp, ord) GROUP BY 1, 2""".replace("AND b.n <= a.n + 1073741824", "").replace(" OR b.n = a.n + 1073741824", ""))
def material_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with an allowed tag in packets of 2000 tokens by language."""
    tag = F.when((F.col("source") < "src_1") | (F.col("lang") == "en"), F.array(F.lit("L4"))).otherwise(F.array(F.lit("SOP")))
    chunks = table(spark, sf_dir, "documents").select(F.col("lang").alias("grp"), F.col("doc_id").alias("ord"), F.concat(F.lit("C-"), F.col("doc_id").cast("string")).alias("chunk_id"), tag.alias("domain_tags"), C.estimate_tokens(F.col("text")).alias("tokens"))
    return packing.material_packets(chunks, ["L4", "L5"], 2000)


@R.add(f"""
    WITH RECURSIVE d AS (SELECT role AS grp, conv_id * 100000 + turn AS ord, max({tokens_sql('text')}) AS tokens FROM conversations GROUP BY 1, 2),
    {greedy_sql("SELECT grp, ord, tokens AS chars FROM d", 1 << 30, 400)}
    SELECT d.grp, p.batch_no AS task_no, 'AGG-' || sha256(string_agg('r' || d.ord, ',' ORDER BY d.ord))[:12] AS task_id, count(*) AS n_results, sum(d.tokens)::BIGINT AS tokens, CASE WHEN sum(d.tokens) > 480 THEN 'BLOCKED' ELSE 'RUNNABLE' END AS status
    FROM packed p JOIN d USING (grp, ord) GROUP BY 1, 2""".replace("AND b.n <= a.n + 1073741824", "").replace(" OR b.n = a.n + 1073741824", ""))
def aggregation_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as results, folded by role."""
    turns = table(spark, sf_dir, "conversations").groupBy(F.col("role").alias("grp"), (F.col("conv_id") * 100_000 + F.col("turn")).alias("ord")).agg(F.max(C.estimate_tokens(F.col("text"))).alias("tokens"))
    return budget.aggregation_tasks(turns.withColumn("result_id", F.concat(F.lit("r"), F.col("ord").cast("string"))), 400)


@R.add(f"""
    WITH RECURSIVE {greedy_sql("SELECT source AS grp, doc_id AS ord, " + utf16_sql("coalesce(text, '')") + " AS chars FROM documents WHERE lang IS DISTINCT FROM 'en'", 1 << 30, 14400)}
    SELECT grp, ord, batch_no FROM packed""".replace("AND b.n <= a.n + 1073741824", "").replace(" OR b.n = a.n + 1073741824", ""))
def refinement_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: chunks without tags in groups of 14400 characters."""
    tags = F.when(F.col("lang") == "en", F.array(F.lit("L4"))).otherwise(F.array().cast("array<string>"))
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("grp"), F.col("doc_id").alias("ord"), tags.alias("domain_tags"), F.coalesce("text", F.lit("")).alias("content"))
    return budget.refinement_groups(docs)


@R.add(f"""
    WITH RECURSIVE {greedy_sql(DOC_UNITS, 12, 12000)}, t AS (SELECT doc_id, {tokens_sql('text')} AS tokens FROM documents),
    b AS (SELECT p.grp, p.batch_no, sum(t.tokens)::BIGINT AS tokens FROM packed p JOIN t ON t.doc_id = p.ord GROUP BY 1, 2)
    SELECT nullif(grp, chr(1)) AS grp, batch_no, k.task_kind, CASE WHEN {status_sql('tokens', 8000.0)} = 'BUDGET_SPLIT_REQUIRED' THEN 'SPLIT_REQUIRED' ELSE 'PENDING' END AS status FROM b CROSS JOIN (VALUES ('PROCESS_CARD'), ('ACTIVITY_CATALOG'), ('CONTROL_FLOW')) AS k(task_kind)""")
def queue_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tasks a batch."""
    docs = by_source(spark, sf_dir).select("grp", "ord", C.utf16_length(F.coalesce("content", F.lit(""))).alias("chars"), C.estimate_tokens(F.col("content")).alias("tokens"))
    placed = packing.greedy(docs.select("grp", "ord", F.lit(1).cast("long").alias("blocks"), "chars"))
    batches = null_safe(docs, placed, ["grp", "ord"]).groupBy("grp", "batch_no").agg(F.sum("tokens").alias("tokens"))
    return budget.queue_tasks(batches, C.token_limit(splitting.MAX_CHARS))


_EST = "CASE WHEN doc_id % 3 = 0 AND lang <> 'en' THEN '.docx' WHEN doc_id % 3 = 1 AND lang = 'fr' THEN '.txt' ELSE '.md' END"


@R.add(f"""
    WITH f AS (SELECT source || '/' || lang AS grp, {_EST} AS e, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1 AS n FROM documents),
    g AS (SELECT grp, bool_and(e = '.md') AS exact, sum(n) AS n, sum(CASE WHEN e IN ('.md', '.txt') THEN 3 ELSE 1 END) AS low, sum(CASE WHEN e IN ('.md', '.txt') THEN 30 ELSE 8 END) AS high FROM f GROUP BY grp),
    h AS (SELECT grp, exact, CASE WHEN exact THEN n ELSE low END AS a, CASE WHEN exact THEN n ELSE high END AS b FROM g)
    SELECT grp, CASE WHEN exact THEN 'EXACT' ELSE 'HEURISTIC_RANGE' END AS estimate, a::BIGINT AS min_blocks, b::BIGINT AS max_blocks, ceil(a / 12.0)::BIGINT AS min_batches, ceil(b / 12.0)::BIGINT AS max_batches, 3 * ceil(a / 12.0)::BIGINT AS min_tasks, 3 * ceil(b / 12.0)::BIGINT AS max_tasks FROM h""")
def budget_estimate_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source and language as one run."""
    kind = F.when((F.col("doc_id") % 3 == 0) & (F.col("lang") != "en"), ".docx").when((F.col("doc_id") % 3 == 1) & (F.col("lang") == "fr"), ".txt").otherwise(".md")
    docs = table(spark, sf_dir, "documents")
    return budget.estimate_range(docs.select(F.concat("source", F.lit("/"), "lang").alias("grp"), kind.alias("extension"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n_blocks")))


@R.add(f"""
    WITH t AS (SELECT source, count(*) AS actual, min(doc_id) % 4 AS k FROM documents GROUP BY source)
    SELECT source, CASE WHEN k = 0 THEN 'EQUAL' WHEN k < 3 THEN 'IN_RANGE' ELSE 'OUT_OF_RANGE' END AS deviation FROM t""")
def estimate_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How counts stand to estimates that are right, wide or wrong."""
    t = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("actual"), (F.min("doc_id") % 4).alias("k"))
    least, most = F.col("actual") - F.when(F.col("k") == 0, 0).otherwise(1), F.col("actual") + F.when(F.col("k") == 0, 0).when(F.col("k") < 3, 2).otherwise(-1)
    return t.select("source", budget.deviation(F.col("actual"), least, most).alias("deviation"))


@R.add(f"""
    WITH RECURSIVE big AS (SELECT doc_id, text FROM documents WHERE {utf16_sql('text')} > 2000), l AS (
        SELECT doc_id, generate_subscripts(p, 1) AS n, unnest(p) AS line FROM (SELECT doc_id, string_split(trim(text, ' ' || chr(9) || chr(10) || chr(13)), chr(10)) AS p FROM big)
    ), c AS (SELECT *, sum({utf16_sql('line')} + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS cum, {utf16_sql('line')} + 1 AS own FROM l
    ), hops AS (SELECT a.doc_id, a.n, min(b.n) AS to_n FROM c a JOIN c b ON b.doc_id = a.doc_id AND b.n > a.n WHERE b.cum - a.cum + a.own - 1 > 2000 GROUP BY 1, 2
    ), s AS (SELECT doc_id, 1::BIGINT AS n FROM c WHERE n = 1 UNION ALL SELECT h.doc_id, h.to_n FROM s JOIN hops h USING (doc_id, n)
    ), parts AS (SELECT c.doc_id, s.n AS start, string_agg(line, chr(10) ORDER BY c.n) AS t FROM c ASOF JOIN s ON s.doc_id = c.doc_id AND c.n >= s.n GROUP BY 1, 2
    ), cut AS (
        SELECT doc_id, start, 0 AS k, trim(t, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM parts WHERE trim(t) <> '' AND {utf16_sql("trim(t, ' ' || chr(9) || chr(10) || chr(13))")} <= 2000
        UNION ALL SELECT doc_id, start, k, substr(u, (k * 2000 + 1)::BIGINT, 2000) FROM (SELECT doc_id, start, trim(t, ' ' || chr(9) || chr(10) || chr(13)) AS u, unnest(range(0, ((length(trim(t, ' ' || chr(9) || chr(10) || chr(13))) - 1) // 2000) + 1)) AS k FROM parts WHERE {utf16_sql("trim(t, ' ' || chr(9) || chr(10) || chr(13))")} > 2000)
    )
    SELECT doc_id, count(*) AS n_fragments, max(length(t)) AS longest, sha256(string_agg(sha256(t), ',' ORDER BY start, k)) AS sha256 FROM cut GROUP BY doc_id""")
def split_long_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5 to T8 with a limit of 2000 units: paragraphs, then lines, then characters. The texts have no blank lines, so paragraphs leave them whole."""
    docs = table(spark, sf_dir, "documents").where(C.utf16_length(F.col("text")) > 2000).select("doc_id", splitting.fragments(F.col("text"), 2000).alias("parts"))
    return docs.select("doc_id", F.size("parts").cast("long").alias("n_fragments"), F.array_max(F.transform("parts", F.length)).cast("long").alias("longest"), F.sha2(F.array_join(F.transform("parts", lambda t: F.sha2(t, 256)), ","), 256).alias("sha256"))


_CHARS = "FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 500)) AS spot FROM documents WHERE text IS NOT NULL)"


@R.add(f"SELECT doc_id, spot // 500 AS fragment, sha256(substr(text, spot + 1, 500)) AS sha256 {_CHARS}")
def split_by_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of 500 characters."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(splitting.by_chars(F.col("text"), 500)).alias("fragment", "t")).select("doc_id", F.col("fragment").cast("long").alias("fragment"), F.sha2("t", 256).alias("sha256"))


_LINES = "lines AS (SELECT doc, generate_subscripts(p, 1) AS line_no, unnest(p) AS line FROM (SELECT doc, string_split(coalesce(text, ''), chr(10)) AS p FROM {src}))"
_LEVEL = r"length(regexp_extract(line, '^(#{1,6})\s+(.+)$', 1))"


def headings_sql(src: str) -> str:
    slots = ", ".join(f"max(CASE WHEN level = {k} THEN line_no END) OVER w AS s{k}" for k in range(1, 7))
    titles = ", ".join(f"CASE WHEN s{k} > greatest(0{''.join(f', coalesce(s{j}, 0)' for j in range(1, k))}) THEN (SELECT trim(regexp_extract(x.line, '^(#{{1,6}})\\s+(.+)$', 2)) FROM leveled x WHERE x.doc = seen.doc AND x.line_no = seen.s{k}) END" for k in range(1, 7))
    return _LINES.format(src=src) + f""", leveled AS (SELECT *, {_LEVEL} AS level FROM lines),
        seen AS (SELECT *, {slots} FROM leveled WINDOW w AS (PARTITION BY doc ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
        pathed AS (SELECT doc, line_no, line, level, list_filter([{titles}], lambda t: t IS NOT NULL) AS heading_path FROM seen)"""


def blocks_sql(src: str) -> str:
    return headings_sql(src) + """, kinds AS (SELECT *, CASE WHEN level > 0 THEN 'HEADING' WHEN starts_with(trim(line), '|') THEN 'TABLE' ELSE 'TEXT' END AS kind FROM pathed),
        turns AS (SELECT *, coalesce(lag(kind) OVER (PARTITION BY doc ORDER BY line_no) <> kind, true) OR level > 0 AS turn FROM kinds),
        islands AS (SELECT *, sum(turn::INT) OVER (PARTITION BY doc ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS island FROM turns),
        blocks AS (SELECT doc, kind, min(line_no) AS line_start, max(line_no) AS line_end, arg_min(heading_path, line_no) AS heading_path, trim(string_agg(line, chr(10) ORDER BY line_no), ' ' || chr(9) || chr(10) || chr(13)) AS content FROM islands WHERE level = 0 GROUP BY doc, kind, island)"""


@R.add(f"WITH {blocks_sql(D.MARKDOWN_SQL)} SELECT doc, kind, line_start, line_end, heading_path, content FROM blocks WHERE content <> ''")
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8, T1 to T4, W1, W2."""
    return markdown.blocks(markdown.lines(D.manuals(spark, sf_dir))).select("doc", "kind", "line_start", "line_end", "heading_path", "content")


@R.add(f"""
    WITH {blocks_sql("(SELECT doc_id AS doc, text FROM documents)")}
    SELECT b.doc AS doc_id, kind, line_start, line_end, 'B-' || sha256(d.sha || CASE WHEN kind = 'TABLE' THEN ':md:table:' ELSE ':md:' END || line_start || ':' || line_end)[:12] AS block_id, sha256(content) AS content_sha256
    FROM blocks b JOIN (SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents) d ON d.doc_id = b.doc WHERE content <> ''""")
def document_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7, S8 over all documents, with ids."""
    docs = table(spark, sf_dir, "documents")
    sha = docs.select(F.col("doc_id").alias("doc"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("artifact_sha256"))
    return markdown.evidence(markdown.lines(docs, "doc_id"), sha).select(F.col("doc").alias("doc_id"), "kind", "line_start", "line_end", "block_id", "content_sha256")


_CELLS = r"list_transform(string_split(regexp_replace(regexp_replace(trim(line), '^\|', ''), '\|$', ''), '|'), lambda c: trim(c))"


@R.add(rf"""
    WITH {_LINES.format(src=D.MARKDOWN_SQL)}, r AS (SELECT *, starts_with(trim(line), '|') AS is_row FROM lines),
    s AS (SELECT *, is_row AND NOT coalesce(lag(is_row) OVER (PARTITION BY doc ORDER BY line_no), false) AS start FROM r),
    t AS (SELECT doc, line_no, sum(start::INT) OVER (PARTITION BY doc ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS table_no, is_row, {_CELLS} AS row FROM s),
    u AS (SELECT *, row_number() OVER (PARTITION BY doc, table_no ORDER BY line_no) - 1 AS row_no FROM t WHERE is_row AND len(list_filter(row, lambda c: NOT regexp_matches(c, '^:?-{{2,}}:?$'))) > 0),
    v AS (SELECT u.doc, u.table_no, u.row_no, h.row AS header, u.row, unnest(range(len(u.row))) AS col_no FROM u JOIN u h ON h.doc = u.doc AND h.table_no = u.table_no AND h.row_no = 0)
    SELECT doc, table_no::BIGINT AS table_no, row_no::INT AS row_no, col_no::INT AS col_no, header[col_no + 1] AS header, row[col_no + 1] AS cell FROM v""")
def markdown_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T11, J17."""
    return markdown.table_cells(markdown.lines(D.manuals(spark, sf_dir)))


_TAGS = ", ".join(rf"CASE WHEN len(list_filter(w, lambda t: regexp_matches(t, '(?i){p}'))) > 0 THEN '{tag}' END" for tag, p in C.DOMAIN_TAGS.items())


@R.add(f"""
    WITH {blocks_sql(D.MARKDOWN_SQL)}, w AS (SELECT doc, line_start, list_append(heading_path, substr(content, 1, 500)) AS w FROM blocks WHERE content <> '')
    SELECT doc, line_start, list_sort(list_filter([{_TAGS}], lambda t: t IS NOT NULL)) AS domain_tags FROM w""")
def domain_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T9."""
    found = markdown.blocks(markdown.lines(D.manuals(spark, sf_dir)))
    return found.select("doc", "line_start", C.domain_tags(F.col("heading_path"), F.col("content")).alias("domain_tags"))


@R.add(f"""
    WITH {blocks_sql(D.MARKDOWN_SQL)}, n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY line_start) AS sequence, sha256(content) AS csha, sha256(doc) AS asha FROM blocks WHERE content <> '')
    SELECT doc, sequence::INT AS sequence, lpad(sequence::VARCHAR, 4, '0') || '.md' AS file, 'C-' || sha256(asha || ':{{"line_start":' || line_start || ',"line_end":' || line_end || '}}:' || csha || ':1')[:12] AS chunk_id, {tokens_sql('content')} AS tokens FROM n""")
def normalized_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered chunks with ids."""
    docs = D.manuals(spark, sf_dir)
    sha = docs.select("doc", F.sha2("doc", 256).alias("artifact_sha256"))
    return markdown.chunks(markdown.evidence(markdown.lines(docs), sha)).select("doc", "sequence", "file", "chunk_id", "tokens")


@R.add(r"""
    WITH m AS (SELECT doc, unnest(list_filter(string_split(regexp_extract(text, '^---\n((?s).*?)\n---', 1), chr(10)), lambda l: regexp_matches(l, '^\s*[A-Za-z_][\w-]*\s*:'))) AS line FROM {src})
    SELECT doc, trim(split_part(line, ':', 1)) AS key, trim(regexp_replace(line, '^[^:]*:', '')) AS value FROM m""".replace("{src}", D.MARKDOWN_SQL))
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S25."""
    return D.manuals(spark, sf_dir).select("doc", F.explode(markdown.front_matter(F.col("text"))).alias("key", "value"))


_WANTED = "(VALUES ('FA-L4-001'), ('FA-HIER-001'), ('FA-SOP-004')) AS wanted(rule_id)"
_SECTION = rf"""{_LINES.format(src=M.MARKDOWN.sql)}, h AS (SELECT *, {_LEVEL} AS level FROM lines),
    named AS (SELECT doc, rule_id, min(line_no) AS start, arg_min(level, line_no) AS own FROM h JOIN {_WANTED} ON contains(line, rule_id) WHERE level > 0 GROUP BY 1, 2),
    spans AS (SELECT n.*, (SELECT min(h.line_no) FROM h WHERE h.doc = n.doc AND h.level BETWEEN 1 AND n.own AND h.line_no > n.start) AS stop FROM named n),
    sections AS (SELECT s.doc, s.rule_id, trim(string_agg(h.line, chr(10) ORDER BY h.line_no), ' ' || chr(10)) AS content FROM spans s JOIN h ON h.doc = s.doc AND h.line_no >= s.start AND (s.stop IS NULL OR h.line_no < s.stop) GROUP BY 1, 2)"""


@R.add(f"""
    WITH {_SECTION}, t AS (SELECT w.rule_id, content IS NOT NULL AS found, {tokens_sql('content')} AS tokens FROM {_WANTED.replace('AS wanted', 'AS w')} LEFT JOIN sections USING (rule_id))
    SELECT *, sum(tokens) OVER ()::BIGINT AS packet_tokens, CASE WHEN sum(tokens) OVER () / 20.0 > 1.2 THEN 'BUDGET_SPLIT_REQUIRED' WHEN sum(tokens) OVER () / 20.0 >= 1 THEN 'BUDGET_ATTENTION' ELSE 'BUDGET_OK' END AS status FROM t""")
def rule_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of wanted rules under a limit of 20 tokens."""
    wanted = spark.createDataFrame([("FA-L4-001",), ("FA-HIER-001",), ("FA-SOP-004",)], "rule_id string")
    return budget.rule_packet(wanted, markdown.section(markdown.lines(M.MARKDOWN.df(spark)), wanted).select("rule_id", "content"), 20)


@R.add(f"""
    WITH {_LINES.format(src="(SELECT doc_id AS doc, text FROM documents)")}
    SELECT doc AS doc_id, line_no, sha256(substr(concat_ws(chr(10), lag(line) OVER w, line, lead(line) OVER w), 1, 200)) AS excerpt_sha256 FROM lines WINDOW w AS (PARTITION BY doc ORDER BY line_no)""")
def line_locator_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T13 over all lines of all documents."""
    return markdown.excerpts(markdown.lines(table(spark, sf_dir, "documents"), "doc_id")).select(F.col("doc").alias("doc_id"), "line_no", F.sha2("excerpt", 256).alias("excerpt_sha256"))


@R.add(f"WITH {blocks_sql(D.MARKDOWN_SQL)} SELECT doc, line_start FROM blocks WHERE content <> '' AND len(list_filter(heading_path, lambda h: list_contains(regexp_extract_all(upper(h), '[A-Z]{{1,4}}-[0-9]+(?:\\.[0-9]+)?'), 'CM-1.1'))) > 0")
def focus_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, C2, C3."""
    return candidates.focus_filter(markdown.blocks(markdown.lines(D.manuals(spark, sf_dir))), "cm-1.1").select("doc", "line_start")


_ROWS = rf"list_filter(list_transform(list_filter(string_split(content, chr(10)), lambda x: starts_with(trim(x), '|')), lambda line: {_CELLS}), lambda r: len(list_filter(r, lambda c: NOT regexp_matches(c, '^:?-{{2,}}:?$'))) > 0)"
_NAME = r"trim(regexp_replace(regexp_replace(trim(replace(regexp_replace(trim(heading), '^[一二三四五六七八九十百千]+、\s*', ''), process_key, '')), '（[^）]*）\s*$', ''), '\([^)]*\)\s*$', ''))"


@R.add(rf"""
    WITH {blocks_sql(D.MARKDOWN_SQL)}, b AS (SELECT *, {_ROWS} AS rows, heading_path[-1] AS last FROM blocks WHERE content <> ''),
    h AS (SELECT *, unnest(heading_path) AS heading FROM b), k AS (SELECT *, unnest(list_distinct(regexp_extract_all(upper(heading), '[A-Z]{{1,4}}-[0-9]+(?:\.[0-9]+)?'))) AS process_key FROM h),
    v AS (SELECT *, {_NAME} AS pname, upper(regexp_extract(heading, '(?i)(L[0-9]+)', 1)) AS lv, kind = 'TABLE' AND contains(array_to_string(rows[1], '|'), '活动') AND contains(array_to_string(rows[1], '|'), '角色') AND len(rows) >= 3 AS acts,
        regexp_matches(last, '控制流|顺序流') OR (kind = 'TABLE' AND contains(array_to_string(rows[1], '|'), '来源') AND contains(array_to_string(rows[1], '|'), '目标')) AS flow, regexp_matches(last, '结束事件|开始与结束') AS ends FROM k)
    SELECT doc, process_key, count(DISTINCT line_start) AS n_blocks, min(line_start) AS line_start, max(line_end) AS line_end, arg_min(pname, {{'a': line_start, 'b': heading}}) AS name,
        arg_min(lv, {{'a': line_start, 'b': heading}}) FILTER (lv <> '') AS level, bool_or(coalesce(acts, false)) AND bool_or(coalesce(flow, false)) AND bool_or(coalesce(ends, false)) AS complete FROM v GROUP BY 1, 2""")
def candidate_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13, A14, C12."""
    return candidates.discover(markdown.blocks(markdown.lines(D.manuals(spark, sf_dir))))
