"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procloom.llm import exactdup, lexical, licenses, linededup, mixing, neardup, packing, periods, quality, secretscan, shared, tokencount, toolcalls, toxicity


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file: in the folder PROCLOOM_TOKENIZERS, or where the installed package has it."""
    folder = os.environ.get("PROCLOOM_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.fit(docs, labels.where(~held_out())))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).drop("line_share", "gram_share")


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.link(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "kind", "call_id", "status", "n_results", F.col("position.turn").alias("at"), "level", "body")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_groups(table(spark, sf_dir, "documents"))


def op7_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.train(docs))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with shared.scratch():
        ledger = secretscan.Ledger(docs, shared.place(spark, "ledger"))
        return secretscan.digests(ledger.findings(ledger.scan(docs)))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = periods.planted(F.col("text"), F.col("doc_id"))
    return periods.digests(periods.periodic_runs(docs.select("doc_id", text.alias("text"))))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_source_mixing, op2_toxicity, op3_near_duplicates, op4_quality_rules, op5_tool_calls, op6_exact_dedup, op7_sequence_packing, op8_license_scan,
        op9_line_dedup, op10_token_counts, op11_secret_scan, op12_periodic_runs, op13_lexical_search,
    )
}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Terms of the lexical search.
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BLANK = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"

#: The words of each document, and with A-Z folded.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_FOLDED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def _windows(n: int) -> str:
    """n-word windows of each text: which occurrence of a window it is, and how many there are."""
    return f"""SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, h ORDER BY i) AS nth, count(*) OVER (PARTITION BY doc_id, h) AS many
        FROM (SELECT doc_id, i, hash(array_to_string(ws[i:i + {n - 1}], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM w))"""


def quality_sql(limits: quality.Limits = quality.Limits()) -> str:
    shares = ", ".join(f"g{n} AS (SELECT doc_id, sum(length(word)) AS c FROM words JOIN (SELECT DISTINCT doc_id, i + unnest(range({n})) AS i FROM ({_windows(n)}) WHERE nth > 1) USING (doc_id, i) GROUP BY doc_id)" for n in limits.gram_shares)
    joins = " ".join(f"LEFT JOIN g{n} USING (doc_id)" for n in limits.gram_shares)
    verdict = " AND ".join(f"coalesce(g{n}.c, 0) <= {share}::DOUBLE * greatest(word_chars, 1)" for n, share in limits.gram_shares.items())
    return rf"""
        WITH w AS (SELECT doc_id, text, {_WORDS} AS ws FROM documents), words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
        base AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM w),
        lines AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS nth FROM (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)) WHERE regexp_matches(line, '[^ 	-
]')),
        dup AS (SELECT doc_id, count(*) AS n_dup_lines, sum(list_sum(list_transform(regexp_extract_all(line, '[^ 	-
]+'), lambda x: length(x)))) AS c FROM lines WHERE nth > 1 GROUP BY doc_id),
        rep AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, i + unnest(range({limits.window})) AS i FROM ({_windows(limits.window)}) WHERE many > 1) GROUP BY doc_id), {shares},
        told AS (SELECT b.*, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, n_words < {limits.min_words} OR 100 * coalesce(n_repeat_words, 0) > {limits.repeat_percent} * n_words AS base_failed,
            coalesce(dup.c, 0) <= {limits.line_share}::DOUBLE * greatest(word_chars, 1) AND n_symbols <= {limits.symbol_share}::DOUBLE * greatest(word_chars, 1) AND {verdict} AS good
            FROM base b LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) {joins})
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND good AS kept FROM told"""


def secrets_sql(rules: tuple[secretscan.Rule, ...] = secretscan.RULES) -> str:
    """Places of matches: the pieces between them and the matches themselves, added up."""
    found = []
    for k, r in enumerate(rules):
        text = f"translate(text, '{_UPPER}', '{_UPPER.lower()}')" if r.folded else "text"
        pattern = "'" + r.pattern.replace("'", "''").replace(chr(92) + '"', '"') + "'"
        found.append(f"""
            SELECT doc_id, {k} AS k, '{r.kind}' AS kind, list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start,
                length(m[i]) AS n, length(g[i]) AS size
            FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
                SELECT doc_id, regexp_extract_all(t, {pattern}) AS m, regexp_extract_all(t, {pattern}, {r.group}) AS g, string_split_regex(t, {pattern}) AS s
                FROM (SELECT doc_id, {text} AS t FROM d)))
            WHERE length(g[i]) >= {r.least}""")
    base = ", ".join(f"'{r.kind}'" for r in rules[:3])
    told = "kind || ':' || start || ':' || (start + n), ',' ORDER BY start, k"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in rules[:3])
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), found AS ({" UNION ALL ".join(found)})
        SELECT d.doc_id, {counts}, sha256(coalesce(string_agg({told}) FILTER (kind IN ({base})), '')) AS base_sha256, coalesce(string_agg({told}), '') AS spans
        FROM d LEFT JOIN found USING (doc_id) GROUP BY d.doc_id"""


SQL: dict[str, str] = {
    "op3_near_duplicates": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_FOLDED} AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, hash(g) AS g FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
        FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(reach) AS c FROM r GROUP BY doc_id) m USING (doc_id)""",
    "op4_quality_rules": quality_sql(),
    "op5_tool_calls": """
        SELECT conv_id, turn, 'message' AS kind, CAST(NULL AS VARCHAR) AS call_id, 'plain' AS status, CAST(0 AS BIGINT) AS n_results, turn AS at, CAST(0 AS INTEGER) AS level,
               CAST(to_json(struct_pack(content := text, role := role)) AS VARCHAR) AS body
        FROM conversations""",
    "op6_exact_dedup": """
        WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM h WINDOW g AS (PARTITION BY text_sha256)""",
    "op9_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
        ), keyed AS (
            SELECT *, translate(trim(line, {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
        ), held AS (
            SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
        )
        SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (h.keeper <> k.doc_id) AS n_dropped,
               sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (h.keeper IS NULL OR h.keeper = k.doc_id), '')) AS kept_sha256
        FROM keyed k LEFT JOIN held h ON h.key = k.key GROUP BY k.doc_id""",
    "op11_secret_scan": secrets_sql(),
    # runs: neighbouring triples of words that come again q words later; crc32 by its bits
    "op12_periodic_runs": rf"""
        WITH c AS (SELECT doc_id, {_WORDS} AS ws, xor(4294967295, list_reduce([4294967295::UBIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT),
                lambda h, b: list_reduce([xor(h, b)] || [0::UBIGINT FOR _ IN range(8)], lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))))::BIGINT AS h FROM documents),
        p AS (SELECT *, len(ws)::BIGINT AS n, h // 10 AS g FROM c),
        a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a, CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM p),
        w AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % p + 1] END) END AS ws FROM a),
        t AS (SELECT doc_id, n, i, hash(ws[i + 1], ws[i + 2], ws[i + 3]) AS h FROM (SELECT *, unnest(range(n - 2)) AS i FROM w WHERE n >= 6)),
        e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.h = y.h AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
        s AS (SELECT doc_id, q, min(i) AS start, count(*) + 2 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e)
            GROUP BY doc_id, q, island HAVING count(*) + 2 >= greatest(6 - q, 3 * q)),
        r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY ALL),
        o AS (SELECT doc_id, count(*) AS n_runs, arg_max(struct_pack(s := start, l := length, p := period), [length, -start, -period]) AS best,
            string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
        x AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
        k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM w) ANTI JOIN x USING (doc_id, i) GROUP BY doc_id)
        SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period, 1000 * best.l // best.p AS exponent_milli,
            sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
        FROM w LEFT JOIN o USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op13_lexical_search": rf"""
        WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{_TERM}')) AS term FROM documents),
        s AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id), c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM s),
        p AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
        w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term, docs),
        q AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{_TERM}')) AS term FROM benchmark) GROUP BY ALL),
        r AS (SELECT item_id, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
            FROM q JOIN p USING (term) JOIN w USING (term) JOIN s USING (doc_id), c GROUP BY ALL HAVING score > 0)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM r
        QUALIFY rank <= 20""",
}
