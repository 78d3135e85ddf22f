"""The catalog: one query for each operator or group of operators, and the SQL that gives the same rows.

Tables: documents stand for files, code_chunks for chunks, training_samples for samples (their candidates are the chunks of the same
repository), eval_rows for evaluation sets, loader_samples for cross-file contexts, preference_pairs for scored strategies, embeddings for vectors.
Searches of chunks take every sample as a query, against all chunks of its repository; those of vectors take the vectors whose id is divisible by 100, against all vectors.
Texts are compared by their MD5.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codectx.functions import quality
from codectx.functions import text as t
from codectx.operators import chunking, dense, entities, evaluation, intent, packing, ranking, samples, sampling, strategies, structural, utility
from codectx.plans import neural, proxy, runner
from codectx.plans.config import NeuralConfig, ProxyConfig
from codectx.sources import readers
from codectx.storage import spread, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def n(c: Column) -> Column:
    return c.cast("long")


#: Pieces of SQL. DuckDB's list_distinct keeps no order, so ordered sets filter by first place.
IDS = "regexp_extract_all(coalesce({}, ''), '[_a-zA-Z][_a-zA-Z0-9]*')"
SPLIT = r"regexp_split_to_array(coalesce({}, ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"
WS = r"[\s\x0b\x1c-\x1f\x{85}\pZ]"
LINES = "CASE WHEN {0}[-1] = '' THEN {0}[:-2] ELSE {0} END"
SETOF = "list_distinct(list_filter(list_concat({}), lambda x: x IS NOT NULL))"
LEX = SETOF.format("coalesce(defined_symbols, []), coalesce(used_symbols, []), coalesce(call_names, [])")
ORA = SETOF.format("coalesce(defined_symbols, []), coalesce(call_names, []), coalesce(method_names, [])")
BONUS = "CASE WHEN chunk_type IN ('method', 'function', 'class_header') THEN 0.15 ELSE 0.0 END"
CID = "file_path || '::L' || start_line || '-' || end_line || '::' || chunk_type"


def strip_sql(value: str) -> str:
    return f"regexp_replace(regexp_replace({value}, '^{WS}+', ''), '{WS}+$', '')"


# text


@query(f"SELECT doc_id, len({IDS.format('text')})::BIGINT AS n_ids, len(list_distinct({IDS.format('text')}))::BIGINT AS n_distinct FROM documents")
def identifiers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", n(F.size(t.identifiers(F.col("text")))).alias("n_ids"), n(F.size(t.identifier_set(F.col("text")))).alias("n_distinct"))


@query(f"SELECT token, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, unnest({IDS.format('text')}) AS token FROM documents) GROUP BY token")
def identifier_vocab(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents").select("doc_id", F.explode(t.identifiers(F.col("text"))).alias("token"))
    return own.groupBy("doc_id", "token").agg(F.count("*").alias("c")).groupBy("token").agg(F.count("*").alias("df"), F.sum("c").alias("tf"))


CALLS = r"(?:(?:def|class)\s[_a-zA-Z][0-9]*([_a-zA-Z][_a-zA-Z0-9]*)?|([_a-zA-Z][_a-zA-Z0-9]*))\s*\("


@query(f"""
    WITH g AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{CALLS}', 1) AS a, regexp_extract_all(coalesce(text, ''), '{CALLS}', 2) AS b FROM documents),
    u AS (SELECT doc_id, i, CASE WHEN a[i] <> '' THEN a[i] ELSE b[i] END AS call_name FROM (SELECT doc_id, a, b, unnest(range(1, len(a) + 1)) AS i FROM g)),
    f AS (SELECT doc_id, call_name, min(i) AS i FROM u WHERE call_name <> '' AND call_name NOT IN ({", ".join(f"'{w}'" for w in t.NO_CALLS)}) GROUP BY ALL)
    SELECT doc_id, call_name, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM f""")
def call_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(t.call_names(F.col("text"))).alias("pos", "call_name")).select("doc_id", "call_name", n(F.col("pos")).alias("pos"))


@query(r"""SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[ \t\n\r\x0b\x0c]', '', 'g'))::BIGINT AS nws_chars,
    strlen(regexp_replace(coalesce(text, ''), '[ \t\n\r\x0b\x0c]', '', 'g'))::BIGINT AS nws_bytes FROM documents""")
def nws_size(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", n(t.nws_chars(F.col("text"))).alias("nws_chars"), n(t.nws_bytes(F.col("text"))).alias("nws_bytes"))


@query("""SELECT doc_id, (length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS n_lines,
    coalesce(length(text) >= 2000 AND length(text) - length(replace(text, chr(10), '')) + 1 >= 50, false) AS eligible FROM documents""")
def eligible_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", n(F.size(F.split("text", "\n", -1))).alias("n_lines"), t.is_eligible(F.col("text"), 50, 2000).alias("eligible")).withColumn("n_lines", F.when(F.col("n_lines") >= 0, F.col("n_lines")))


LANGUAGE_SQL = "CASE lower(regexp_extract(file_path, '(\\.[^./\\\\]*)$', 1)) " + " ".join(f"WHEN '{e}' THEN '{lang}'" for e, lang in t.LANGUAGES.items()) + " ELSE 'python' END"


@query(f"SELECT {LANGUAGE_SQL} AS language, count(*) AS chunks, count(DISTINCT file_path) AS files FROM code_chunks GROUP BY 1")
def languages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_chunks").groupBy(t.language(F.col("file_path")).alias("language")).agg(F.count("*").alias("chunks"), F.count_distinct("file_path").alias("files"))


@query(rf"""
    WITH l AS (SELECT chunk_key, {LANGUAGE_SQL} AS lang, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^[\s\x0b\x1c-\x1f\x{{85}}\pZ]+', '')), lambda x: x <> '') AS x FROM code_chunks)
    SELECT chunk_key, len(x) > 0 AND (len(list_filter(x, lambda s: NOT starts_with(s, '#'))) = 0 OR len(list_filter(x, lambda s: NOT (starts_with(s, '//') OR starts_with(s, '/*') OR starts_with(s, '*')))) = 0) AS is_comment,
        len(x) > 0 AND CASE lang WHEN 'python' THEN len(list_filter(x, lambda s: NOT (starts_with(s, 'import ') OR starts_with(s, 'from ')))) = 0
            WHEN 'go' THEN false ELSE len(list_filter(x, lambda s: NOT starts_with(s, 'import '))) = 0 END AS is_import FROM l""")
def comment_import_only(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "code_chunks")
    return c.select("chunk_key", t.is_comment_only(F.col("text")).alias("is_comment"), t.is_import_only(F.col("text"), t.language(F.col("file_path"))).alias("is_import"))


# chunks


@query(f"""
    WITH s AS (SELECT doc_id, {SPLIT.format('text')} AS p FROM documents), l AS (SELECT doc_id, {LINES.format('p')} AS x FROM s),
    w AS (SELECT doc_id, x, greatest(len(x), 1) AS c, unnest(range(1, greatest(len(x), 1) + 1, 40)) AS start_line FROM l)
    SELECT 'doc/' || doc_id || '::L' || start_line || '-' || least(start_line + 39, c) || '::fallback' AS chunk_id, doc_id, start_line::BIGINT AS start_line, least(start_line + 39, c)::BIGINT AS end_line,
        md5(coalesce(array_to_string(x[start_line:start_line + 39], chr(10)), '')) AS text_md5 FROM w""")
def line_chunks(spark: SparkSession, d: str) -> DataFrame:
    w = chunking.line_windows(table(spark, d, "documents"), "text", 40, ["doc_id"])
    name = chunking.chunk_id(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")), F.col("start_line"), F.col("end_line"), F.lit("fallback"))
    return w.select(name.alias("chunk_id"), "doc_id", n(F.col("start_line")).alias("start_line"), n(F.col("end_line")).alias("end_line"), F.md5("text").alias("text_md5"))


@query("""
    WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents), w AS (SELECT doc_id, x, len(x) AS c, unnest(range(0, len(x), 25)) AS o FROM l)
    SELECT doc_id, (o // 25)::BIGINT AS chunk_no, least(25, c - o)::BIGINT AS n_lines, md5(array_to_string(x[o + 1:o + 25], chr(10))) AS text_md5 FROM w""")
def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    w = chunking.line_windows(table(spark, d, "documents"), "text", 25, ["doc_id"], newline_only=True)
    return w.select("doc_id", n(F.col("chunk_no")).alias("chunk_no"), n(F.col("end_line") - F.col("start_line") + 1).alias("n_lines"), F.md5("text").alias("text_md5"))


@query(rf"""
    WITH s AS (SELECT doc_id, {SPLIT.format('text')} AS p FROM documents), l AS (SELECT doc_id, {LINES.format('p')} AS x FROM s),
    e AS (SELECT doc_id, x[i] AS line, i FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM l)),
    f AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM e WHERE regexp_replace(line, '[\s\x0b\x1c-\x1f\x{{85}}\pZ]+', '', 'g') <> ''),
    c AS (SELECT doc_id, g, i, (row_number() OVER (PARTITION BY doc_id, g ORDER BY i) - 1) // 10 AS k FROM f),
    r AS (SELECT doc_id, g, k, min(i) AS s, max(i) AS e FROM c GROUP BY ALL)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS run_no, s::BIGINT AS start_line, e::BIGINT AS end_line FROM r""")
def leftover_runs(spark: SparkSession, d: str) -> DataFrame:
    r = chunking.line_runs(table(spark, d, "documents"), "text", 10, "doc_id")
    return r.select("doc_id", n(F.col("run_no")).alias("run_no"), n(F.col("start_line")).alias("start_line"), n(F.col("end_line")).alias("end_line"))


@query("""
    WITH c AS (SELECT chunk_key AS k, repo, file_path, start_line AS s, end_line + 1 AS e FROM code_chunks WHERE start_line IS NOT NULL AND end_line + 1 >= start_line)
    SELECT a.k AS a, b.k AS b, a.s <= b.s AND a.e >= b.e AS contains, true AS overlaps FROM c a JOIN c b ON a.repo = b.repo AND a.file_path = b.file_path AND a.k <> b.k AND greatest(a.s, b.s) < least(a.e, b.e)""")
def range_join(spark: SparkSession, d: str) -> DataFrame:
    return chunking.range_relations(table(spark, d, "code_chunks"), "chunk_key", ["repo", "file_path"])


@query(f"""SELECT chunk_key, {CID} AS chunk_id, md5({strip_sql("'### File: ' || file_path || ' L' || start_line || '-' || end_line || ' [' || chunk_type || ']' || CASE WHEN length(parent_class) > 0 THEN ' class=' || parent_class ELSE '' END || chr(10) || coalesce(text, '')")}) AS text_md5 FROM code_chunks""")
def chunk_headers(spark: SparkSession, d: str) -> DataFrame:
    c = [F.col(x) for x in ("file_path", "start_line", "end_line", "chunk_type")]
    return table(spark, d, "code_chunks").select("chunk_key", chunking.chunk_id(*c).alias("chunk_id"), F.md5(chunking.retrieval_text(*c, F.col("parent_class"), F.col("text"))).alias("text_md5"))


@query(f"SELECT repo, {CID} AS chunk_id, min(chunk_key) AS chunk_key FROM code_chunks GROUP BY ALL")
def chunk_pool(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "code_chunks").withColumn("chunk_id", chunking.chunk_id(F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("chunk_type")))
    return chunking.first_by_id(c.select("repo", "chunk_id", "chunk_key"), ["repo", "chunk_id"], ["chunk_key"]).select("repo", "chunk_id", "chunk_key")


@query(f"SELECT repo, file_path, substr(sha256(string_agg({CID}, '' ORDER BY chunk_key)), 1, 16) AS fingerprint FROM code_chunks GROUP BY ALL")
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "code_chunks").withColumn("chunk_id", chunking.chunk_id(F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("chunk_type")))
    return chunking.fingerprint(c, ["repo", "file_path"], "chunk_id", ["chunk_key"])


@query(f"""WITH h AS (SELECT sha256(coalesce({CID}, '')) AS h FROM code_chunks), p AS (SELECT substr(h, 1, 3) AS slice, sha256(string_agg(h, '' ORDER BY h)) AS p FROM h GROUP BY 1)
    SELECT substr(sha256(string_agg(p, '' ORDER BY slice)), 1, 16) AS fingerprint FROM p""")
def index_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "code_chunks").withColumn("chunk_id", chunking.chunk_id(F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("chunk_type")))
    return chunking.index_fingerprint(c, "chunk_id")


@query()
def py_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Entity chunks of all Python files among the cross-file contexts."""
    files = table(spark, d, "loader_samples").select("sample_id", F.explode("crossfile_context").alias("path", "content")).filter(F.col("path").endswith(".py"))
    return entities.entity_chunks(files, ["sample_id"], "path", "content")


def source_files(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "documents").filter(F.col("code_lang").isin("py", "java", "ts", "cs"))
    return files.withColumn("path", F.concat(F.col("repo"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.col("code_lang")))


@query()
def structural_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of at most 400 characters with one node of overlap, expanded, of all source files among the documents that there is a tree for."""
    return structural.structural_chunks(source_files(spark, d), "doc_id", "path", "text", 400, 1, True)


@query(r"""SELECT doc_id::VARCHAR AS doc, strlen(regexp_replace(text, '[ \t\n\r\x0b\x0c]', '', 'g'))::BIGINT AS covered FROM documents WHERE code_lang IN ('java', 'ts', 'cs') AND regexp_matches(text, '[^ \t\n\r\x0b\x0c]')""")
def structural_cover(spark: SparkSession, d: str) -> DataFrame:
    """What of each Java, C# and TypeScript file is in its windows of at most 120 characters, or a token too large for one: all of it but white space."""
    files = source_files(spark, d).filter("code_lang <> 'py'")
    windows = structural.structural_chunks(files, "doc_id", "path", "text", 120).select("doc", t.nws_bytes(F.col("content")).alias("n"))
    large = structural.node_table(files, "doc_id", "text", path="path").filter("leaf and nws > 120").select("doc", F.col("nws").alias("n"))
    return windows.unionByName(large).groupBy("doc").agg(F.sum("n").alias("covered")).filter("covered > 0")


@query()
def ast_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by type over the trees of all source files among the documents that there is a tree for."""
    nodes = structural.node_table(source_files(spark, d), "doc_id", "text", path="path")
    return nodes.groupBy("type").agg(F.count("*").alias("n"), F.sum("nws").alias("size"))


# sources and packing


@query("""WITH f AS (SELECT event_id, event_type = 'signup' AS first FROM events), r AS (SELECT event_id, sum(first::INT) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS repo_id FROM f)
    SELECT repo_id::BIGINT AS repo_id, count(*) AS n_files FROM r GROUP BY 1 HAVING count(*) >= 2""")
def repo_islands(spark: SparkSession, d: str) -> DataFrame:
    """Events as files: a signup begins a repository."""
    rows = readers.islands(table(spark, d, "events").select("event_id", "event_type"), "event_id", F.col("event_type") == "signup")
    return rows.groupBy("repo_id").agg(F.count("*").alias("n_files")).filter("n_files >= 2")


@query("""
    WITH v AS (SELECT item_id, crossfile_context AS raw, ltrim(crossfile_context) AS l FROM eval_rows WHERE json_valid(crossfile_context)),
    m AS (SELECT item_id, unnest(json_keys(raw)) AS path, raw FROM v WHERE starts_with(l, '{')),
    a AS (SELECT item_id, unnest(from_json(raw, '["JSON"]')) AS x, unnest(range(len(from_json(raw, '["JSON"]')))) AS i FROM v WHERE starts_with(l, '[')),
    b AS (SELECT item_id, json_extract_string(x, '$.path') AS path, arg_max(coalesce(json_extract_string(x, '$.text'), ''), i) AS content FROM a WHERE json_type(x) = 'OBJECT' AND json_extract_string(x, '$.path') IS NOT NULL GROUP BY ALL)
    SELECT item_id, path, length(coalesce(json_extract_string(raw, '$."' || path || '"'), ''))::BIGINT AS n_chars FROM m
    UNION ALL SELECT item_id, path, length(content)::BIGINT AS n_chars FROM b""")
def crossfile_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "eval_rows").select("item_id", F.explode(readers.crossfile_pairs(F.col("crossfile_context"))).alias("path", "content"))
    return rows.select("item_id", "path", n(F.length(t.text(F.col("content")))).alias("n_chars"))


@query(f"""
    WITH f AS (SELECT sample_id, e.key AS path, coalesce(e.value, '') AS content FROM (SELECT sample_id, unnest(map_entries(crossfile_context)) AS e FROM loader_samples)),
    s AS (SELECT *, length('### File: ' || path || ' ###') + 1 AS head, length('### File: ' || path || ' ###') + 3 + length(content) AS size, row_number() OVER w AS pos, sum(length('### File: ' || path || ' ###') + 3 + length(content)) OVER w AS ends FROM f WINDOW w AS (PARTITION BY sample_id ORDER BY length(content), path)),
    o AS (SELECT *, min(CASE WHEN ends > 3000 THEN pos END) OVER (PARTITION BY sample_id) AS over FROM s)
    SELECT sample_id, count(*) FILTER (WHERE over IS NULL OR pos < over) AS included, count(*) FILTER (WHERE pos = over AND 3000 - (ends - size) > head) AS truncated,
        md5(coalesce({strip_sql("string_agg('### File: ' || path || ' ###' || chr(10) || CASE WHEN over IS NULL OR pos < over THEN content ELSE substr(content, 1, (3000 - (ends - size) - head)::INT) END || chr(10) || chr(10), '' ORDER BY pos) FILTER (WHERE over IS NULL OR pos < over OR pos = over AND 3000 - (ends - size) > head)")}, '')) AS text_md5 FROM o GROUP BY sample_id""")
def crossfile_pack(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "loader_samples").select("sample_id", F.explode("crossfile_context").alias("path", "content"))
    return packing.crossfile_pack(files, "sample_id", 3000).select("sample_id", "included", "truncated", F.md5("context").alias("text_md5"))


@query("""SELECT item_id, coalesce(task_id, '') <> '' AS named, md5(coalesce(left_context, '')) AS left_md5, md5(coalesce(right_context, '')) AS right_md5, md5(coalesce(groundtruth, '')) AS target_md5 FROM eval_rows""")
def eval_set(spark: SparkSession, d: str) -> DataFrame:
    r = readers.eval_rows(table(spark, d, "eval_rows"))
    return r.select("item_id", (t.text(F.col("task_id")) != "").alias("named"), F.md5("left_context").alias("left_md5"), F.md5("right_context").alias("right_md5"), F.md5("groundtruth").alias("target_md5"))


# queries from left contexts


def rstrip_sql(column: str) -> str:
    return f"regexp_replace(coalesce({column}, ''), '{WS}+$', '')"


#: A list without repetitions, in the order of first places.
ONCE = "list_filter({0}, lambda w, i: list_position({0}, w) = i)"
KEYWORD_SQL = ", ".join(f"'{k}'" for k in t.KEYWORDS)
SPLIT_R = SPLIT.format("r").replace("coalesce(r, '')", "r")


@query(rf"""
    WITH a AS (SELECT sample_id, {rstrip_sql('left_context')} AS r, {SPLIT.format('left_context')} AS p FROM training_samples),
    b AS (SELECT sample_id, r, {LINES.format('p')} AS x, ({SPLIT_R})[-1] AS last FROM a),
    c AS (SELECT sample_id, r, regexp_replace(last, '{WS}+$', '') AS last, x[-80:] AS y, array_to_string(x[-80:], chr(10)) AS tail FROM b),
    e AS (SELECT sample_id, tail, regexp_extract(r, '[_a-zA-Z][_a-zA-Z0-9]*$') AS prefix, regexp_extract(last, '([_a-zA-Z][_a-zA-Z0-9]*)\s*\.\s*([_a-zA-Z][_a-zA-Z0-9]*)?$', 1) AS member_owner,
        regexp_extract(last, '([_a-zA-Z][_a-zA-Z0-9]*)\s*\.\s*([_a-zA-Z][_a-zA-Z0-9]*)?$', 2) AS member_prefix,
        list_filter(flatten(list_transform(list_filter(list_transform(y, lambda s: regexp_replace(s, '^{WS}+', '')), lambda l: starts_with(l, 'import ') OR starts_with(l, 'from ')), lambda l: regexp_extract_all(l, '[_a-zA-Z][_a-zA-Z0-9]*'))), lambda w: w NOT IN ('import', 'from', 'as')) AS imp,
        list_filter(regexp_extract_all(tail, '[_a-zA-Z][_a-zA-Z0-9]*'), lambda w: w NOT IN ({KEYWORD_SQL})) AS ids,
        flatten(list_transform(regexp_extract_all(tail, '[_a-zA-Z][_a-zA-Z0-9]*\s*=\s*[A-Z][_a-zA-Z0-9]*\s*\('), lambda m: [regexp_extract(m, '^[_a-zA-Z0-9]+'), regexp_extract(m, '=\s*([A-Z][_a-zA-Z0-9]*)', 1)])) AS made FROM c),
    g AS (SELECT *, {ONCE.format("imp")} AS import_hints, {ONCE.format("ids")} AS identifiers, list_concat(made, list_filter(ids, lambda w: regexp_matches(w, '^[A-Z]'))) AS cls FROM e), h AS (SELECT *, {ONCE.format("cls")} AS class_hints FROM g)
    SELECT sample_id, prefix, member_owner, member_prefix, len(class_hints)::BIGINT AS n_class_hints, len(import_hints)::BIGINT AS n_import_hints, len(identifiers)::BIGINT AS n_identifiers,
        md5({strip_sql("""concat_ws(chr(10), '### Intent sketch', CASE WHEN prefix <> '' THEN 'incomplete_prefix: ' || prefix END, CASE WHEN member_owner <> '' THEN 'member_owner: ' || member_owner END, CASE WHEN member_prefix <> '' THEN 'member_prefix: ' || member_prefix END,
            CASE WHEN len(class_hints) > 0 THEN 'class_hints: ' || array_to_string(class_hints[:12], ' ') END, CASE WHEN len(import_hints) > 0 THEN 'imports: ' || array_to_string(import_hints[:12], ' ') END,
            CASE WHEN len(identifiers) > 0 THEN 'local_identifiers: ' || array_to_string(identifiers[:40], ' ') END, '### Left context tail', tail)""")}) AS query_md5 FROM h""")
def intent_sketch(spark: SparkSession, d: str) -> DataFrame:
    s = intent.with_sketch(table(spark, d, "training_samples").select("sample_id", "left_context"), "left_context", "s")
    return s.select("sample_id", "s.prefix", "s.member_owner", "s.member_prefix", *(n(F.size(f"s.{c}")).alias(f"n_{c}") for c in ("class_hints", "import_hints", "identifiers")), F.md5("s.query").alias("query_md5"))


@query()
def cursor_scope(spark: SparkSession, d: str) -> DataFrame:
    """The scope by tree at the middle line of every document that is a source file."""
    rows = table(spark, d, "documents").filter("code_lang is not null").select("doc_id", "text", F.concat(F.lit("x."), "code_lang").alias("path"), F.floor((F.size(t.lines(F.col("text"))) + 1) / 2).cast("int").alias("cursor"))
    s = intent.with_scope(rows, "text", "cursor", "s", path_col="path")
    return s.select("doc_id", F.size("s.imports").alias("n_imports"), "s.parent_class", "s.parent_function", F.size("s.local_variables").alias("n_locals"), "s.cursor_line", F.md5(intent.scope_prompt(F.col("s"), F.col("path"))).alias("prompt_md5"))


@query("SELECT sample_id, md5(coalesce(left_context, '')) AS query_md5 FROM training_samples")
def raw_query(spark: SparkSession, d: str) -> DataFrame:
    return intent.retrieval_query(table(spark, d, "training_samples"), "left_context", "raw").select("sample_id", F.md5("query").alias("query_md5"))


@query(rf"""
    WITH s AS (SELECT doc_id, {SPLIT.format("regexp_replace(coalesce(text, ''), chr(13) || chr(10) || '?', chr(10), 'g')")} AS p FROM documents), l AS (SELECT doc_id, {LINES.format('p')} AS x FROM s),
    o AS (SELECT doc_id, len({LINES.format('q')}) AS m FROM (SELECT doc_id, {SPLIT.format('text')} AS q FROM documents)),
    c AS (SELECT doc_id, x, CASE WHEN len(x) = 0 OR (m + 1) // 2 <= 0 THEN 0 WHEN (m + 1) // 2 >= len(x) THEN len(x) - 1 ELSE (m + 1) // 2 - 1 END AS pos FROM l JOIN o USING (doc_id)),
    a AS (SELECT doc_id, pos, x[1:pos + 1] AS above FROM c),
    h AS (SELECT doc_id, pos, list_filter(above, lambda s: starts_with(regexp_replace(s, '^{WS}+', ''), 'class ') AND suffix(regexp_replace(s, '{WS}+$', ''), ':')) AS cls, list_filter(above, lambda s: starts_with(regexp_replace(s, '^{WS}+', ''), 'def ') AND suffix(regexp_replace(s, '{WS}+$', ''), ':')) AS fun,
        list_filter(above, lambda s: starts_with(regexp_replace(s, '^{WS}+', ''), 'import ') OR starts_with(regexp_replace(s, '^{WS}+', ''), 'from ') AND contains({strip_sql('s')}, ' import ')) AS imp FROM a)
    SELECT doc_id, len(list_distinct(list_transform(imp, lambda s: regexp_replace(s, '{WS}+$', ''))))::BIGINT AS n_imports, regexp_replace(cls[-1], '{WS}+$', '') AS parent_class, regexp_replace(fun[-1], '{WS}+$', '') AS parent_function, (pos + 1)::BIGINT AS cursor_line FROM h""")
def scope_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The scope at the middle line of every document."""
    rows = table(spark, d, "documents").select("doc_id", "text", F.floor((F.size(t.lines(F.col("text"))) + 1) / 2).cast("int").alias("cursor"))
    s = intent.with_scope(rows, "text", "cursor", "s", tree=False)
    return s.select("doc_id", n(F.size("s.imports")).alias("n_imports"), "s.parent_class", "s.parent_function", n(F.col("s.cursor_line")).alias("cursor_line"))


@query(rf"""
    WITH a AS (SELECT sample_id, coalesce(left_context, '') AS c, {rstrip_sql('left_context')} AS r FROM training_samples), b AS (SELECT sample_id, c, ({SPLIT_R})[-1] AS last FROM a),
    f AS (SELECT sample_id, contains(last, '.')::INT::DOUBLE AS member, regexp_matches(last, '[_a-zA-Z][_a-zA-Z0-9]*_$')::INT::DOUBLE AS incomplete, least(1.0, length(c) / 2000.0)::DOUBLE AS long FROM b)
    SELECT sample_id, member, incomplete, round(long, 6) AS long, round(1 / (1 + exp(-(0.4 * member + 0.3 * incomplete))), 6) AS p FROM f""")
def gate_features(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("left_context")
    a, b, x = intent.gate_features(c)
    return table(spark, d, "training_samples").select("sample_id", a.alias("member"), b.alias("incomplete"), F.round(x, 6).alias("long"), F.round(intent.gate_probability(c), 6).alias("p"))


# retrieval


def chunk_table(spark: SparkSession, d: str, even: bool = False) -> DataFrame:
    """even: in parts of a size, for work on large row groups."""
    c = table(spark, d, "code_chunks")
    c = (spread(c) if even else c).withColumn("chunk_id", chunking.chunk_id(F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("chunk_type")))
    return c.select(
        F.col("chunk_key").alias("cid"), F.col("repo").alias("grp"), F.col("chunk_key").alias("pos"), "chunk_id", "chunk_type", "text", "defined_symbols", "used_symbols", "call_names", "method_names",
        ranking.symbol_set(ranking.LEXICAL).alias("tokens"), ranking.symbol_set(ranking.ORACLE).alias("symbols"),
    )


def search_samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "training_samples")


def left_queries(spark: SparkSession, d: str, even: bool = False) -> DataFrame:
    rows = search_samples(spark, d)
    return (spread(rows) if even else rows).select(F.col("sample_id").alias("qid"), F.col("repo").alias("grp"), t.identifier_set(F.col("left_context")).alias("tokens"), t.trailing_identifier(F.col("left_context")).alias("prefix"))


def targets(spark: SparkSession, d: str) -> DataFrame:
    return search_samples(spark, d).select(F.col("sample_id").alias("qid"), F.col("repo").alias("grp"), t.identifier_set(F.col("target")).alias("tokens"))


def pooled(df: DataFrame) -> DataFrame:
    return df.withColumn("grp", F.lit(""))


SEARCH_SQL = f"""
    q AS (SELECT sample_id AS qid, repo, list_distinct({IDS.format('left_context')}) AS toks FROM training_samples),
    c AS (SELECT chunk_key AS cid, repo, {BONUS} AS bonus, {LEX} AS toks, {ORA} AS symbols, {CID} AS chunk_id FROM code_chunks)"""
LEXICAL_SQL = f"""{SEARCH_SQL},
    s AS (SELECT qid, cid, CASE WHEN len(q.toks) > 0 THEN 1.5 * len(list_intersect(q.toks, c.toks)) + bonus ELSE 0 END AS score FROM q JOIN c USING (repo)),
    lexical AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) AS rk, cid, score FROM s QUALIFY rk <= {{}})"""


@query(f"WITH {LEXICAL_SQL.format(3)} SELECT qid, rk::BIGINT AS rk, cid, round(score, 6)::DOUBLE AS score FROM lexical")
def lexical_topk(spark: SparkSession, d: str) -> DataFrame:
    r = ranking.lexical_top_k(left_queries(spark, d), chunk_table(spark, d), 3)
    return r.select("qid", n(F.col("rk")).alias("rk"), "cid", F.round("score", 6).alias("score"))


@query(rf"""WITH {SEARCH_SQL},
    p AS (SELECT sample_id AS qid, regexp_extract({rstrip_sql('left_context')}, '[_a-zA-Z][_a-zA-Z0-9]*$') AS prefix FROM training_samples),
    f AS (SELECT x AS token, 0.25 / count(*) AS w FROM (SELECT unnest(toks) AS x FROM c) GROUP BY 1),
    l AS (SELECT cid, sum(w) AS learned FROM (SELECT cid, unnest(toks) AS token FROM c) JOIN f USING (token) GROUP BY 1),
    s AS (SELECT qid, cid, chunk_id, 1.5 * len(list_intersect(q.toks, c.toks)) + coalesce(learned, 0) + bonus + CASE WHEN prefix <> '' AND len(list_filter(symbols, lambda x: starts_with(x, prefix))) > 0 THEN 2.0 ELSE 0.0 END AS score
        FROM q JOIN p USING (qid) JOIN c USING (repo) LEFT JOIN l USING (cid)),
    r AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id DESC, cid DESC) AS rk, cid, score FROM s QUALIFY rk <= 3)
    SELECT qid, rk::BIGINT AS rk, cid, round(score, 6)::DOUBLE AS score FROM r""")
def proxy_rank(spark: SparkSession, d: str) -> DataFrame:
    """Ranking with token weights of 0.25 / (chunks that have the token), as learned ones would stand."""
    c = chunk_table(spark, d)
    weights = c.select(F.explode("tokens").alias("token")).groupBy("token").agg((0.25 / F.count("*")).alias("w"))
    r = ranking.proxy_top_k(left_queries(spark, d), c, weights, 3)
    return r.select("qid", n(F.col("rk")).alias("rk"), "cid", F.round("score", 6).alias("score"))


ORACLE_SQL = f"""
    g AS (SELECT sample_id AS qid, repo, list_distinct({IDS.format('target')}) AS goal FROM training_samples),
    h AS (SELECT qid, cid, len(list_intersect(goal, symbols)) AS overlap FROM g CROSS JOIN c),
    oracle AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY overlap DESC, cid) AS rk, cid, overlap FROM h WHERE overlap > 0 QUALIFY rk <= 3)"""


@query(f"WITH {SEARCH_SQL}, {ORACLE_SQL} SELECT qid, rk::BIGINT AS rk, cid, overlap::BIGINT AS overlap FROM oracle")
def oracle_topk(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of any repository that hit the target; a constant group makes all chunks one pool."""
    return ranking.oracle_top_k(*(pooled(x) for x in (targets(spark, d), chunk_table(spark, d))), 3).select("qid", n(F.col("rk")).alias("rk"), "cid", n(F.col("overlap")).alias("overlap"))


HARD_SQL = f"""
    free AS (SELECT l.qid, l.rk AS place, l.cid FROM lexical l JOIN g USING (qid) JOIN c ON c.cid = l.cid WHERE len(goal) > 0 AND len(list_intersect(goal, symbols)) = 0),
    hard AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY place) AS rk, cid FROM free QUALIFY rk <= 3)"""


@query(f"WITH {LEXICAL_SQL.format(20)}, {ORACLE_SQL}, {HARD_SQL} SELECT qid, rk::BIGINT AS rk, cid FROM hard")
def hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    c = chunk_table(spark, d)
    r = ranking.hard_negatives(ranking.lexical_top_k(left_queries(spark, d), c, 20), targets(spark, d), c, 3)
    return r.select("qid", n(F.col("rk")).alias("rk"), "cid")


@query("""
    WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL), m AS (SELECT vec_id, list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-8)) AS u FROM v),
    s AS (SELECT q.vec_id AS q_id, c.vec_id, list_dot_product(q.u, c.u) AS score FROM m q CROSS JOIN m c WHERE q.vec_id % 100 = 0)
    SELECT q_id, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 12) DESC, vec_id) AS rk, vec_id, round(score, 5) AS score FROM s QUALIFY rk <= 10""")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").filter("embedding is not null").select(F.col("vec_id").alias("cid"), F.col("vec_id").alias("pos"), dense.normalised(F.col("embedding")).alias("vec"))
    q = v.filter("cid % 100 = 0").select(F.col("cid").alias("qid"), F.col("vec").alias("qvec"))
    r = dense.dense_top_k(q, v, 10)
    return r.select(F.col("qid").alias("q_id"), n(F.col("rk")).alias("rk"), F.col("cid").alias("vec_id"), F.round("score", 5).alias("score"))


@query("""
    WITH i AS (SELECT vec_id FROM embeddings UNION ALL SELECT -1 - vec_id FROM embeddings WHERE vec_id % 10 = 0)
    SELECT i.vec_id, e.embedding IS NOT NULL AS found, CASE WHEN e.embedding IS NULL THEN 0.0 ELSE round(sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 5) END AS norm FROM i LEFT JOIN embeddings e USING (vec_id)""")
def vectors_by_id(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("cid"), F.col("embedding").alias("vec"))
    ids = v.select(F.col("cid").alias("id")).unionByName(v.filter("cid % 10 = 0").select((-1 - F.col("cid")).alias("id")))
    return dense.vectors_by_id(ids, v, 64).select(F.col("id").alias("vec_id"), "found", F.round(dense.norm(F.col("vec")), 5).alias("norm"))


@query(f"SELECT q_id, round(avg(score), 4) AS mean_sim FROM ({ORACLES['dense_topk']}) GROUP BY 1")
def context_mean_sim(spark: SparkSession, d: str) -> DataFrame:
    r = dense_topk(spark, d).withColumnRenamed("q_id", "qid")
    return dense.mean_similarity(r).select(F.col("qid").alias("q_id"), F.round("mean_sim", 4).alias("mean_sim"))


UNIFORM_SQL = "(('0x' || substr(sha256({}), 1, 12))::BIGINT + 0.5) / 281474976710656.0"


@query(f"""
    WITH s AS (SELECT q_id, vec_id, score FROM ({ORACLES['dense_topk']})), t(draw, temp) AS (VALUES (0, 0.0), (1, 0.05), (2, 0.5)),
    k AS (SELECT q_id, draw, vec_id, CASE WHEN temp < 1e-6 THEN score ELSE score / temp - ln(-ln({UNIFORM_SQL.format("'11|' || q_id || '|' || draw || '|' || vec_id")})) END AS key FROM s CROSS JOIN t)
    SELECT q_id, draw::BIGINT AS draw, row_number() OVER (PARTITION BY q_id, draw ORDER BY key DESC, vec_id) AS rk, vec_id FROM k QUALIFY rk <= 3""")
def temperature_sample(spark: SparkSession, d: str) -> DataFrame:
    s = dense_topk(spark, d).select(F.col("q_id").alias("qid"), F.col("vec_id").alias("cid"), "score")
    r = dense.temperature_sample(s, [0.0, 0.05, 0.5], 3, 11)
    return r.select(F.col("qid").alias("q_id"), n(F.col("draw")).alias("draw"), n(F.col("rk")).alias("rk"), F.col("cid").alias("vec_id"))


# strategies, utilities, preferences


def strategy_rows(spark: SparkSession, d: str) -> DataFrame:
    c = written(chunk_table(spark, d, True).select("cid", "grp", "pos", "chunk_type", "tokens", "symbols"))
    pool = written(ranking.lexical_top_k(written(left_queries(spark, d, True).select("qid", "grp", "tokens")), c, 20).select("qid", "rk", "cid"))
    goals = targets(spark, d)
    lists = {"bm25": pool.filter("rk <= 3"), "hard_neg": ranking.hard_negatives(pool, goals, c, 3), "oracle": ranking.oracle_top_k(pooled(goals), pooled(c), 3)}
    lists = {k: v.select(F.col("qid").alias("sid"), "rk", "cid") for k, v in lists.items()}
    return strategies.strategy_union(search_samples(spark, d).select(F.col("sample_id").alias("sid")), lists)


STRATEGY_SQL = f"""{LEXICAL_SQL.format(20)}, {ORACLE_SQL}, {HARD_SQL},
    strategies AS (SELECT qid AS sid, 'stop' AS strategy, 0 AS pos, 0 AS rk, NULL AS cid FROM q UNION ALL SELECT qid, 'bm25', 1, rk, cid FROM lexical WHERE rk <= 3
        UNION ALL SELECT qid, 'hard_neg', 4, rk, cid FROM hard UNION ALL SELECT qid, 'oracle', 5, rk, cid FROM oracle)"""


@query(f"WITH {STRATEGY_SQL} SELECT sid, strategy, rk::BIGINT AS rk, cid FROM strategies")
def strategy_union(spark: SparkSession, d: str) -> DataFrame:
    return strategy_rows(spark, d).select("sid", "strategy", n(F.col("rk")).alias("rk"), "cid")


NLL_SQL = f"""
    x AS (SELECT DISTINCT sid, strategy, pos FROM {{strategies}}),
    smp AS (SELECT sample_id AS sid, {IDS.format('left_context')} AS l, {IDS.format('target')} AS t FROM training_samples),
    ctx AS (SELECT sid, strategy, unnest({IDS.format('text')}) AS token FROM {{strategies}} s JOIN code_chunks k ON k.chunk_key = s.cid UNION ALL SELECT sid, strategy, unnest(l) FROM x JOIN smp USING (sid)),
    cnt AS (SELECT sid, strategy, token, count(*) AS c FROM ctx GROUP BY ALL), tgt AS (SELECT sid, strategy, token, count(*) AS t FROM (SELECT sid, strategy, unnest(t) AS token FROM x JOIN smp USING (sid)) GROUP BY ALL),
    alls AS (SELECT sid, strategy, token, coalesce(c, 0) AS c, coalesce(t, 0) AS t FROM cnt FULL JOIN tgt USING (sid, strategy, token)), tot AS (SELECT sid, strategy, sum(c) AS n, count(*) AS v FROM alls GROUP BY ALL),
    nll AS (SELECT x.sid, x.strategy, x.pos, coalesce(y.nll, 0.0) AS nll FROM x LEFT JOIN (SELECT sid, strategy, sum(t * -ln((c + 1.0) / (n + v))) / sum(t) AS nll FROM alls JOIN tot USING (sid, strategy) WHERE t > 0 GROUP BY ALL) y USING (sid, strategy))"""
UTILITY_SQL = f"""WITH {STRATEGY_SQL}, {NLL_SQL.format(strategies='strategies')},
    u AS (SELECT n.sid, n.strategy, n.pos, n.nll, CASE WHEN n.strategy = 'stop' THEN 0.0 ELSE s.nll - n.nll END AS utility FROM nll n JOIN nll s ON s.sid = n.sid AND s.strategy = 'stop'),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY round(utility, 9) DESC, round(nll, 9), pos) AS rk FROM u)"""


@query()
def strategy_fanout(spark: SparkSession, d: str) -> DataFrame:
    """What all six strategies offer every sample, with the default models; rows by strategy."""
    rows = table(spark, d, "training_samples").select(F.col("sample_id").alias("sid"), F.col("repo").alias("grp"), "left_context", "target")
    return neural.fan_out(neural.DefaultModels(), rows, chunk_table(spark, d, True), NeuralConfig()).groupBy("strategy").agg(F.count("*").alias("n"), F.count_distinct("sid").alias("samples"))


def ranked_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = written(strategy_rows(spark, d))
    samples = spread(search_samples(spark, d).select(F.col("sample_id").alias("sid"), "left_context", "target"))
    contexts = rows.join(spread(table(spark, d, "code_chunks").select(F.col("chunk_key").alias("cid"), "text")), "cid", "left").select("sid", "strategy", "text")
    nll = utility.smoothed_unigram_nll(samples, contexts).withColumn("nll", F.round("nll", 9))
    return utility.utilities(rows.select("sid", "strategy", "pos", "is_stop").distinct().join(nll, ["sid", "strategy"]))


@query(f"{UTILITY_SQL} SELECT sid, strategy, round(nll, 5) AS nll, round(utility, 5) AS utility, rk::BIGINT AS rk FROM ranked")
def utility_scores(spark: SparkSession, d: str) -> DataFrame:
    return ranked_rows(spark, d).select("sid", "strategy", F.round("nll", 5).alias("nll"), F.round("utility", 5).alias("utility"), n(F.col("rk")).alias("rk"))


@query(f"""{UTILITY_SQL} SELECT sid, chosen, rejected, round(gap, 5) AS gap FROM (SELECT a.sid, a.strategy AS chosen, b.strategy AS rejected, a.utility - b.utility AS gap, row_number() OVER (PARTITION BY a.sid ORDER BY a.rk, b.rk) AS k
    FROM ranked a JOIN ranked b ON a.sid = b.sid AND a.rk < b.rk AND a.utility - b.utility >= 0.1) WHERE k <= 4""")
def preference_rows(spark: SparkSession, d: str) -> DataFrame:
    return utility.preference_pairs(written(ranked_rows(spark, d))).withColumn("gap", F.round("gap", 5))


@query(f"""{UTILITY_SQL}, b AS (SELECT * FROM ranked WHERE strategy <> 'stop' QUALIFY row_number() OVER (PARTITION BY sid ORDER BY rk) = 1)
    SELECT sid, utility > 0.05 AS retrieve_is_better, round(utility, 5) AS max_utility, strategy AS best_strategy FROM b""")
def gate_labels(spark: SparkSession, d: str) -> DataFrame:
    return utility.gate_labels(ranked_rows(spark, d)).withColumn("max_utility", F.round("max_utility", 5))


@query("SELECT concat_ws('>', chosen.strategy, rejected.strategy) AS pair_type, count(*) AS n FROM preference_pairs GROUP BY 1")
def pair_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return utility.pair_types(table(spark, d, "preference_pairs"), "chosen.strategy", "rejected.strategy")


@query(f"""WITH {LEXICAL_SQL.format(3)}, k3 AS (SELECT qid AS sid, rk, cid, count(*) OVER (PARTITION BY qid) AS m FROM lexical),
    sets AS (SELECT sid, 'full' AS strategy, 0 AS pos, cid FROM k3 WHERE m > 1 UNION ALL SELECT a.sid, 'without ' || a.rk, 0, b.cid FROM k3 a JOIN k3 b ON a.sid = b.sid AND a.rk <> b.rk WHERE a.m > 1), {NLL_SQL.format(strategies='sets')},
    gains AS (SELECT n.sid, round(n.nll, 9) - round(f.nll, 9) AS g FROM nll n JOIN nll f ON f.sid = n.sid AND f.strategy = 'full' WHERE n.strategy <> 'full')
    SELECT count(DISTINCT sid) AS sets, count(*) AS chunks, count(*) FILTER (WHERE g > 1e-12) AS positive, count(*) FILTER (WHERE g < -1e-12) AS negative, round(coalesce(avg(g), 0), 5) AS mean_contribution,
        round(coalesce(count(*) FILTER (WHERE g < -1e-12) / nullif(count(*), 0)::DOUBLE, 0), 5) AS noisy_fraction FROM gains""")
def leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    c = chunk_table(spark, d)
    top = written(ranking.lexical_top_k(left_queries(spark, d), c, 3).select(F.col("qid").alias("sid"), "rk", "cid"))
    sets = utility.without_each(top.join(c.select("cid", "text"), "cid").select("sid", "rk", "text"))
    samples = search_samples(spark, d).select(F.col("sample_id").alias("sid"), "left_context", "target")
    r = utility.leave_one_out(written(utility.smoothed_unigram_nll(samples, sets).withColumn("nll", F.round("nll", 9))))
    return r.select("sets", "chunks", "positive", "negative", F.round("mean_contribution", 5).alias("mean_contribution"), F.round("noisy_fraction", 5).alias("noisy_fraction"))


# quality, evaluation, policy


@query(rf"""
    WITH a AS (SELECT sample_id, list_distinct({IDS.format('left_context')}) AS p, list_distinct({IDS.format('target')}) AS t, regexp_replace({rstrip_sql('left_context')}, '^{WS}+', '') AS x, regexp_replace({rstrip_sql('target')}, '^{WS}+', '') AS y FROM training_samples),
    b AS (SELECT *, len(list_intersect(p, t))::DOUBLE AS m FROM a), c AS (SELECT *, CASE WHEN len(p) = 0 OR len(t) = 0 THEN 0 ELSE m / len(p) END AS pr, CASE WHEN len(p) = 0 OR len(t) = 0 THEN 0 ELSE m / len(t) END AS re FROM b)
    SELECT sample_id, (x = y)::INT::DOUBLE AS em, round(pr, 6)::DOUBLE AS p, round(re, 6)::DOUBLE AS r, round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 6)::DOUBLE AS f1 FROM c""")
def identifier_f1(spark: SparkSession, d: str) -> DataFrame:
    """The left context taken for a prediction of the target."""
    p, r, f = quality.identifier_scores(F.col("left_context"), F.col("target"))
    return table(spark, d, "training_samples").select("sample_id", quality.exact_match(F.col("left_context"), F.col("target")).alias("em"), F.round(p, 6).alias("p"), F.round(r, 6).alias("r"), F.round(f, 6).alias("f1"))


@query()
def composite_quality(spark: SparkSession, d: str) -> DataFrame:
    """The last line of the left context taken for a prediction of the target."""
    p, g = t.last_line(F.col("left_context")), F.col("target")
    rows = table(spark, d, "training_samples").select("sample_id", p.alias("p"), "target")
    sim = quality.edit_similarity(F.col("p"), g)
    return rows.select("sample_id", F.round(sim, 6).alias("edit"), F.round(quality.composite(F.col("p"), g), 6).alias("composite"), F.round(quality.proxy_quality(F.col("p"), g, F.array().cast("array<string>")), 6).alias("proxy"))


GATE_ROWS = "SELECT NOT chosen.is_stop AS l, 1 / (1 + exp(-chosen.utility)) AS p FROM preference_pairs WHERE chosen.is_stop IS NOT NULL AND chosen.utility IS NOT NULL AND NOT isnan(chosen.utility)"


def gate_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "preference_pairs").select((~F.col("chosen.is_stop")).alias("l"), F.when(~F.isnan("chosen.utility"), t.sigmoid(F.col("chosen.utility"))).alias("p"))


@query(f"""WITH r AS ({GATE_ROWS}), c AS (SELECT count(*) FILTER (WHERE l AND p >= 0.6) AS tp, count(*) FILTER (WHERE NOT l AND p >= 0.6) AS fp, count(*) FILTER (WHERE NOT l AND p < 0.6) AS tn, count(*) FILTER (WHERE l AND p < 0.6) AS fn, count(*) AS n FROM r),
    m AS (SELECT *, tp / greatest(1, tp + fp) AS pr, tp / greatest(1, tp + fn) AS re FROM c)
    SELECT tp, fp, tn, fn, round(pr, 6)::DOUBLE AS precision, round(re, 6)::DOUBLE AS recall, round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 6)::DOUBLE AS f1, n FROM m""")
def gate_metrics(spark: SparkSession, d: str) -> DataFrame:
    r = evaluation.gate_metrics(gate_rows(spark, d), F.col("l"), F.col("p"), 0.6)
    return r.select("tp", "fp", "tn", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "n")


@query(f"""WITH r AS ({GATE_ROWS}), k AS (SELECT l, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM r)
    SELECT round((sum(rk) FILTER (WHERE l) - count(*) FILTER (WHERE l) * (count(*) FILTER (WHERE l) + 1) / 2.0) / nullif(count(*) FILTER (WHERE l) * count(*) FILTER (WHERE NOT l), 0), 6)::DOUBLE AS auc FROM k""")
def gate_auc(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.auc(gate_rows(spark, d), F.col("l"), F.col("p")).select(F.round("auc", 6).alias("auc"))


@query(f"SELECT round(avg(p), 6) AS mean, round(coalesce(stddev_samp(p), 0), 6) AS std, round(avg((p >= 0.5)::INT), 6) AS rate FROM ({GATE_ROWS})")
def gate_stats(spark: SparkSession, d: str) -> DataFrame:
    r = gate_rows(spark, d).filter("l is not null and p is not null").agg(*evaluation.gate_stats(F.col("p")))
    return r.select(*(F.round(c, 6).alias(c) for c in ("mean", "std", "rate")))


@query("""SELECT source, round(CASE WHEN count(*) FILTER (WHERE n_chars IS NOT NULL) < 2 OR stddev_pop(n_chars) <= 1e-12 OR stddev_pop(len(regexp_extract_all(coalesce(text, ''), '[_a-zA-Z][_a-zA-Z0-9]*'))) FILTER (WHERE n_chars IS NOT NULL) <= 1e-12 THEN 0
    ELSE corr(n_chars, len(regexp_extract_all(coalesce(text, ''), '[_a-zA-Z][_a-zA-Z0-9]*'))) END, 5)::DOUBLE AS r FROM documents GROUP BY 1""")
def safe_corr(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("source", "n_chars", F.size(t.identifiers(F.col("text"))).alias("k"))
    return rows.groupBy("source").agg(F.round(evaluation.safe_corr(F.col("n_chars"), F.col("k")), 5).alias("r"))


POLICY_ROWS = f"""
    a AS (SELECT sample_id, contains(({SPLIT_R})[-1], '.') AS retrieve, list_distinct({IDS.format('left_context')}) AS p, list_distinct({IDS.format('target')}) AS g, length(coalesce(left_context, '')) AS ll, length(coalesce(target, '')) AS lt FROM (SELECT *, {rstrip_sql('left_context')} AS r FROM training_samples)),
    m AS (SELECT retrieve, (lt > 40)::INT::DOUBLE AS em, least(ll, 400) / 400.0 AS edit, len(list_intersect(p, g)) / greatest(1, len(g))::DOUBLE AS f1, lt::DOUBLE AS nll FROM a),
    pol(policy) AS (VALUES ('learned'), ('always_retrieve'), ('always_skip')),
    u AS (SELECT policy, m.*, CASE policy WHEN 'learned' THEN retrieve ELSE policy = 'always_retrieve' END AS yes FROM m CROSS JOIN pol),
    variants AS (SELECT policy, avg(CASE WHEN yes THEN em ELSE 0 END) AS em, avg(CASE WHEN yes THEN edit ELSE edit / 2 END) AS edit, avg(CASE WHEN yes THEN f1 ELSE 0 END) AS f1, avg(CASE WHEN yes THEN nll ELSE nll + 1 END) AS nll, avg(yes::INT) AS rate FROM u GROUP BY 1)"""


def variants(spark: SparkSession, d: str) -> DataFrame:
    """Policies over stand-in measures: no generator is at hand, so measures are lengths and overlaps of the samples' own texts."""
    a = table(spark, d, "training_samples")
    p, g = t.identifier_set(F.col("left_context")), t.identifier_set(F.col("target"))
    ll, lt = F.length(t.text(F.col("left_context"))), F.length(t.text(F.col("target")))
    edit, f1 = F.least(ll, F.lit(400)) / 400.0, F.size(F.array_intersect(p, g)) / F.greatest(F.lit(1), F.size(g))
    rows = a.select(
        t.last_line(t.rstrip(F.col("left_context"))).contains(".").alias("retrieve"), (lt > 40).cast("double").alias("em_with"), F.lit(0.0).alias("em_without"), edit.alias("edit_with"), (edit / 2).alias("edit_without"),
        f1.alias("f1_with"), F.lit(0.0).alias("f1_without"), lt.cast("double").alias("nll_with"), (lt + 1.0).alias("nll_without"),
    )
    return evaluation.policy_variants(rows)


@query(f"WITH {POLICY_ROWS} SELECT policy, round(em, 6) AS em, round(edit, 6)::DOUBLE AS edit, round(f1, 6) AS f1, round(nll, 4) AS nll, round(rate, 6) AS rate FROM variants")
def policy_variants(spark: SparkSession, d: str) -> DataFrame:
    return variants(spark, d).select("policy", *(F.round(c, 4 if c == "nll" else 6).alias(c) for c in ("em", "edit", "f1", "nll", "rate")))


@query(f"""WITH {POLICY_ROWS}, x AS (SELECT l.em - a.em AS delta_em, l.edit - a.edit AS delta_edit, l.f1 - a.f1 AS delta_f1, a.rate - l.rate AS saved FROM variants l JOIN variants a ON l.policy = 'learned' AND a.policy = 'always_retrieve')
    SELECT round(delta_em, 6) AS delta_em, round(delta_edit, 6)::DOUBLE AS delta_edit, round(delta_f1, 6) AS delta_f1, round(saved, 6) AS rate_reduction,
        CASE WHEN least(delta_em, delta_edit, delta_f1) >= 0 AND greatest(delta_em, delta_edit, delta_f1) > 0 THEN 'adaptive_quality_improvement'
             WHEN least(delta_em, delta_edit, delta_f1) >= -0.01 - 1e-12 AND saved >= 0.2 - 1e-12 THEN 'compute_reduction_without_quality_loss' ELSE 'gate_claim_not_supported' END AS status FROM x""")
def gate_claim(spark: SparkSession, d: str) -> DataFrame:
    r = evaluation.gate_claim(variants(spark, d))
    return r.select(*(F.round(c, 6).alias(c) for c in ("delta_em", "delta_edit", "delta_f1", "rate_reduction")), "status")


# sampling


@query("""WITH h AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('13|' || doc_id)) AS place, count(*) OVER () AS n FROM documents)
    SELECT doc_id, CASE WHEN place <= least(greatest(1, (n * 0.1)::DOUBLE::INT), 100, n - 1) THEN 'eval' ELSE 'train' END AS split FROM h""")
def train_eval_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.train_eval_split(table(spark, d, "documents").select("doc_id"), "doc_id")


@query("""SELECT doc_id, epoch, (row_number() OVER (PARTITION BY epoch ORDER BY sha256('13|' || epoch || '|' || doc_id)) - 1) // 4 AS batch_no FROM documents CROSS JOIN (VALUES (0), (1)) AS e(epoch)""")
def epoch_batches(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    both = [sampling.epoch_batches(docs, "doc_id", e).withColumn("epoch", F.lit(e)) for e in (0, 1)]
    return both[0].unionByName(both[1]).select("doc_id", "epoch", n(F.col("batch_no")).alias("batch_no"))


@query("""SELECT repo, epoch, arg_min(chunk_key, sha256('13|' || epoch || '|' || chunk_key)) AS chunk_key FROM code_chunks CROSS JOIN (VALUES (0), (1)) AS e(epoch) WHERE repo IS NOT NULL GROUP BY ALL""")
def epoch_one_per_repo(spark: SparkSession, d: str) -> DataFrame:
    """The dynamic mode of an epoch: one chunk of each repository."""
    c = table(spark, d, "code_chunks").filter("repo is not null").select("repo", "chunk_key")
    both = [sampling.one_of_each(c, "repo", "chunk_key", e).withColumn("epoch", F.lit(e)) for e in (0, 1)]
    return both[0].unionByName(both[1]).select("repo", "epoch", "chunk_key")


@query("SELECT sample_id, count(*) FILTER (WHERE NOT suffix(lower(path), '.py')) AS other_files FROM (SELECT sample_id, unnest(map_keys(crossfile_context)) AS path FROM loader_samples) GROUP BY 1")
def sample_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Files of each sample's cross-file map that are no Python and so give fallback chunks only, as its candidate chunks have them."""
    files = table(spark, d, "loader_samples").select("sample_id", F.explode("crossfile_context").alias("path", "content"))
    chunks = runner.candidate_chunks(files, "sample_id")
    other = chunks.filter(~F.lower("file_path").endswith(".py")).groupBy("grp").agg(F.count_distinct(F.when(F.col("chunk_type") == "fallback", F.col("file_path"))).alias("n"))
    return files.select("sample_id").distinct().join(other, F.col("sample_id") == F.col("grp"), "left").select("sample_id", F.coalesce("n", F.lit(0)).alias("other_files"))


@query()
def repository_training_set(spark: SparkSession, d: str) -> DataFrame:
    """Documents as repository files, from samples to candidates: one row for each sample with the number of its candidate chunks."""
    docs = table(spark, d, "documents").filter("doc_kind = 'source_file'")
    files = docs.select(F.col("repo").alias("repo_id"), F.concat_ws(".", F.col("doc_id").cast("string"), "code_lang").alias("path"), F.col("text").alias("content"))
    wanted = files.count()
    kept, chunks = runner.training_set(files, runner.RunConfig("", "", "mixed", wanted, wanted, 0, 40, 1000, 10))
    return kept.join(chunks.groupBy("grp").agg(F.count("*").alias("candidates")), "grp", "left").select("qid", F.length("target").alias("n_target"), F.coalesce("candidates", F.lit(0)).alias("candidates"))


@query(f"""WITH u AS (SELECT {UNIFORM_SQL.format("'13|' || sample_id")} AS u FROM training_samples) SELECT CASE WHEN u < 0.7 THEN 'line' WHEN u < 0.9 THEN 'block' ELSE 'mixed' END AS level, count(*) AS n FROM u GROUP BY 1""")
def cut_levels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "training_samples").groupBy(sampling.cut_level(dense.uniform(13, F.col("sample_id"))).alias("level")).agg(F.count("*").alias("n"))


TOKEN_SQL = f"""WITH {LEXICAL_SQL.format(3)},
    k AS (SELECT qid, rk, len({IDS.format('k.text')}) AS m, least(1500, len({IDS.format('s.left_context')})) AS l FROM lexical JOIN code_chunks k ON k.chunk_key = cid JOIN training_samples s ON s.sample_id = qid),
    e AS (SELECT *, greatest(0, 600 - 50 - 256 - l) AS room, sum(m) OVER (PARTITION BY qid ORDER BY rk) AS ends FROM k), o AS (SELECT *, min(CASE WHEN ends > room THEN rk END) OVER (PARTITION BY qid) AS over FROM e),
    x AS (SELECT qid, rk, m, over, CASE WHEN over IS NULL OR rk < over THEN m WHEN rk = over AND room - (ends - m) > 20 THEN room - (ends - m) ELSE 0 END AS taken FROM o)
    SELECT qid, rk::BIGINT AS rk, m::BIGINT AS n_tokens, taken::BIGINT AS taken FROM x WHERE taken > 0 OR (m = 0 AND (over IS NULL OR rk < over))"""


@query(TOKEN_SQL)
def token_budget_pack(spark: SparkSession, d: str) -> DataFrame:
    c = chunk_table(spark, d)
    top = ranking.lexical_top_k(left_queries(spark, d), c, 3).join(c.select("cid", F.size(t.identifiers(F.col("text"))).alias("n_tokens")), "cid")
    left = search_samples(spark, d).select(F.col("sample_id").alias("qid"), F.size(t.identifiers(F.col("left_context"))).alias("left_tokens"))
    return packing.token_budget(top.join(left, "qid"), 600).select("qid", n(F.col("rk")).alias("rk"), n(F.col("n_tokens")).alias("n_tokens"), n(F.col("taken")).alias("taken"))


# proxy training


@query(f"""WITH {LEXICAL_SQL.format(3)}, used AS (SELECT qid, x FROM (SELECT qid, unnest(toks) AS x FROM lexical JOIN c USING (cid)) GROUP BY ALL),
    w AS (SELECT sample_id AS qid, unnest(list_distinct({IDS.format('target')})) AS x FROM training_samples),
    b AS (SELECT w.qid, w.x, used.x IS NOT NULL AS hit, max((used.x IS NOT NULL)::INT) OVER (PARTITION BY w.qid) AS any_hit FROM w LEFT JOIN used ON used.qid = w.qid AND used.x = w.x)
    SELECT x AS token, round(count(*) * 0.05, 6)::DOUBLE AS affinity FROM b WHERE hit OR any_hit = 0 GROUP BY 1""")
def affinity_update(spark: SparkSession, d: str) -> DataFrame:
    c = chunk_table(spark, d)
    used = ranking.lexical_top_k(left_queries(spark, d), c, 3).join(c.select("cid", "tokens"), "cid").select("qid", F.explode("tokens").alias("x")).distinct().groupBy("qid").agg(F.collect_list("x").alias("used"))
    best = search_samples(spark, d).select(F.col("sample_id").alias("qid"), "target").join(used, "qid", "left")
    return proxy.affinity_steps(best, 0.05).select("token", F.round("affinity", 6).alias("affinity"))


@query(f"""WITH {LEXICAL_SQL.format(3)}, sd AS (SELECT qid, cid, CASE rk WHEN 1 THEN 1 ELSE -1 END AS side FROM lexical WHERE rk IN (1, 3)), two AS (SELECT qid FROM sd GROUP BY 1 HAVING count(DISTINCT cid) = 2),
    k AS (SELECT chunk_key AS cid, coalesce(defined_symbols, []) AS d, coalesce(call_names, []) AS l, {SETOF.format("coalesce(defined_symbols, []), coalesce(call_names, []), coalesce(method_names, []), coalesce(used_symbols, [])")} AS own FROM code_chunks),
    x AS (SELECT s.qid, s.side, unnest(list_filter(own, lambda z: list_contains(q.toks, z) OR list_contains(d, z) OR list_contains(l, z))) AS token FROM sd s JOIN two USING (qid) JOIN q USING (qid) JOIN k USING (cid)),
    w AS (SELECT z AS token, 9.0 / count(*) AS w, 4.0 / count(*) AS ref FROM (SELECT unnest(toks) AS z FROM c) GROUP BY 1),
    lg AS (SELECT qid, 0.1 * sum(side * (w - ref)) AS logit FROM (SELECT s.qid, s.side, unnest(c.toks) AS token FROM sd s JOIN two USING (qid) JOIN c USING (cid)) JOIN w USING (token) GROUP BY 1)
    SELECT token, round(sum(side * 0.2 * 0.1 * (1 - 1 / (1 + exp(-coalesce(logit, 0))))), 6)::DOUBLE AS grad FROM x LEFT JOIN lg USING (qid) GROUP BY 1""")
def dpo_gradient(spark: SparkSession, d: str) -> DataFrame:
    """The step of preferences for the best chunk over the third: weights of 9 / (chunks that have the token) against reference weights of 4 / (the same)."""
    c = chunk_table(spark, d)
    top = ranking.lexical_top_k(left_queries(spark, d), c, 3)
    sides = top.groupBy("qid").agg(F.collect_list(F.when(F.col("rk") == 1, F.col("cid"))).alias("chosen"), F.collect_list(F.when(F.col("rk") == 3, F.col("cid"))).alias("rejected")).filter("size(rejected) > 0")
    pairs = sides.join(search_samples(spark, d).select(F.col("sample_id").alias("qid"), F.col("left_context").alias("query")), "qid")
    df = written(c.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df")))
    live, reference = df.select("token", (9.0 / F.col("df")).alias("w")), df.select("token", (4.0 / F.col("df")).alias("w"))
    return proxy.dpo_gradient(pairs, c, live, reference, 0.1, 0.2).filter("token is not null").select("token", F.round("grad", 6).alias("grad"))


@query()
def proxy_history(spark: SparkSession, d: str) -> DataFrame:
    """Two epochs of training over all samples."""
    samples = table(spark, d, "training_samples").filter(t.strip(F.col("target")) != "").select(F.col("sample_id").alias("qid"), F.col("repo").alias("grp"), "left_context", "target")
    return proxy.train(samples, chunk_table(spark, d), ProxyConfig(epochs=2), written, batches=2).history_frame()


@query()
def proxy_predict(spark: SparkSession, d: str) -> DataFrame:
    samples = table(spark, d, "training_samples").select(F.col("sample_id").alias("qid"), F.col("repo").alias("grp"), "left_context", "target")
    zero = proxy.ProxyState(spark.createDataFrame([], "token string, w double"), spark.createDataFrame([], "token string, affinity double"))
    return proxy.predict(samples, chunk_table(spark, d), zero, ProxyConfig())


@query()
def ast_cuts(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, level, candidates, first_row, last_row): where each Python source file could be cut at the level drawn for it, and the cut drawn; a file with none is missing."""
    kinds = frozenset("Expr Assign AugAssign AnnAssign Return If For While With Try Raise Assert Delete function_definition class_definition Call".split())

    @F.pandas_udf("array<struct<a:int,b:int>>")
    def found(texts, levels):  # noqa: ANN001, ANN202
        import pandas as pd

        trees = (structural.python_tree(x) if x else None for x in texts)
        return pd.Series([[{"a": a, "b": b} for a, b in structural.cut_candidates(r, level, kinds)] if r else [] for r, level in zip(trees, levels)])

    rows = table(spark, d, "documents").filter("code_lang = 'py'").select("doc_id", "text", sampling.cut_level(dense.uniform(13, F.col("doc_id"))).alias("level"))
    cut = rows.select("doc_id", "level", found("text", "level").alias("c")).filter("size(c) > 0")
    pick = F.element_at("c", (F.floor(dense.uniform(29, F.col("doc_id")) * F.size("c")) + 1).cast("int"))
    return cut.select("doc_id", "level", F.size("c").alias("candidates"), pick["a"].alias("first_row"), pick["b"].alias("last_row"))


@query()
def built_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples cut from the source files among the documents: as many attempts as there are files, and every sample they give."""
    docs = table(spark, d, "documents").filter("doc_kind = 'source_file'")
    files = docs.select(F.col("repo").alias("repo_id"), F.concat_ws(".", F.col("doc_id").cast("string"), "code_lang").alias("path"), F.col("text").alias("content"))
    made, _ = samples.build_samples(files, files.count(), files.count(), least_lines=40, least_chars=1000, least_left=10)
    return made.select("sample_id", "repo_id", "path", "cut_level", "n_lines", F.length("left_context").alias("n_left"), "target", F.length("right_context").alias("n_right"))
