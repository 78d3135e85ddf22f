"""The pN_ queries of the training-data operators, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codectx.llm import credentials, encoding, handwritten, leakage, mixing, set_join, split_overlap, splitter, validity, vector_graph
from codectx.llm.common import table

SETS = ["defined_symbols", "used_symbols", "call_names"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs, members = split_overlap.split_overlaps(table(spark, d, "training_samples"))
    rows = split_overlap.record_overlaps(pairs, members)
    return rows.select(F.least("train_id", "held_id").alias("sample_lo"), F.greatest("train_id", "held_id").alias("sample_hi"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.overlap_report(table(spark, d, "training_samples")).drop("mean_coverage")


def p1_coverage(spark: SparkSession, d: str) -> DataFrame:
    """One row for each held-out row that a train row overlaps: its class, its train rows, and how much of its tokens the best class covers."""
    return split_overlap.overlap_coverage(table(spark, d, "training_samples"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return vector_graph.nearest_pairs(vector_graph.nearest_vectors(table(spark, d, "text_vectors")))


def p2_nearest(spark: SparkSession, d: str) -> DataFrame:
    return vector_graph.nearest_vectors(table(spark, d, "text_vectors")).withColumn("cos", F.round("cos", 6))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs, members = set_join.similar_sets(table(spark, d, "code_chunks"), "chunk_key", SETS)
    return set_join.record_pairs(pairs, members).select(F.col("lo").alias("chunk_lo"), F.col("hi").alias("chunk_hi"))


def p3_links(spark: SparkSession, d: str) -> DataFrame:
    """One row for each chunk that takes part: its class, its copies and how many chunks of other classes are similar."""
    pairs, members = set_join.similar_sets(table(spark, d, "code_chunks"), "chunk_key", SETS)
    return set_join.record_links(pairs, members).withColumnRenamed("id", "chunk_key")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, d, "loader_samples"), table(spark, d, "code_chunks")).select("origin", "record_id", "file_path")


def p4_reasons(spark: SparkSession, d: str) -> DataFrame:
    marked = handwritten.not_handwritten(table(spark, d, "loader_samples"), table(spark, d, "code_chunks"))
    return marked.groupBy("origin", "reason").agg(F.count("*").alias("n"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return credentials.sources(table(spark, d, "loader_samples"), table(spark, d, "code_chunks"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.find_credentials(_texts(spark, d)).select("origin", "record_id", "file_path", "line_no").distinct()


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.redact_credentials(_texts(spark, d))


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitter.split_oversized(table(spark, d, "code_chunks"))


def p6_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """The oversized chunks put together again from their pieces: nothing is lost, nothing doubled, and no piece is over a limit."""
    p = p6_pieces(spark, d)
    good = p.groupBy("chunk_key").agg(F.bool_and((F.length("text") <= splitter.MAX_CHARS) & (F.col("last_line") - F.col("first_line") < splitter.MAX_LINES)).alias("within"))
    return splitter.put_together(p).join(good, "chunk_key").select("chunk_key", F.md5("text").alias("text_md5"), "within")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_pieces(spark, d).filter("piece_no = 0").select("chunk_key")


def p7_checked(spark: SparkSession, d: str) -> DataFrame:
    return validity.check_files(validity.files(table(spark, d, "loader_samples"), table(spark, d, "code_chunks")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_checked(spark, d).filter("not valid").select("origin", "record_id", "file_path")


def p7_judged(spark: SparkSession, d: str) -> DataFrame:
    """How many files of each repository and language are judged."""
    return p7_checked(spark, d).groupBy("repo", "language").agg(F.count("*").alias("files"))


def p7_rates(spark: SparkSession, d: str) -> DataFrame:
    return validity.rates(p7_checked(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_rows")).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Each leak with its longest exact run and the share of the item in agreement."""
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_rows")).withColumn("covered", F.round("covered", 6))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """For each leaked item: documents that hold some of it."""
    hits = leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_rows"))
    return hits.groupBy("item_id").agg(F.count("*").alias("documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix: one row for each use of a document, with the share its source was to have and the one it has reached."""
    return mixing.copies(*mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_words_mix(spark: SparkSession, d: str) -> DataFrame:
    """p9_mix with words for tokens, which SQL can count."""
    return mixing.copies(*mixing.mix_counts(mixing.word_counts(table(spark, d, "documents")), table(spark, d, "mix_targets")))


def p9_words_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_counts(mixing.word_counts(table(spark, d, "documents")), table(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.find_garbled(table(spark, d, "documents")).select("doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.find_garbled(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_report, p1_coverage, p2_found, p2_nearest, p3_found, p3_links, p4_found, p4_reasons, p5_found, p5_redacted, p6_found, p6_pieces, p6_rebuilt, p7_found, p7_checked, p7_judged, p7_rates, p8_found, p8_leaks, p8_items, p9_report, p9_mix, p9_words_mix, p9_words_report, p10_found, p10_restored)
}

TOKENS = r"regexp_extract_all(lower({}), '[a-z0-9_]+')"
SETS_SQL = """
        WITH v AS (
            SELECT DISTINCT chunk_key, unnest(list_concat(coalesce(defined_symbols, []), coalesce(used_symbols, []), coalesce(call_names, []))) AS x FROM code_chunks),
        e AS (SELECT chunk_key, x FROM v WHERE x IS NOT NULL),
        n AS (SELECT chunk_key, count(*) AS n FROM e GROUP BY ALL HAVING count(*) >= 5),
        f AS (SELECT x, count(*) AS df FROM e JOIN n USING (chunk_key) GROUP BY ALL),
        r AS (SELECT chunk_key, x, n.n, row_number() OVER (PARTITION BY chunk_key ORDER BY df, x) AS pos FROM e JOIN n USING (chunk_key) JOIN f USING (x)),
        p AS (SELECT * FROM r WHERE pos <= n - ((n * 7 + 9) // 10) + 1),
        c AS (SELECT DISTINCT a.chunk_key AS lo, b.chunk_key AS hi, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.x = b.x AND a.chunk_key < b.chunk_key),
        s AS (SELECT lo, hi, na, nb, count(*) AS n_both FROM c JOIN r a ON a.chunk_key = lo JOIN r b ON b.chunk_key = hi AND a.x = b.x GROUP BY ALL),
        pairs AS (SELECT lo, hi, na = nb AND n_both = na AS equal FROM s WHERE n_both * 10 >= (na + nb - n_both) * 7)"""
SOURCE_KEY = r"regexp_replace(lower(trim(source)), '[\s-]+', '_', 'g')"
#: The mix by words: the level at which sources not clamped to their caps are filled is found by trying each prefix of clamped ones.
MIX_SQL = f"""
    WITH c AS (SELECT doc_id, {SOURCE_KEY} AS source, len({TOKENS.format("coalesce(text, '')")})::BIGINT AS tokens FROM documents),
    w AS (SELECT {SOURCE_KEY} AS source, sum(coalesce(target_share, 0)) AS w, max(greatest(coalesce(max_repeats, 0), 0)) AS r FROM mix_targets WHERE source IS NOT NULL GROUP BY 1),
    b AS (SELECT w.source, w, r, coalesce(sum(tokens), 0)::BIGINT AS n FROM w LEFT JOIN c USING (source) GROUP BY ALL),
    a AS (SELECT source, w, n, n * r::DOUBLE AS cap, n * r / w AS ratio FROM b WHERE w > 0 AND n * r > 0),
    t AS (SELECT k.source AS k, ((SELECT sum(n) FROM a) - coalesce(sum(x.cap) FILTER (WHERE x.ratio < k.ratio), 0)) / sum(x.w) FILTER (WHERE x.ratio >= k.ratio) AS level, k.ratio FROM a k CROSS JOIN a x GROUP BY k.source, k.ratio),
    l AS (SELECT coalesce(arg_min(level, ratio) FILTER (WHERE level < ratio), 0) AS level, count(*) FILTER (WHERE level < ratio) AS open FROM t),
    s AS (SELECT b.source, b.w, b.r, b.n, round(coalesce(CASE WHEN t.level >= t.ratio THEN a.cap ELSE greatest(l.level, 0) * a.w END, 0), 3) AS wanted FROM b LEFT JOIN a USING (source) LEFT JOIN t ON t.k = b.source CROSS JOIN l),
    p AS (SELECT *, floor(wanted / n)::INT AS whole, round(wanted - floor(wanted / n) * n, 3) AS part FROM s WHERE wanted > 0),
    o AS (SELECT doc_id, source, tokens, whole, part, sum(tokens) OVER (PARTITION BY source ORDER BY ('0x' || substr(sha256('{mixing.SEED}|' || doc_id), 1, 13))::BIGINT, doc_id) - tokens AS run FROM c JOIN p USING (source) WHERE tokens > 0),
    f AS (SELECT *, ('0x' || substr(sha256('{mixing.SEED}|' || doc_id), 1, 13))::BIGINT // {(1 << 52) // mixing.SLICES} AS slice FROM o),
    e AS (SELECT source, max(slice) AS border FROM (SELECT source, slice, part, min(run) AS run FROM f GROUP BY ALL) WHERE run < part GROUP BY 1),
    d AS (SELECT doc_id, source, tokens, whole + CASE WHEN slice < border THEN 1 WHEN slice = border AND run + tokens / 2 <= part THEN 1 ELSE 0 END AS repeats FROM f LEFT JOIN e USING (source)),
    m AS (SELECT * FROM d WHERE repeats > 0), g AS (SELECT source, sum(tokens * repeats) AS drawn, max(repeats) AS most FROM m GROUP BY 1),
    report AS (SELECT s.source, round(s.w, 9) AS target_share, round(coalesce(coalesce(drawn, 0) / nullif((SELECT sum(drawn) FROM g), 0), 0), 6)::DOUBLE AS reached_share, s.n AS tokens_available, coalesce(drawn, 0)::BIGINT AS tokens_drawn,
        round(coalesce(coalesce(drawn, 0) / nullif(s.n, 0), 0), 6)::DOUBLE AS mean_repeats, coalesce(most, 0)::INT AS most_repeats, s.r::INT AS max_repeats FROM s LEFT JOIN g USING (source))"""
ORACLES: dict[str, str] = {
    "p9_words_report": f"{MIX_SQL} SELECT * FROM report",
    "p9_words_mix": f"{MIX_SQL} SELECT doc_id, unnest(range(1, repeats + 1))::INT AS copy_no, source, tokens, target_share, reached_share FROM m JOIN report USING (source)",
    "p6_found": """
        SELECT chunk_key FROM code_chunks
        WHERE length(text) > 6000 OR length(text) - length(replace(text, chr(10), ''))
              + CASE WHEN text = '' OR suffix(text, chr(10)) THEN 0 ELSE 1 END > 120""",
    "p8_found": f"""
        WITH item_tokens AS (
            SELECT item_id, {TOKENS.format("coalesce(left_context, '') || coalesce(groundtruth, '') || chr(10) || coalesce(right_context, '')")} AS t FROM eval_rows),
        doc_tokens AS (SELECT doc_id, {TOKENS.format("text")} AS t FROM documents),
        item_runs AS (SELECT DISTINCT item_id, array_to_string(t[i:i+14], ' ') AS run FROM (SELECT item_id, t, unnest(range(1, len(t) - 13)) AS i FROM item_tokens)),
        doc_runs AS (SELECT doc_id, array_to_string(t[i:i+14], ' ') AS run FROM (SELECT doc_id, t, unnest(range(1, len(t) - 13)) AS i FROM doc_tokens))
        SELECT DISTINCT doc_id, item_id FROM doc_runs JOIN item_runs USING (run)""",
    "p1_found": f"""
        WITH s AS (SELECT sample_id, split_name = 'train' AS train, {TOKENS.format("coalesce(left_context, '') || chr(10) || coalesce(target, '')")} AS t FROM training_samples WHERE split_name IN ('train', 'valid', 'test', 'repoeval')),
        r AS (SELECT DISTINCT sample_id, train, array_to_string(t[i:i+3], ' ') AS run FROM (SELECT sample_id, train, t, unnest(range(1, len(t) - 2)) AS i FROM s)),
        n AS (SELECT sample_id, count(*) AS n FROM r GROUP BY 1),
        c AS (SELECT a.sample_id AS x, b.sample_id AS y, count(*) AS m FROM r a JOIN r b USING (run) WHERE a.train AND NOT b.train GROUP BY ALL)
        SELECT least(x, y) AS sample_lo, greatest(x, y) AS sample_hi FROM c JOIN n a ON a.sample_id = x JOIN n b ON b.sample_id = y WHERE m * 5 >= (a.n + b.n - m) * 3""",
    "p2_nearest": """
        WITH v AS (SELECT vec_id, vec::DOUBLE[] AS e FROM text_vectors WHERE vec IS NOT NULL), u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS l FROM v WHERE list_dot_product(e, e) > 0),
        s AS (SELECT a.vec_id, b.vec_id AS other, round(list_dot_product(a.e, b.e) / (a.l * b.l), 12) AS cos FROM u a JOIN u b ON a.vec_id <> b.vec_id)
        SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY cos DESC, other)::INT AS rank, other, round(cos, 6) AS cos FROM s QUALIFY rank <= 5""",
    "p2_found": """
        WITH v AS (SELECT vec_id, vec::DOUBLE[] AS e FROM text_vectors WHERE vec IS NOT NULL), u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS l FROM v WHERE list_dot_product(e, e) > 0),
        t AS (SELECT a.vec_id AS q, b.vec_id AS o FROM u a JOIN u b ON a.vec_id <> b.vec_id
            QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.e, b.e) / (a.l * b.l), 12) DESC, b.vec_id) <= 5)
        SELECT DISTINCT least(q, o) AS vec_lo, greatest(q, o) AS vec_hi FROM t""",
    "p3_found": f"{SETS_SQL} SELECT lo AS chunk_lo, hi AS chunk_hi FROM pairs",
    "p3_links": f"""{SETS_SQL}, both_ways AS (SELECT lo AS k, hi AS o, equal FROM pairs UNION ALL SELECT hi, lo, equal FROM pairs)
        SELECT n.chunk_key, least(n.chunk_key, min(o) FILTER (WHERE equal)) AS class_id, 1 + count(*) FILTER (WHERE equal) AS copies, count(*) FILTER (WHERE NOT equal) AS links FROM n LEFT JOIN both_ways ON k = n.chunk_key GROUP BY n.chunk_key""",
    "p1_report": f"""
        WITH s AS (SELECT sample_id, split_name, source, {TOKENS.format("coalesce(left_context, '') || chr(10) || coalesce(target, '')")} AS t FROM training_samples WHERE split_name IN ('train', 'valid', 'test', 'repoeval')),
        r AS (SELECT DISTINCT sample_id, split_name = 'train' AS train, array_to_string(t[i:i+3], ' ') AS run FROM (SELECT sample_id, split_name, t, unnest(range(1, len(t) - 2)) AS i FROM s)),
        n AS (SELECT sample_id, count(*) AS n FROM r GROUP BY 1),
        c AS (SELECT a.sample_id AS x, b.sample_id AS y, count(*) AS m FROM r a JOIN r b USING (run) WHERE a.train AND NOT b.train GROUP BY ALL),
        f AS (SELECT y, count(*) AS k FROM c JOIN n a ON a.sample_id = x JOIN n b ON b.sample_id = y WHERE m * 5 >= (a.n + b.n - m) * 3 GROUP BY 1)
        SELECT split_name, source, count(*) AS rows, count(k) AS overlapping_rows, coalesce(sum(k), 0)::BIGINT AS pairs FROM s LEFT JOIN f ON y = sample_id WHERE split_name <> 'train' GROUP BY ALL""",
    "p6_rebuilt": """
        SELECT chunk_key, md5(text) AS text_md5, true AS within FROM code_chunks
        WHERE length(text) > 6000 OR length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR suffix(text, chr(10)) THEN 0 ELSE 1 END > 120""",
    "p7_judged": r"""
        WITH f AS (SELECT repo, unnest(map_keys(crossfile_context)) AS path FROM loader_samples UNION ALL SELECT repo, file_path FROM code_chunks WHERE chunk_type = 'fallback'),
        e AS (SELECT repo, lower(regexp_extract(path, '\.(py|js|ts|java|go)$', 1, 'i')) AS ext FROM f)
        SELECT repo, CASE ext WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' ELSE ext END AS language, count(*) AS files FROM e WHERE ext <> '' GROUP BY ALL""",
    "p8_items": """
        WITH d AS (SELECT doc_id, item_id FROM ({p8_found})) SELECT item_id, count(*) AS documents FROM d GROUP BY 1""",
}
ORACLES["p8_items"] = ORACLES["p8_items"].replace("{p8_found}", ORACLES["p8_found"])
