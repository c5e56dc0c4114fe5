"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, html_text, licenses, lines, near_dup, neighbours, packing, periods, pieces, quality, secrets, sharding, token_files


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_dropped_lines")


def op2_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op3_odd_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op5_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_longest_first_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_size(_table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _tokenizer("piece_bpe_32k.model")
    encoded = pieces.encode_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    out = pieces.decode_texts(encoded, model)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), F.length("decoded").cast("long").alias("n_chars"), same.alias("same_text"))


def op8_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.score_quality(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op9_wavelet_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op10_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows.filter(F.col("vec_id") % 20 == 0), 20)


def op11_automaton_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periods.find_runs(_table(spark, sf_dir, "documents"), change=periods.planted)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_field_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "model")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))


def op13_shape_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damaged(_table(spark, sf_dir, "conversations"))
    return conversations.repair_conversations(rows).withColumnRenamed("conv", "conv_id")


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_wrapper_text, op3_odd_sketch_dedup, op4_license_scan, op5_bm25_packing, op6_longest_first_shards, op7_piece_round_trip, op8_weak_quality, op9_wavelet_token_files, op10_graph_neighbours, op11_automaton_runs, op12_field_secrets, op13_shape_repair)}

#: Lines that one edit of a word apart begin or end with the same five words, so two equi-joins find all pairs.
LINE_DEDUP_SQL = r"""
WITH cut AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
raw AS (SELECT doc_id, unnest(range(len(ls))) AS no, unnest(ls) AS line FROM cut),
plain AS (SELECT doc_id, no, trim(regexp_replace(line, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t FROM raw),
full_lines AS (SELECT *, row_number() OVER (ORDER BY doc_id, no) AS pos FROM plain WHERE t <> ''),
firsts AS (SELECT t, min(pos) AS pos FROM full_lines GROUP BY t),
long_lines AS (SELECT pos, t, string_split(t, ' ') AS w, len(string_split(t, ' ')) AS n FROM firsts),
keyed AS (SELECT pos, t, w, n, w[1:5] AS a, w[n - 4:n] AS z FROM long_lines WHERE n >= 10),
pairs AS (SELECT x.pos AS pos, x.t AS t, x.w AS w, x.n AS n, y.w AS v, y.n AS m FROM keyed x JOIN keyed y ON x.a = y.a AND y.pos < x.pos AND abs(x.n - y.n) <= 1
    UNION ALL SELECT x.pos, x.t, x.w, x.n, y.w, y.n FROM keyed x JOIN keyed y ON x.z = y.z AND y.pos < x.pos AND abs(x.n - y.n) <= 1),
near AS (SELECT DISTINCT t FROM pairs WHERE CASE
    WHEN n = m THEN len(list_filter(range(1, n + 1), lambda i: w[i] <> v[i])) <= 1
    WHEN n > m THEN len(list_filter(range(1, n + 1), lambda i: w[1:i - 1] = v[1:i - 1] AND w[i + 1:n] = v[i:m])) > 0
    ELSE len(list_filter(range(1, m + 1), lambda i: v[1:i - 1] = w[1:i - 1] AND v[i + 1:m] = w[i:n])) > 0 END),
gone AS (SELECT l.doc_id, l.no FROM full_lines l JOIN firsts f ON l.t = f.t WHERE l.pos <> f.pos OR l.t IN (SELECT t FROM near)),
kept AS (SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.no) AS text, count(*) AS n FROM raw r
    WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = r.doc_id AND g.no = r.no) GROUP BY r.doc_id)
SELECT c.doc_id, CASE WHEN c.text IS NOT NULL THEN coalesce(k.text, '') END AS text, CAST(coalesce(len(c.ls) - coalesce(k.n, 0), 0) AS BIGINT) AS n_dropped_lines
FROM cut c LEFT JOIN kept k ON c.doc_id = k.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op1_line_dedup": LINE_DEDUP_SQL}
