"""Registered queries over the text tables and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorline.llm import (
    byte_bpe,
    chat_format,
    decontamination,
    exact_dedup,
    hard_negatives,
    line_dedup,
    packing,
    periodic_runs,
    quality_rules,
    secret_scan,
    simhash,
    token_files,
    toxicity,
)
from tremorline.llm.text import let, words
from tremorline.session import stage_root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; the models are trained on all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ratios = secret_scan.train(secret_scan.samples_of(docs))
    found = secret_scan.scan(docs, ratios)
    return found.select(
        "row.doc_id",
        *(
            F.size(F.filter("base", lambda s: s["kind"] == kind.name)).cast("long").alias(f"n_{kind.name}")
            for kind in secret_scan.BASE
        ),
        F.sha2(secret_scan.written(F.col("base")), 256).alias("base_sha256"),
        secret_scan.written(F.concat("base", "added")).alias("spans"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that their source repeats."""
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"), F.col("source")).select(
        "row.doc_id",
        "n_lines",
        "n_dropped",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("text", 256).alias("text_sha256"),
    )


OP4_SQL = r"""
WITH lines AS (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
           unnest(range(len(string_split(text, chr(10))))) AS i
    FROM documents),
worded AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS has_word FROM lines),
pages AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
counts AS (SELECT source, line, count(DISTINCT doc_id) AS n FROM worded WHERE has_word GROUP BY source, line),
boiler AS (
    SELECT source, line, true AS is_boiler FROM counts JOIN pages USING (source)
    WHERE n >= 5 AND n > 0.02::DOUBLE * pages),
marked AS (
    SELECT w.*, has_word AND coalesce(is_boiler, false) AS goes
    FROM worded w LEFT JOIN boiler b ON b.source = w.source AND b.line = w.line),
whole AS (SELECT doc_id, bool_or(has_word) AND NOT bool_or(has_word AND NOT goes) AS emptied FROM marked GROUP BY doc_id),
kept AS (SELECT m.*, NOT goes OR emptied AS stays FROM marked m JOIN whole USING (doc_id)),
texts AS (
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
           coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '') AS text
    FROM kept GROUP BY doc_id)
SELECT d.doc_id, n_lines, n_dropped, length(t.text) AS n_chars, sha256(t.text) AS text_sha256
FROM documents d JOIN texts t USING (doc_id)
"""


# A conversation whose texts hold an escape character and control strings.
TRICKY_TURNS = [
    (-7, 0, "user", "\\### Assistant: </turn> ok"),
    (-7, 1, "assistant", "\\### Assistant: </turn> ok"),
]


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and a tricky one, read back from their formatted texts."""
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame(TRICKY_TURNS, "conv_id long, turn long, role string, text string")
    out = chat_format.format_chats(chats.unionByName(tricky)).select(
        "conv_id",
        chat_format.formatted(F.col("segments")).alias("formatted"),
        chat_format.loss_text(F.col("segments")).alias("loss_text"),
        "valid",
    )
    back = out.select("*", chat_format.parsed(F.col("formatted")).alias("turns"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""),
            256,
        ).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP5_SQL = r"""
WITH t AS (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
r AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
    FROM t),
f AS (
    SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY k) AS before,
           length(text) + length(text) - length(translate(text, '\<#', '')) AS text_chars,
           length(role) + length(role) - length(translate(role, '\<#:', '')) AS role_chars
    FROM r),
g AS (
    SELECT *, CASE coalesce(before, '<start>')
        WHEN '<start>' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user'
        WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role IN ('user', 'tool')
        WHEN 'tool' THEN role IN ('assistant', 'tool') ELSE false END AS fits
    FROM f)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(10 + role_chars + 2 + text_chars + 8)::BIGINT AS formatted_chars,
       bool_and(fits) AS valid
FROM g GROUP BY conv_id
"""


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving copy of every document."""
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH d AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS content
    FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(content) AS text_sha256
FROM d WINDOW w AS (PARTITION BY content)
"""


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 4096 tokens; lengths and sums are those of the
    ids that packing returns."""
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer)
    from_ids = {"length": F.expr("octet_length(ids) div 4"), "ids_crc32": F.crc32("ids")}
    return packed.withColumns(from_ids).drop("ids")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the quality rules for every document."""
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "row.doc_id", *quality_rules.COUNTS, "base_failed", "kept"
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), ranks, pattern)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    folder = f"{stage_root(spark)}/token_files"
    manifest = token_files.write(table(spark, sf_dir, "documents"), folder, tokenizer)
    return token_files.read_documents(spark, manifest).withColumnRenamed("id", "doc_id")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    found = decontamination.find(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"]
    )
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end_word"] - s["first_word"])
    return found.select(
        "row.doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


_OP11_WORDS = r"""regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP11_SQL = rf"""
WITH d AS (SELECT doc_id, {_OP11_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_OP11_WORDS} AS ws FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(list_slice(ws, i, i + least(len(ws), 10) - 1), ' ') AS g
    FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM b WHERE len(ws) > 0)),
grams AS (
    SELECT doc_id, k, i, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS g
    FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM windows))),
hits AS (SELECT doc_id, item_id, i, grams.k AS k FROM grams JOIN windows USING (k, g)),
covered AS (
    SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS w FROM hits) GROUP BY doc_id),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _with_periodic_tail(doc_id: Column, text: Column) -> Column:
    """``text``, where crc32 of the id says so with its words from some place on replaced by
    a repetition of the first of them."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def repeated(ws: Column) -> Column:
        n = F.size(ws)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return let(
            F.struct(a.alias("a"), p.alias("p")),
            lambda v: F.array_join(
                F.transform(ws, lambda w, i: F.when(i < v["a"], w).otherwise(F.get(ws, v["a"] + (i - v["a"]) % v["p"]))),
                " ",
            ),
        )

    changed = let(words(text), lambda ws: F.when(F.size(ws) > 0, repeated(ws)))
    return F.when(h % 10 == 0, F.coalesce(changed, text)).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents, some of which get a periodic tail first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text", _with_periodic_tail(F.col("doc_id"), F.col("text")))
    found = periodic_runs.find_runs(docs, carry=["doc_id"])
    order = F.transform(
        "runs", lambda r: F.struct((-r["length"]).alias("rest"), r["start"].alias("start"), r["period"].alias("period"))
    )
    longest = found.select("*", F.array_min(order).alias("longest"))
    written = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return longest.select(
        "row.doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.start").alias("start"),
        (-F.col("longest.rest")).alias("length"),
        F.col("longest.period").alias("period"),
        F.expr("-1000 * longest.rest div longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(written, ""), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives and hard negatives of every 50th embedding; every seventh has another label."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0)


OP13_SQL = """
WITH e AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, e.vec_id AS other, a.label = e.label AS same,
           list_inner_product(a.q, e.q)::BIGINT AS score
    FROM e a JOIN e ON a.vec_id % 50 = 0 AND a.vec_id <> e.vec_id),
p AS (
    SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


_STOP_LIST = ", ".join(f"'{w}'" for w in quality_rules._STOP_FORMS)

OP8_SQL = rf"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
    FROM documents),
grams AS (
    SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS g
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 6, 1))) AS i FROM d)),
starts AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (
    SELECT doc_id, sum(least(8, coalesce(after - i, 8))) AS n_repeat_words
    FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM starts) GROUP BY doc_id),
c AS (
    SELECT d.doc_id, len(ws) AS n_words,
           coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
           length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
           len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
           len(list_filter(ws, lambda x: x IN ({_STOP_LIST}))) AS n_stop_words,
           coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM d LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND word_chars >= 3 * n_words AND word_chars <= 10 * n_words
       AND n_symbols::DOUBLE / greatest(n_words, 1) <= 0.1::DOUBLE
       AND n_stop_words::DOUBLE / greatest(n_words, 1) >= 0.02::DOUBLE
       AND n_dup_lines::DOUBLE / greatest(n_lines, 1) <= 0.5::DOUBLE AS kept
FROM f
"""

QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_secret_scans": op2_secret_scans,
    "op3_toxicity": op3_toxicity,
    "op4_line_dedup": op4_line_dedup,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_packing": op7_packing,
    "op8_quality_rules": op8_quality_rules,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_token_files": op10_token_files,
    "op11_decontamination": op11_decontamination,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL = {
    "op4_line_dedup": OP4_SQL,
    "op5_chat_formatting": OP5_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op8_quality_rules": OP8_SQL,
    "op11_decontamination": OP11_SQL,
    "op13_hard_negatives": OP13_SQL,
}
