"""Registered queries of the corpus operators: thin calls over whole tables, and the digests they return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, backoff, epsilon_grid, exact, language, lattice, line_dedup, packing, quality, runs, simhash, toxicity, trie
from .common import in_fold, table


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = simhash.simhash_groups(docs, words=4, radius=4)
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), window=1024)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    gone = line_dedup.repeated_lines(docs).groupBy("doc", "copy").agg(F.array_sort(F.collect_set("pos")).alias("places"), F.min(F.struct("first_doc", "first_pos")).alias("least"))
    counted = docs.select("doc_id", F.xxhash64("text").alias("own"), F.coalesce(F.size(F.filter(F.split("text", "\n"), lambda x: x != "")), F.lit(0)).cast("long").alias("n_lines"))
    out = counted.join(gone, (counted.doc_id == gone.doc) & (counted.own == gone.copy), "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_removed"), F.array_join("places", ",").alias("removed"), F.col("least.first_doc").alias("least_first_doc"))


def op3_sentencepiece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces, text = lattice.pieces(spark), F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("text_sha256", F.sha2(F.translate(text, lattice.SPACE, " "), 256))
    decoded = lattice.decode(lattice.encode(docs, pieces, keep=("text_sha256",)), pieces)
    return decoded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), (F.sha2("text", 256) == F.col("text_sha256")).alias("round_trip"))


def op4_media_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audio.audio_features(audio.encode_audio(table(spark, sf_dir, "documents", "doc_id", "text")))
    voiced = F.aggregate("spans", F.lit(0.0), lambda s, x: s + x["end_s"] - x["start_s"])
    bands = F.concat_ws(",", F.transform("mel_mean", lambda x: F.round(x, 2).cast("string")))
    size = F.octet_length("samples").cast("long")
    return out.select(
        F.col("id").alias("doc_id"), "n_bytes", size.alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, greatest(1, octet_length(samples) - 31), 32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", F.col("frames").cast("string"), F.size("spans").cast("string"), F.round(voiced, 2).cast("string"), bands, F.sha2("features", 256)).alias("feature"),
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return quality.score(docs, quality.train(docs)).select("doc_id", "posterior", "score", (F.col("score") >= 0.5).alias("kept"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(~in_fold("doc_id", 5, 0))
    out = toxicity.score_documents(docs, toxicity.train(docs, labels))
    out = out.withColumnRenamed("id", "doc_id").withColumn("held_out", in_fold("doc_id", 5, 0))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").cast("long").alias("n_offending"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    likelihoods = language.train(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    pages = language.page_evidence(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return language.identify(pages, likelihoods).select(F.col("id").alias("page_id"), "lang", "confidence", "n_words")


def op8_lm_backoff_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = backoff.score_texts(table(spark, sf_dir, "documents", "doc_id", "text"), in_fold("doc_id", 7, 2))
    return out.withColumnRenamed("id", "doc_id")


def op9_epsilon_grid_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = epsilon_grid.cosine_groups(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), least=0.93)
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = trie.turns(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return trie.prefix_trie(trie.with_heads(turns, stride=100, most=6))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = "filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x != '')"
    planted = f"""array_join(element_at(transform(array({words}), w -> transform(array(named_struct('a', h div 10 % size(w), 'n', size(w))),
        s -> transform(array(1 + (s.n - s.a) div (3 + h div 10 % 8)), p -> transform(w, (x, i) -> if(i < s.a, x, element_at(w, cast(s.a + (i - s.a) % p + 1 as int)))))[0])[0]), 1), ' ')"""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("h", h)
    docs = docs.select("doc_id", F.expr(f"case when h % 10 = 0 and size({words}) > 0 then {planted} else text end").alias("text"))
    out = runs.periodic_runs(docs)
    longest = F.array_min(F.transform("runs", lambda r: F.struct(-r["length"], r["start"], r["period"])))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    out = out.select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), longest.alias("r"), listed.alias("listed"), "collapsed")
    return out.select(
        "doc_id", "n_runs", F.col("r.start").alias("start"), (-F.col("r.col1")).alias("length"), F.col("r.period").alias("period"),
        F.expr("1000 * -r.col1 div r.period").alias("exponent_milli"), F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = exact.one_space(F.coalesce("text", F.lit("")))
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("text_sha256", F.sha2(text, 256))
    out = exact.exact_groups(docs, keep=("text_sha256",))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {
    "op1_packing": op1_packing,
    "op2_line_dedup": op2_line_dedup,
    "op3_sentencepiece_lattice": op3_sentencepiece_lattice,
    "op4_media_audio_features": op4_media_audio_features,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_toxicity": op6_toxicity,
    "op7_language_id": op7_language_id,
    "op8_lm_backoff_scoring": op8_lm_backoff_scoring,
    "op9_epsilon_grid_near_dedup": op9_epsilon_grid_near_dedup,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_conversation_prefix_trie": op11_conversation_prefix_trie,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_exact_dedup": op13_exact_dedup,
}

#: Pairs of equal label with a cosine of at least 0.93, then the smallest id reachable by label propagation over the links.
OP9_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
    SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL
      AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b
      ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(u, v) AS (
    SELECT vec_id, vec_id FROM v
    UNION
    SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
), least AS (
    SELECT u, min(v) AS component_id FROM reach GROUP BY u
), degree AS (
    SELECT u, count(*) AS n FROM links GROUP BY u
)
SELECT v.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, t.component_id, v.vec_id = t.component_id AS kept
FROM v JOIN least t ON v.vec_id = t.u LEFT JOIN degree d ON d.u = v.vec_id
"""

#: Lines linked within two edits (the shorter one has 24 characters or more) or one (12 or more), where a third of the
#: shorter line, or half of it, must stand in the longer one; any other line only with equal ones.
OP2_SQL = """
WITH RECURSIVE l0 AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
    FROM documents WHERE doc_id IS NOT NULL
), l AS (
    SELECT * FROM l0 WHERE length(line) >= 1
), d AS (
    SELECT line, length(line) AS n, min((doc_id, pos)) AS place FROM l GROUP BY line
), p AS (
    SELECT line, n, left(line, n // 3) AS head, right(line, n // 3) AS tail, substr(line, n // 3 + 1, n // 3) AS middle FROM d
), near AS (
    SELECT DISTINCT a.line AS u, b.line AS v FROM p a JOIN p b ON b.n = a.n AND a.line < b.line
    WHERE a.n >= 12 AND CASE WHEN a.head = left(b.line, a.n // 3) OR a.tail = right(b.line, a.n // 3) OR contains(b.line, a.middle)
               THEN levenshtein(a.line, b.line) ELSE 3 END <= CASE WHEN a.n >= 24 THEN 2 ELSE 1 END
    UNION
    SELECT DISTINCT a.line, b.line FROM p a CROSS JOIN (VALUES (1), (2)) k(k) JOIN p b ON b.n = a.n + k.k
    WHERE a.n >= 12 AND CASE WHEN a.head = left(b.line, a.n // 3) OR a.tail = right(b.line, a.n // 3) OR contains(b.line, a.middle)
               THEN levenshtein(a.line, b.line) ELSE 3 END <= CASE WHEN a.n >= 24 THEN 2 ELSE 1 END
), links AS (
    SELECT u, v FROM near UNION SELECT v, u FROM near
), reach(u, v) AS (
    SELECT u, u FROM links
    UNION
    SELECT r.u, k.v FROM reach r JOIN links k ON r.v = k.u
), class AS (
    SELECT r.u AS line, min(d.place) AS place FROM reach r JOIN d ON d.line = r.v GROUP BY r.u
), firsts AS (
    SELECT d.line, coalesce(c.place, d.place) AS place FROM d LEFT JOIN class c USING (line)
), gone AS (
    SELECT l.doc_id, l.pos, f.place FROM l JOIN firsts f USING (line) WHERE (l.doc_id, l.pos) <> f.place
), by_doc AS (
    SELECT doc_id, count(DISTINCT pos) AS n, array_to_string(list_sort(list(DISTINCT pos)), ',') AS removed, min(place)[1] AS first_doc FROM gone GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(len(list_filter(string_split(d.text, chr(10)), lambda x: length(x) >= 1)), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(b.n, 0) AS BIGINT) AS n_removed, b.removed, b.first_doc AS least_first_doc
FROM documents d LEFT JOIN by_doc b USING (doc_id)
"""

#: Turns as (role, text), rebuilt; nodes are lists of these. crc32 is folded over bytes, each followed by eight shifts (-1).
OP11_SQL = """
WITH t AS (
    SELECT conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''),
        md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), ':', coalesce(text, '')))) AS own
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (
    SELECT conv_id, own, conv_id - conv_id % 100 AS base, CAST(xor(4294967295, list_reduce(
        list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: list_prepend(CAST(ascii(c) AS BIGINT), list_transform(range(8), lambda i: CAST(-1 AS BIGINT)))))),
        lambda s, b: CASE WHEN b >= 0 THEN xor(s, b) ELSE xor(s >> 1, 3988292384 * (s & 1)) END)) % 6 AS BIGINT) AS h
    FROM t
), c AS (
    SELECT h.conv_id, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:]) AS turns FROM h LEFT JOIN t b ON b.conv_id = h.base
), m AS (
    SELECT conv_id, d, len(turns) = d AS ends, turns[1:d] AS path, turns[1:d - 1] AS up, turns[d].x AS last FROM c, unnest(range(len(turns) + 1)) r(d)
), node AS (
    SELECT d, path, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n, length(coalesce(min(last), '')) AS chars,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends
    FROM m GROUP BY d, path
), kids AS (
    SELECT d - 1 AS d, up AS path, count(*) AS n FROM node WHERE d > 0 GROUP BY d, up
), own AS (
    SELECT node.*, coalesce(kids.n, 0) AS children, (node.n - 1) * CASE WHEN node.d = 0 THEN 0 ELSE chars END AS saved FROM node LEFT JOIN kids USING (d, path)
), sums AS (
    SELECT a.d, a.path, sum(CASE WHEN o.children = 0 THEN 1 ELSE 0 END) AS leaves, sum(o.saved) AS saved
    FROM own o, LATERAL (SELECT r.d, o.path[1:r.d] AS path FROM unnest(range(o.d + 1)) r(d)) a GROUP BY a.d, a.path
)
SELECT o.conv_id, CAST(o.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, o.n AS n_convs, o.children AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, o.ends AS ends_sha256
FROM own o JOIN sums s USING (d, path) LEFT JOIN node p ON p.d = o.d - 1 AND p.path = o.up AND o.d > 0
"""

#: White space becomes one space; of equal texts the smallest id stays.
OP13_SQL = """
WITH t AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS text FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(text) AS text_sha256
FROM t WINDOW w AS (PARTITION BY text)
"""

ORACLE_SQL: dict[str, str] = {
    "op11_conversation_prefix_trie": OP11_SQL,
    "op13_exact_dedup": OP13_SQL,
    "op2_line_dedup": OP2_SQL,
    "op9_epsilon_grid_near_dedup": OP9_SQL,
}
