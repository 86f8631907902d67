"""The registered queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention_lm, bpe, conversation_repair, exact_dedup, html_blocks, language_id, line_dedup, merkle_manifest, mixing, pii, quality_fm, rule_ledger, simhash_pigeonring
from .common import documents, fold, labels, stored


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score(documents(spark, sf_dir), vocabulary())


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = quality_fm.score(docs, quality_fm.fit(docs, labels(spark, sf_dir)))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= quality_fm.THRESHOLD).cast("int").alias("predicted"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    named = language_id.identify(docs, language_id.learn(docs))
    return named.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir))
    base = pii.span_text(F.col("base"))
    kinds = [F.size(F.filter("base", pii.of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    listed = F.filter("added", lambda c: c["kind"] < len(pii.KINDS))
    secrets = F.filter("added", lambda c: c["kind"] >= len(pii.KINDS))
    return found.select(
        "doc_id", *kinds, F.sha2(base, 256).alias("base_sha256"), pii.span_text(F.array_sort(F.concat("base", listed))).alias("spans"),
        pii.span_text(F.array_sort(secrets)).alias("secrets"), F.size("added").cast("long").alias("n_added"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(documents(spark, sf_dir))
    return done.select("doc_id", "n_lines", "n_removed", "n_links", F.sha2("text", 256).alias("text_sha256"))


def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir), vocabulary(), keep=())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rule_ledger.apply_policy(rule_ledger.ledger(documents(spark, sf_dir)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("failures").cast("int").alias("failures"))


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the latest policy rejects, and what would stay without it, from the stored ledger."""
    return rule_ledger.ablations(stored(rule_ledger.ledger(documents(spark, sf_dir)).select("doc_id", "failures"), "rule-ledger"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_pigeonring.simhash_groups(documents(spark, sf_dir))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    # tampered with: every second row by the checksum of its id has lost its line feeds
    claimed = F.when(fold("doc_id", 2) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    fields = [F.col(f) for f in merkle_manifest.FIELDS[:-1]]
    made = merkle_manifest.manifest(docs, claimed=merkle_manifest.leaf([*fields, claimed]))
    return made.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversation_repair.repair_conversations(rows).withColumnRenamed("id", "conv_id")


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_mixing": op2_mixing,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_pii": op5_pii,
    "op6_line_dedup": op6_line_dedup,
    "op7_bpe": op7_bpe,
    "op8_language_id": op8_language_id,
    "op9_quality_rules": op9_quality_rules,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_html_extraction": op11_html_extraction,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_conversation_repair": op13_conversation_repair,
    "rule_ablations": rule_ablations,
}

def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string: each byte is folded into the register, which then takes eight shifts."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bits}), lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295)"


def _field_sql(col: str) -> str:
    return f"coalesce(CAST(strlen(CAST({col} AS VARCHAR)) AS VARCHAR) || ':' || CAST({col} AS VARCHAR), '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


ORACLE_SQL = {
    "op12_merkle_manifest": f"""
WITH RECURSIVE
     d AS (SELECT doc_id, source, text, {_leaf_sql("text")} AS leaf,
                  CASE WHEN {_crc32_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS claimed,
                  row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM documents),
     up(level, source, pos, h, n) AS (SELECT 0, source, pos, leaf, n FROM d
                  UNION ALL SELECT level + 1, source, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM up WHERE n > 1 GROUP BY level, source, pos // 3, n),
     sub AS (SELECT source, h AS subroot, level AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
     top(level, pos, h, n) AS (SELECT 0, pos, subroot, n FROM sub
                  UNION ALL SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY level, pos // 3, n),
     root AS (SELECT h AS root FROM top WHERE n = 1),
     sib AS (SELECT d.doc_id, 0 AS tree, u.level, u.pos, u.h FROM d JOIN sub s ON s.source IS NOT DISTINCT FROM d.source JOIN up u ON u.source IS NOT DISTINCT FROM d.source AND u.level < s.height
                  AND u.pos // 3 = d.pos // CAST(3 ** (u.level + 1) AS BIGINT) AND u.pos <> d.pos // CAST(3 ** u.level AS BIGINT)
             UNION ALL SELECT d.doc_id, 1, t.level, t.pos, t.h FROM d JOIN sub s ON s.source IS NOT DISTINCT FROM d.source JOIN top t ON t.n > 1
                  AND t.pos // 3 = s.pos // CAST(3 ** (t.level + 1) AS BIGINT) AND t.pos <> s.pos // CAST(3 ** t.level AS BIGINT)),
     proof AS (SELECT doc_id, string_agg(h, '' ORDER BY tree, level, pos) AS p FROM sib GROUP BY doc_id),
     fold(doc_id, source, level, pos, h, n) AS (SELECT doc_id, source, 0, pos, claimed, n FROM d
                  UNION ALL SELECT f.doc_id, f.source, f.level + 1, f.pos // 3, sha256(string_agg(CASE WHEN u.pos = f.pos THEN f.h ELSE u.h END, '' ORDER BY u.pos)), (f.n + 2) // 3
                  FROM fold f JOIN up u ON u.source IS NOT DISTINCT FROM f.source AND u.level = f.level AND u.pos // 3 = f.pos // 3 WHERE f.n > 1 GROUP BY f.doc_id, f.source, f.level, f.pos // 3, f.n),
     fold2(doc_id, level, pos, h, n) AS (SELECT f.doc_id, 0, s.pos, f.h, s.n FROM fold f JOIN sub s ON s.source IS NOT DISTINCT FROM f.source WHERE f.n = 1
                  UNION ALL SELECT f.doc_id, f.level + 1, f.pos // 3, sha256(string_agg(CASE WHEN t.pos = f.pos THEN f.h ELSE t.h END, '' ORDER BY t.pos)), (f.n + 2) // 3
                  FROM fold2 f JOIN top t ON t.level = f.level AND t.pos // 3 = f.pos // 3 WHERE f.n > 1 GROUP BY f.doc_id, f.level, f.pos // 3, f.n)
SELECT d.doc_id, d.leaf, s.subroot, r.root, sha256(coalesce(p.p, '')) AS proof_sha256, f.h AS folded_root, f.h = r.root AS verified
FROM d JOIN sub s ON s.source IS NOT DISTINCT FROM d.source JOIN fold2 f ON f.doc_id = d.doc_id AND f.n = 1 LEFT JOIN proof p ON p.doc_id = d.doc_id, root r
""",
    "op13_conversation_repair": f"""
WITH RECURSIVE
     c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations),
     e AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                  unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM c WHERE kind <> 0),
     o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM e),
     f AS (SELECT *, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
                  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
                       WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') THEN 3 ELSE 0 END AS fault FROM o),
     stat AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
                     count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
     ins(state, k, t) AS (VALUES (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (2, 2, 2), (3, 0, 3), (3, 1, 2), (3, 2, 3)),
     move(state, initial, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
     edit AS (SELECT f.conv_id, f.i, m.state, m.t, 'K' AS edit, CASE WHEN fault = 3 THEN 1 ELSE 0 END AS cost FROM f JOIN move m USING (initial) WHERE fault IN (0, 3)
              UNION ALL SELECT f.conv_id, f.i, m.state, m.t, 'R', CASE WHEN fault = 3 THEN 3 ELSE 2 END FROM f JOIN move m ON m.initial <> 's' WHERE fault IN (0, 3)
              UNION ALL SELECT f.conv_id, f.i, s.state, s.state, 'D', 3 FROM f, (SELECT unnest(range(4)) AS state) s),
     way(conv_id, i, state, best) AS (SELECT conv_id, 0::BIGINT, 0::BIGINT, {{'cost': 0::BIGINT, 'audit': ''}} FROM stat
              UNION ALL SELECT w.conv_id, w.i + 1, CAST(x.t AS BIGINT), min({{'cost': w.best.cost + 2 * ins.k + x.cost, 'audit': w.best.audit || repeat('I', ins.k) || x.edit}})
              FROM way w JOIN ins ON ins.state = w.state JOIN edit x ON x.conv_id IS NOT DISTINCT FROM w.conv_id AND x.i = w.i + 1 AND x.state = ins.t GROUP BY w.conv_id, w.i, x.t),
     won AS (SELECT w.conv_id, min({{'cost': w.best.cost + 2 * ins.k, 'audit': w.best.audit || repeat('I', ins.k)}}) AS best
             FROM way w JOIN stat s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.n = w.i JOIN ins ON ins.state = w.state AND ins.t IN (0, 3) GROUP BY w.conv_id),
     step AS (SELECT conv_id, best, unnest(string_split(best.audit, '')) AS edit, unnest(range(1, len(best.audit) + 1)) AS spot FROM won WHERE best.audit <> ''),
     placed AS (SELECT *, sum(CASE WHEN edit = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY spot) AS i, sum(CASE WHEN edit = 'D' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY spot) AS live FROM step),
     opening AS (SELECT p.conv_id, bool_or(p.live = 1 AND p.edit = 'K' AND f.initial = 's') AS led FROM placed p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i GROUP BY p.conv_id),
     said AS (SELECT p.conv_id, p.spot, CASE WHEN p.edit = 'K' THEN f.role WHEN (p.live - CASE WHEN l.led THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN p.edit = 'I' THEN '' ELSE f.text END AS line
              FROM placed p LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i LEFT JOIN opening l ON l.conv_id IS NOT DISTINCT FROM p.conv_id WHERE p.edit <> 'D'),
     joined AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY spot) AS t FROM said GROUP BY conv_id)
SELECT a.conv_id, coalesce(s.gaps, 0) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate, coalesce(s.truncated, 0) AS truncated, coalesce(s.illegal, 0) AS illegal,
       coalesce(w.best.cost, 0) AS cost, coalesce(w.best.audit, '') AS audit, sha256(coalesce(t.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN stat s ON s.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN won w ON w.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN joined t ON t.conv_id IS NOT DISTINCT FROM a.conv_id
""",
    "op1_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
     g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
""",
    "op9_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, regexp_replace(t, '[\x20\x09-\x0D]', '', 'g') AS solid FROM d),
     pos AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE len(ws) >= 8),
     eight AS (SELECT doc_id, i, lead(x, 7) OVER o AS last, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o, lead(x, 5) OVER o, lead(x, 6) OVER o, lead(x, 7) OVER o) AS k FROM pos WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
     win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM eight WHERE last IS NOT NULL),
     cov AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM win WHERE c > 1) GROUP BY doc_id),
     li AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
     lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM li WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
     m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(solid) AS BIGINT) AS word_chars,
                  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                  length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS n_lower FROM w),
     a AS (SELECT m.*, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
           FROM m LEFT JOIN lines USING (doc_id) LEFT JOIN cov USING (doc_id)),
     f AS (SELECT *, CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
                  + CASE WHEN 4 * n_symbols > n_words THEN 4 ELSE 0 END
                  + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) THEN 8 ELSE 0 END
                  + CASE WHEN n_lines > 0 AND 10 * n_dup_lines > 5 * n_lines THEN 16 ELSE 0 END
                  + CASE WHEN n_upper > 5 * n_lower AND n_upper > 50 THEN 32 ELSE 0 END AS failures FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       failures = 0 AS kept, CAST(failures AS INTEGER) AS failures FROM f
""",
    "op6_line_dedup": r"""
WITH li AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
     occ AS (SELECT doc_id, pos, l FROM li WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY doc_id, pos) AS r FROM occ),
     rep AS (SELECT doc_id, pos, row_number() OVER (ORDER BY doc_id, pos) AS k, list_distinct(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS ws FROM ranked WHERE r = 1),
     tok AS (SELECT k, len(ws) AS n, unnest(ws) AS w FROM rep),
     df AS (SELECT w, count(*) AS c FROM tok GROUP BY w HAVING count(*) > 1),
     pre AS (SELECT k, n, w FROM (SELECT k, n, w, c, row_number() OVER (PARTITION BY k ORDER BY coalesce(c, 1), w) AS spot FROM tok LEFT JOIN df USING (w)) WHERE spot <= n - CAST(ceil(n * 4 / 5) AS BIGINT) + 1 AND c > 1),
     cand AS (SELECT DISTINCT a.k AS a, b.k AS b FROM pre a JOIN pre b ON a.w = b.w AND a.k < b.k AND a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4),
     link AS (SELECT x.doc_id AS a_id, y.doc_id AS b_id, y.pos AS b_pos FROM cand JOIN rep x ON x.k = a JOIN rep y ON y.k = b
              WHERE len(list_intersect(x.ws, y.ws)) * 9 >= (len(x.ws) + len(y.ws)) * 4),
     gone AS (SELECT doc_id, pos FROM ranked WHERE r > 1 UNION SELECT b_id, b_pos FROM link),
     cnt AS (SELECT id AS doc_id, count(*) AS n FROM (SELECT a_id AS id FROM link UNION ALL SELECT b_id FROM link) GROUP BY id),
     stay AS (SELECT li.doc_id, string_agg(l, chr(10) ORDER BY li.pos) AS t FROM li ANTI JOIN gone ON li.doc_id = gone.doc_id AND li.pos = gone.pos GROUP BY li.doc_id),
     nl AS (SELECT doc_id, count(*) AS n FROM occ GROUP BY doc_id),
     nr AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(nl.n, 0) AS n_lines, coalesce(nr.n, 0) AS n_removed, coalesce(cnt.n, 0) AS n_links,
       CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(t, '')) END AS text_sha256
FROM documents d LEFT JOIN nl USING (doc_id) LEFT JOIN nr USING (doc_id) LEFT JOIN cnt USING (doc_id) LEFT JOIN stay USING (doc_id)
""",
}

ORACLE_SQL["rule_ablations"] = f"""WITH l AS ({ORACLE_SQL["op9_quality_rules"]}), r AS (SELECT unnest({[n for n, _ in rule_ledger.RULES]}) AS rule, unnest(range({len(rule_ledger.RULES)})) AS bit)
SELECT rule, CAST(bit AS INTEGER) AS bit, count(*) FILTER (failures & (1 << bit) <> 0) AS failing, count(*) FILTER (failures = 1 << bit) AS failing_alone, count(*) FILTER (failures = 0 OR failures = 1 << bit) AS kept_without FROM l, r GROUP BY ALL"""
