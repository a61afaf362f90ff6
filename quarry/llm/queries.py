"""One query per operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encoding, fingerprints, flatfiles, language, merkle, near_duplicates, packing, prefix_trie, quality, secrets, simhash, substrings, training_order
from .common import documents, small_batches


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatfiles.count_tokens(documents(spark, sf_dir))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = lambda name: (F.col("fingerprint") == F.col(name)).cast("double")
    made = fingerprints.edited(documents(spark, sf_dir))
    return made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", same("edited_fingerprint").alias("near_edited"), same("next_fingerprint").alias("near_next"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.find(documents(spark, sf_dir))


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.write_shards(documents(spark, sf_dir))[0]


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = secrets.find(docs.select("doc_id", "text"), secrets.train(docs))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encoding.encode(documents(spark, sf_dir), decode=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir)).select("doc_id", "language", "confidence", "kept")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.find(documents(spark, sf_dir)).select("doc_id", "class_id", "copy_of", "linked_to", "likeness", "n_links")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.find(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tamper = F.when(prefix_trie.crc(F.col("doc_id")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    proven = merkle.manifest(documents(spark, sf_dir), tamper)
    siblings = F.array_join(F.transform(F.filter("proof", lambda s: s != "-"), lambda s: F.substring(s, 2, 64)), "")
    return proven.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", "verified")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    turns, convs = prefix_trie.numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefix_trie.nodes(*prefix_trie.rebuilt(turns, convs))


def queries() -> dict:
    return {f.__name__: f for f in (op1_packing, op2_quality_rules, op3_token_counts, op4_fingerprints, op5_substrings, op6_training_order, op7_secrets, op8_bpe, op9_language_id, op10_near_duplicates, op11_simhash, op12_merkle_manifest, op13_prefix_trie)}


def _op2_sql() -> str:
    rules = quality.RULES
    fails = ", ".join(f"({c}) AS f_{r}" for r, c in rules.items())
    sums = ", ".join(f"CAST(sum(CAST(f_{r} AS INTEGER)) AS DOUBLE) AS x_{r}" for r in rules)
    prior = ", ".join(f"avg(x_{r} / n) AS m_{r}, var_pop(x_{r} / n) AS v_{r}, sum(x_{r}) / sum(n) AS all_{r}" for r in rules)
    k = {r: f"CASE WHEN v_{r} > 0 THEN greatest(1.0, least(1000.0, m_{r} * (1 - m_{r}) / v_{r} - 1)) ELSE 1000.0 END" for r in rules}
    strict = ", ".join(f"(x_{r} + m_{r} * ({k[r]})) / (n + ({k[r]})) > greatest({quality.LEAST_RATE}, {quality.EXCESS} * all_{r}) AS strict_{r}" for r in rules)
    gone = " OR ".join(f"(f_{r} AND strict_{r})" for r in rules)
    return rf"""WITH w AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'null' ELSE '=' || source END AS host, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
    pos AS (SELECT doc_id, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w),
    tri AS (SELECT doc_id, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM pos WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    twice AS (SELECT doc_id, i FROM tri WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
    rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1),
    m AS (SELECT doc_id, host, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(ls) AS n_lines FROM w LEFT JOIN rep USING (doc_id)),
    f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {fails} FROM m),
    h AS (SELECT host, count(*) AS n, {sums} FROM f GROUP BY 1), p AS (SELECT {prior} FROM h), v AS (SELECT host, {strict} FROM h, p)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({gone}) AS kept FROM f JOIN v USING (host)"""


#: CTE of the 256 remainders of CRC-32, in one row.
_CRC = """crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(CAST(b AS BIGINT), CAST(range(8) AS BIGINT[])),
        lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS remainders)"""


def _crc_sql(number: str) -> str:
    return f"""xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda c, b: xor(remainders[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"""


def _op12_sql() -> str:
    code = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda n: "sha256(" + " || ".join(code(n if f == "n_chars" else f) for f in merkle.FIELDS) + ")"
    step = "CASE WHEN s.h IS NULL THEN '-' WHEN s.i % 2 = 0 THEN '<' || s.h ELSE '>' || s.h END"
    return f"""WITH RECURSIVE {_CRC}, held AS (SELECT *, CASE WHEN {_crc_sql("doc_id")} % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS changed FROM documents, crc),
    base AS (SELECT doc_id, coalesce('=' || lang, '') AS lk, {leaf("n_chars")} AS leaf, {leaf("changed")} AS now FROM held),
    b AS (SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY lk ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lk) AS n FROM base),
    tree(lk, lvl, i, n, h) AS (SELECT lk, 0, i, n, leaf FROM b UNION ALL SELECT lk, lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY lk, lvl, i // 2, n),
    subs AS (SELECT lk, h, row_number() OVER (ORDER BY lk) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
    top(lvl, i, n, h) AS (SELECT 100, i, n, h FROM subs UNION ALL SELECT lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY lvl, i // 2, n),
    own AS (SELECT r, l.lvl, {step} AS step FROM b JOIN (SELECT DISTINCT lk, lvl FROM tree WHERE n > 1) l ON l.lk = b.lk LEFT JOIN tree s ON s.lk = b.lk AND s.lvl = l.lvl AND s.i = xor(b.i >> l.lvl, 1)
        UNION ALL SELECT r, l.lvl, {step} FROM b JOIN subs u ON u.lk = b.lk, (SELECT DISTINCT lvl FROM top WHERE n > 1) l LEFT JOIN top s ON s.lvl = l.lvl AND s.i = xor(u.i >> (l.lvl - 100), 1)),
    way AS (SELECT r, list(step ORDER BY lvl) AS steps FROM own GROUP BY r),
    f AS (SELECT b.doc_id, b.leaf, u.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(array_to_string(list_transform(list_filter(steps, lambda s: s <> '-'), lambda s: s[2:]), ''), '')) AS proof_sha256,
        list_reduce(list_prepend(b.now, coalesce(steps, [])), lambda a, s: sha256(CASE WHEN s = '-' THEN a WHEN s[1] = '<' THEN s[2:] || a ELSE a || s[2:] END)) AS folded_root
        FROM b JOIN subs u ON u.lk = b.lk LEFT JOIN way ON way.r = b.r)
    SELECT *, folded_root = root AS verified FROM f"""


def _op13_sql() -> str:
    return f"""WITH {_CRC}, c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) - 1 AS pos, role, text FROM c),
    n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY 1),
    plan AS (SELECT a.conv_id, a.n, b.conv_id AS base, {_crc_sql("a.conv_id")} % 9 AS h, coalesce(b.n, 0) AS theirs FROM n a LEFT JOIN n b ON b.conv_id = a.conv_id - a.conv_id % 5, crc),
    turns AS (SELECT p.conv_id, pos, role, text FROM plan p JOIN t ON t.conv_id = p.base WHERE pos < h UNION ALL SELECT p.conv_id, pos - h + least(h, theirs), role, text FROM plan p JOIN t USING (conv_id) WHERE pos >= h),
    path AS (SELECT conv_id, 0 AS depth, '' AS k, 0 AS bytes FROM n UNION ALL
        SELECT conv_id, pos + 1, sha256(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY pos)), strlen(text) FROM turns),
    linked AS (SELECT *, lag(k) OVER w AS above, lead(k) OVER w IS NULL AS ends FROM path WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
    node AS (SELECT k, min(conv_id) AS conv_id, depth, any_value(above) AS above, count(*) AS n_convs, any_value(bytes) AS bytes, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM linked GROUP BY k, depth),
    kids AS (SELECT above AS k, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
    v AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (k)),
    sums AS (SELECT p.k, CAST(sum(CAST(n_children = 0 AS INTEGER)) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * v.bytes) AS BIGINT) AS saved_tokens FROM v JOIN path p ON p.conv_id = v.conv_id AND p.depth <= v.depth GROUP BY 1)
    SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256 FROM v JOIN sums USING (k) LEFT JOIN node up ON up.k = v.above"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": _op2_sql(), "op12_merkle_manifest": _op12_sql(), "op13_prefix_trie": _op13_sql()}
