"""The thin opN_<name> queries over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.session import ship

from . import chat, jaccard_join, mixing, packing, quality, radix_dedup, rp_forest, secrets, sharding, warc
from .common import stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), mixing.cycle_weights([5, 2, 1]))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = secrets.BASE + secrets.EXTRA
    found = secrets.scan(_table(spark, sf_dir, "documents"), rules)
    base = F.filter("found", lambda s: s["kind"] < len(secrets.BASE))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.describe(base, rules), 256).alias("base_sha256"), secrets.describe(F.col("found"), rules).alias("spans"),
    )


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), shards=40)


_CONTROL = "</s>[INST] ok [/INST]"


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", _CONTROL), (-1, 1, "assistant", _CONTROL)], "conv_id long, turn long, role string, text string")
    turns = turns.unionByName(more).withColumn("parts", chat.text_parts(F.col("text")))
    done = stage(chat.format_turns(turns), "chat")
    back = done.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"), chat.learned_text(F.col("formatted"), F.col("loss")).alias("learned"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["body"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.convert_pages(_table(spark, sf_dir, "pages"))
    return records.selectExpr("key AS page_id", "bytes AS payload_bytes", "digest AS payload_digest", "type AS record_type", "refers_to")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op10_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.near_duplicates(_table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_best_fit": op2_best_fit,
        "op3_quality": op3_quality,
        "op4_secrets": op4_secrets,
        "op5_shards": op5_shards,
        "op6_chat": op6_chat,
        "op7_warc": op7_warc,
        "op8_jaccard": op8_jaccard,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_forest": op10_forest,
    }


_OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM d GROUP BY source),
w AS (SELECT source, s, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
r AS (SELECT *, sum(s) OVER () AS total,
             coalesce(sum(3 * s) OVER (ORDER BY s / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
             sum(w) OVER (ORDER BY s / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
             row_number() OVER (ORDER BY s / w, source) AS k FROM w),
f AS (SELECT min(k) AS k FROM r WHERE (total - caps) * w <= 3 * s * rest),
l AS (SELECT total - caps AS left_over, rest AS rest_w, f.k AS fk FROM r JOIN f ON r.k = f.k),
t AS (SELECT source, s, CASE WHEN k < fk THEN CAST(3 * s AS DOUBLE) ELSE CAST(left_over * w AS DOUBLE) / rest_w END AS target FROM r, l),
n AS (SELECT source, s, target, CASE WHEN s = 0 THEN 0 ELSE least(3, CAST(floor(target / s) AS BIGINT)) END AS whole FROM t),
g AS (SELECT source, u, sum(size) AS size FROM d GROUP BY source, u),
c AS (SELECT g.source, u, g.size, target - whole * s AS need,
             coalesce(sum(g.size) OVER (PARTITION BY g.source ORDER BY u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM g JOIN n ON g.source IS NOT DISTINCT FROM n.source),
x AS (SELECT source, max(u) AS top FROM c WHERE need > 0 AND before + size / 2 <= need GROUP BY source)
SELECT d.doc_id, d.size, n.s AS source_size, n.target,
       d.size * (n.whole + CASE WHEN d.u <= coalesce(x.top, -1) THEN 1 ELSE 0 END) AS taken
FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source
"""

_OP9_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM t
"""


def _spans_sql(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, a AS s, a + length(m) AS e
  FROM (SELECT doc_id, unnest(range(1, len(ms) + 1)) AS i, ms, gs, ps FROM (
          SELECT doc_id, regexp_extract_all(t, {p}) AS ms, regexp_extract_all(t, {p}, {group}) AS gs, string_split_regex(t, {p}) AS ps
          FROM d WHERE regexp_matches(t, {p}))) q,
       LATERAL (SELECT ms[i] AS m, gs[i] AS g, CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a)
  WHERE length(g) >= {least}"""


def _op4_sql() -> str:
    rules = secrets.BASE + secrets.EXTRA
    found = " UNION ALL ".join(_spans_sql(r.kind, i, r.pattern, r.group, r.least) for i, r in enumerate(rules))
    told = "coalesce(string_agg({w} kind || ':' || s || ':' || e, ',' ORDER BY s, rank) {f}, '')"
    base = "FILTER (WHERE rank < 3)"
    count = "count(*) FILTER (WHERE kind = '{k}') AS n_{k}"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
a AS (SELECT doc_id, {", ".join(count.format(k=r.kind) for r in secrets.BASE)}, {told.format(w="", f=base)} AS base, {told.format(w="", f="")} AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""


_OP6_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{_CONTROL}'),
e AS (SELECT *, regexp_replace(text, '{chat.HEADS}(\\*){chat.TAILS}', '\1\\\2\3', 'g') AS escaped FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(escaped) + length(role) + {len(chat.TURN) + len(chat.BODY) + len(chat.END)}) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

_OP7_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS top FROM d)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM g
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": _OP1_SQL, "op4_secrets": _op4_sql(), "op6_chat": _OP6_SQL, "op7_warc": _OP7_SQL, "op9_exact_dedup": _OP9_SQL}
