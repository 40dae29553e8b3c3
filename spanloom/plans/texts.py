"""Queries: text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import text as X
from spanloom.operators import sampling as P
from spanloom.plans.registry import query, rounded, table


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _sql(columns: str, source: str = "SELECT doc_id, coalesce(text, '') AS text FROM documents") -> str:
    return f"SELECT doc_id, {columns} FROM ({source})"


@query("jaccard_with_previous_turn", r"""
WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda w: w <> '')) AS a FROM conversations),
p AS (SELECT conv_id, turn, a, coalesce(lag(a) OVER (PARTITION BY conv_id ORDER BY turn), []) AS b FROM w)
SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(a, b))) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END, 6) AS similarity FROM p""")  # fmt: skip
def jaccard_with_previous_turn(spark, d):
    from pyspark.sql.window import Window as W

    rows = table(spark, d, "conversations").select("conv_id", "turn", X.blank_words(F.coalesce("text", F.lit(""))).alias("a"))
    rows = rows.withColumn("b", F.coalesce(F.lag("a").over(W.partitionBy("conv_id").orderBy("turn")), F.array().cast("array<string>")))
    return rounded(rows.select("conv_id", "turn", X.jaccard(F.col("a"), F.col("b")).alias("similarity")))


@query("model_word_counts", _sql(r"CAST(len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS INTEGER) AS n_words, CAST(len(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'))) AS INTEGER) AS n_distinct"))
def model_word_counts(spark, d):
    words = X.model_words(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(words).alias("n_words"), F.size(F.array_distinct(words)).alias("n_distinct"))


@query("label_char_ngrams", "SELECT n_nationkey AS id, list_sort(list_distinct(list_transform(range(1, length(n_name) + 1), lambda i: substring(' ' || n_name || ' ', CAST(i AS BIGINT), 3)))) AS grams FROM nation")
def label_char_ngrams(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.array_sort(X.char_ngrams(F.col("n_name"), 3)).alias("grams"))


@query("normalized_phrases", r"""
SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce(text, ''))), '\s+', ' ', 'g'), '\b\d{1,2}/\d{1,2}/\d{2,4}\b', '<date>', 'g'),
  '\b\d{4}-\d{2}-\d{2}\b', '<date>', 'g'), '\b\d{1,2}:\d{2}(?:\s*[ap]m)?\b', '<time>', 'g'), '\b\d+(?:\.\d+)?\b', '<num>', 'g') AS norm FROM conversations""")  # fmt: skip
def normalized_phrases(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.normalize_phrase(F.coalesce("text", F.lit(""))).alias("norm"))


@query("match_forms", _sql(r"md5(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9''\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS form_md5"))
def match_forms(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(X.normalize_for_match(F.col("text")).cast("binary")).alias("form_md5"))


@query("codebook_ids", r"SELECT p_partkey, regexp_replace(trim(p_name), '\s+', '_', 'g') AS codebook_id, lower(replace(trim(p_name), ' ', '')) AS gold_key FROM part")
def codebook_ids(spark, d):
    return table(spark, d, "part").select("p_partkey", X.codebook_id(F.col("p_name")).alias("codebook_id"), X.gold_key(F.col("p_name")).alias("gold_key"))


@query("label_norms", "SELECT c_custkey, lower(trim(replace(replace(replace(replace(c_name || ' & ' || c_mktsegment, '-', '_'), ' ', '_'), '&', 'and'), '__', '_'))) AS norm FROM customer")
def label_norms(spark, d):
    name = F.concat("c_name", F.lit(" & "), "c_mktsegment")
    return table(spark, d, "customer").select("c_custkey", X.label_alias(name).alias("norm"))


@query("alias_heads", "SELECT n_nationkey, trim(regexp_extract(n_name || ' (old name)', '^([^(]*)', 1)) AS head FROM nation")
def alias_heads(spark, d):
    return table(spark, d, "nation").select("n_nationkey", X.alias_head(F.concat("n_name", F.lit(" (old name)"))).alias("head"))


@query("token_counts", _sql(
    r"CAST(len(regexp_extract_all(text, '[A-Za-z0-9'']+|-{2,}|[^\sA-Za-z0-9'']')) AS INTEGER) AS tokens, CAST(len(regexp_extract_all(trim(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS INTEGER) AS unicode_tokens,"
    r" CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS INTEGER) AS words, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS INTEGER) AS blank_words"))  # fmt: skip
def token_counts(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", F.size(X.tokens(t)).alias("tokens"), F.size(X.unicode_tokens(t)).alias("unicode_tokens"), X.word_count(t).alias("words"), X.blank_word_count(t).alias("blank_words"))


_BREAK = r"(?i)[.!?;:]+|\s*[,-]\s*|\s+\b(?:and|but|or|so|because|while|although|though|however|therefore|moreover|whereas|meanwhile|plus)\b\s+"


@query("clause_flags", rf"""
WITH t AS (SELECT conv_id, turn, trim(coalesce(text, '')) AS raw, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM conversations),
n AS (SELECT conv_id, turn, CAST(len(regexp_extract_all(raw, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')) AS INTEGER) AS a,
        CAST(len(list_filter(regexp_split_to_array(t, '{_BREAK}'), lambda p: len(list_filter(regexp_split_to_array(p, '\s+'), lambda w: w <> '')) >= 3)) AS INTEGER) AS b FROM t)
SELECT conv_id, turn, a AS span_len_tokens, b AS num_clause_segments, a >= 11 AS is_long, b >= 3 AS is_cross FROM n""")  # fmt: skip
def clause_flags(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.clause_flags(F.col("text")).alias("f")).select("conv_id", "turn", "f.*")


_TOPICS = {"joining": ["the", "and", "of"], "being": ["is", "are", "was"]}


_HITS = r"len(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda w: w IN ({words})))"


@query("topic_features", _sql(", ".join(
    f"CAST({_HITS.format(words=', '.join(repr(w) for w in words))} AS INTEGER) AS topic_{n}_count, CAST({_HITS.format(words=', '.join(repr(w) for w in words))} > 0 AS INTEGER) AS topic_{n}_has" for n, words in _TOPICS.items())))
def topic_features(spark, d):
    return P.topic_features(_docs(spark, d), "text", _TOPICS).drop("text")


@query("cue_features", _sql(r"CAST(contains(text, '?') AS INTEGER) AS has_question, CAST(contains(lower(text), 'please') AS INTEGER) AS has_please, CAST(contains(lower(text), 'thank') AS INTEGER) AS has_thanks, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS INTEGER) AS len_words"))
def cue_features(spark, d):
    return _docs(spark, d).select("doc_id", X.cue_features(F.col("text")).alias("f")).select("doc_id", "f.*")


@query("discourse_cues", _sql(", ".join("(" + " OR ".join(f"contains(lower(text), '{c}')" for c in cues) + f") AS {kind}" for kind, cues in X.CUES.items())))
def discourse_cues(spark, d):
    return _docs(spark, d).select("doc_id", *[X.has_cue(F.col("text"), kind).alias(kind) for kind in X.CUES])


@query("keyword_hits", _sql(r"(contains(lower(text), 'password') OR regexp_matches(lower(text), '(?i)\bthe\b') OR contains(lower(text), '\bthe\b')) AS hit"))
def keyword_hits(spark, d):
    return _docs(spark, d).select("doc_id", X.keyword_hit(F.col("text"), ["password", r"\bthe\b"]).alias("hit"))


@query("example_hashes", "SELECT conv_id, turn, sha1(role || '||' || coalesce(text, '') || '>>' || coalesce(next_role, '') || '||' || coalesce(next_text, '')) AS example_hash FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))")
def example_hashes(spark, d):
    from pyspark.sql.window import Window as W

    w = W.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").withColumns({"next_role": F.lead("role").over(w), "next_text": F.lead("text").over(w)})
    some = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.select("conv_id", "turn", X.example_hash(F.col("role"), some("text"), some("next_role"), some("next_text")).alias("example_hash"))


@query("prefixed_labels", "SELECT n_nationkey, CAST(n_regionkey AS VARCHAR) || '_' || CAST(n_nationkey AS VARCHAR) AS index, n_name AS name FROM nation")
def prefixed_labels(spark, d):
    entry = F.concat(F.col("n_regionkey").cast("string"), F.lit("_"), F.col("n_nationkey").cast("string"), F.lit(" : "), F.col("n_name"))
    return table(spark, d, "nation").select("n_nationkey", X.prefixed_label(entry).alias("p")).select("n_nationkey", "p.*")


@query("safe_filenames", r"""SELECT page_id, regexp_replace(url, '[<>:"/\\|?*]', '_', 'g') AS name FROM pages""")
def safe_filenames(spark, d):
    return table(spark, d, "pages").select("page_id", X.safe_filename(F.col("url")).alias("name"))


@query("stems", "SELECT p_partkey, regexp_replace(replace(p_name, ' ', '_'), '_(ring|bolt|srl)$', '') AS stem FROM part")
def stems(spark, d):
    return table(spark, d, "part").select("p_partkey", X.stem_without(F.replace("p_name", F.lit(" "), F.lit("_")), ["ring", "bolt", "srl"]).alias("stem"))


def _markdown_sql(value: str) -> str:
    for pattern, to in X.MARKDOWN:
        value = f"regexp_replace({value}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return f"trim(regexp_replace({value}, '^\\s+|\\s+$', '', 'g')) || chr(10)"


@query("markdown_stripped", f"SELECT page_id, md5({_markdown_sql("coalesce(html, '')")}) AS text_md5 FROM pages")
def markdown_stripped(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(X.strip_markdown(F.coalesce("html", F.lit(""))).cast("binary")).alias("text_md5"))


#: Word edges beyond ASCII, for an engine whose own know ASCII only.
_EDGE = (r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])")
_PIECES = r"list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[,;]| and '), lambda p: trim(p)), lambda p: p <> '')"


@query("mini_chunks", rf"""
WITH p AS (SELECT conv_id, turn, unnest({_PIECES}) AS text, unnest(range(len({_PIECES}))) AS pos FROM conversations)
SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, text, CASE WHEN regexp_matches(text, '{_EDGE[0]}(in|on|at|to|for|with|of|by){_EDGE[1]}') THEN 'PP' WHEN regexp_matches(text, '{_EDGE[0]}(is|are|was|were|am|be|been){_EDGE[1]}') THEN 'VP_COP'
  WHEN regexp_matches(text, '{_EDGE[0]}(ran|run|made|make|see|saw|want|wanted){_EDGE[1]}') THEN 'VP' ELSE 'NP' END AS type FROM p""")  # fmt: skip
def mini_chunks(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(X.mini_chunks(F.coalesce("text", F.lit("")))).alias("pos", "c"))
    return rows.select("conv_id", "turn", "pos", "c.text", "c.type")


@query("first_filled", "SELECT page_id, coalesce(nullif(trim(CASE WHEN page_id % 3 = 0 THEN '  ' ELSE url END), ''), nullif(trim(html), '')) AS value FROM pages")
def first_filled(spark, d):
    return table(spark, d, "pages").select("page_id", X.first_filled(F.expr("CASE WHEN page_id % 3 = 0 THEN '  ' ELSE url END"), F.col("html")).alias("value"))


@query("embedded_json", "SELECT event_id, props AS found FROM events WHERE props IS NOT NULL")
def embedded_json(spark, d):
    from spanloom.functions.records import balanced_json_udf

    events = table(spark, d, "events").where("props IS NOT NULL")
    return events.select("event_id", balanced_json_udf(F.concat(F.lit("so } here [it is: "), "props", F.lit(" and {more"))).alias("found"))
