"""Queries: phrases, their association with labels, sentence scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import text as X
from spanloom.operators import phrases as P
from spanloom.plans.registry import query, rounded, table
from spanloom.plans.texts import _EDGE, _PIECES

# Phrases of conversations by the mini chunker; records are turns, labels roles, sentences turns too, clauses the pieces.
_PHRASES = rf"""
raw AS (SELECT conv_id, turn, role, unnest({_PIECES}) AS text, unnest(range(len({_PIECES}))) AS pos FROM conversations),
ph AS (SELECT conv_id || '-' || turn AS rec_id, role AS label, turn AS sent_no, pos AS clause_no, text,
         CASE WHEN regexp_matches(text, '{_EDGE[0]}(in|on|at|to|for|with|of|by){_EDGE[1]}') THEN 'PP' WHEN regexp_matches(text, '{_EDGE[0]}(is|are|was|were|am|be|been){_EDGE[1]}') THEN 'VP_COP'
              WHEN regexp_matches(text, '{_EDGE[0]}(ran|run|made|make|see|saw|want|wanted){_EDGE[1]}') THEN 'VP' ELSE 'NP' END AS type FROM raw),
n AS (SELECT count(DISTINCT rec_id) AS n FROM ph),
pool AS (SELECT text, type, count(DISTINCT rec_id) AS doc_freq, count(*) AS occurrences FROM ph GROUP BY 1, 2),
lf AS (SELECT label, count(DISTINCT rec_id) AS label_freq FROM ph GROUP BY 1),
co AS (SELECT text, type, label, count(DISTINCT rec_id) AS doc_cofreq FROM ph GROUP BY 1, 2, 3),
edges AS (SELECT co.text, co.type, co.label, doc_cofreq, log2(doc_cofreq * n / (doc_freq * label_freq)) AS pmi FROM co JOIN pool ON co.text = pool.text AND co.type = pool.type JOIN lf ON co.label = lf.label, n)"""


def _phrases(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("label"), F.posexplode(X.mini_chunks(F.coalesce("text", F.lit("")))).alias("clause_no", "c"))
    return rows.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("rec_id"), "label", F.col("turn").alias("sent_no"), "clause_no", "c.text", "c.type")


@query("phrase_type_counts", f"WITH {_PHRASES} SELECT type, count(*) AS count FROM ph GROUP BY 1")
def phrase_type_counts(spark, d):
    return P.type_counts(_phrases(spark, d))


@query("phrase_type_grid", f"WITH {_PHRASES}, g AS (SELECT * FROM (SELECT DISTINCT label FROM ph), (SELECT DISTINCT type FROM ph)), c AS (SELECT label, type, count(*) AS c FROM ph GROUP BY 1, 2) SELECT g.label, g.type, coalesce(c, 0) AS count FROM g LEFT JOIN c ON g.label = c.label AND g.type = c.type")
def phrase_type_grid(spark, d):
    return P.type_counts(_phrases(spark, d), "label")


@query("phrase_document_frequencies", f"WITH {_PHRASES} SELECT text, type, doc_freq, occurrences FROM pool")
def phrase_document_frequencies(spark, d):
    return P.document_frequencies(_phrases(spark, d))[0]


@query("phrase_label_association", f"WITH {_PHRASES} SELECT text, type, label, doc_cofreq, round(pmi, 6) AS pmi FROM edges")
def phrase_label_association(spark, d):
    return rounded(P.association(_phrases(spark, d)))


@query("phrase_pool", f"""
WITH {_PHRASES}, e AS (SELECT *, round(pmi, 9) AS p, doc_cofreq / sum(doc_cofreq) OVER (PARTITION BY text, type) AS share FROM edges),
s AS (SELECT text, type, min({{'m': -p, 'l': label}}) AS top, max(share) AS pu, -sum(share * log2(share)) AS en FROM e GROUP BY 1, 2)
SELECT pool.text, pool.type, occurrences, doc_freq, top.l AS top_label, round(-top.m, 6) AS top_pmi, round(pu, 6) AS label_purity, round(en, 6) AS label_entropy FROM pool JOIN s ON pool.text = s.text AND pool.type = s.type""")  # fmt: skip
def phrase_pool(spark, d):
    rows = _phrases(spark, d)
    edges = P.association(rows).withColumn("pmi", F.round("pmi", 9))
    return rounded(P.phrase_pool(rows, edges))


@query("phrase_overview", f"""
WITH {_PHRASES}, o AS (SELECT count(DISTINCT rec_id) AS records, count(DISTINCT (rec_id, sent_no)) AS sentences, count(DISTINCT (rec_id, sent_no, clause_no)) AS clauses, count(*) AS phrases FROM ph)
SELECT *, round(phrases / records, 6) AS phrases_per_record, round(phrases / sentences, 6) AS phrases_per_sentence, round(phrases / clauses, 6) AS phrases_per_clause FROM o""")  # fmt: skip
def phrase_overview(spark, d):
    return rounded(P.overview(_phrases(spark, d)))


_NORM = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(text)), '\s+', ' ', 'g'), '\b\d{1,2}/\d{1,2}/\d{2,4}\b', '<date>', 'g'), '\b\d{4}-\d{2}-\d{2}\b', '<date>', 'g'), '\b\d{1,2}:\d{2}(?:\s*[ap]m)?\b', '<time>', 'g'), '\b\d+(?:\.\d+)?\b', '<num>', 'g')"


@query("phrase_index_keys", f"WITH {_PHRASES} SELECT {_NORM} AS norm, type, max(doc_freq) AS doc_freq, CAST(sum(occurrences) AS BIGINT) AS occurrences, list_slice(list_sort(list(DISTINCT text)), 1, 5) AS examples FROM pool GROUP BY 1, 2")
def phrase_index_keys(spark, d):
    rows = _phrases(spark, d)
    edges = P.association(rows)
    return P.build_index(P.phrase_pool(rows, edges), edges)[0].select("norm", "type", "doc_freq", "occurrences", "examples")


@query("phrase_index_scores", f"WITH {_PHRASES} SELECT {_NORM} AS norm, type, label, CAST(sum(doc_cofreq) AS BIGINT) AS cofreq, round(max(pmi), 6) AS pmi FROM edges GROUP BY 1, 2, 3")
def phrase_index_scores(spark, d):
    rows = _phrases(spark, d)
    edges = P.association(rows)
    return rounded(P.build_index(P.phrase_pool(rows, edges), edges)[1])


@query("label_prior", f"WITH {_PHRASES} SELECT label, CAST(sum(doc_cofreq) AS BIGINT) AS prior FROM edges GROUP BY 1")
def label_prior(spark, d):
    return P.label_prior(P.association(_phrases(spark, d)))


def _asked(spark, d):
    rows = table(spark, d, "conversations").where("role = 'user'").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("sentence_id"), F.posexplode(X.mini_chunks(F.coalesce("text", F.lit("")))).alias("p", "c"))
    return rows.select("sentence_id", F.concat_ws("-", "sentence_id", F.col("p").cast("string")).alias("phrase_id"), "c.text", "c.type")


_CANDIDATES = rf"""
sets AS (SELECT x, list_distinct(list_transform(range(1, length(x) + 1), lambda i: substring(' ' || x || ' ', CAST(i AS BIGINT), 3))) AS g, list_distinct(list_filter(regexp_split_to_array(lower(x), '\s+'), lambda w: w <> '')) AS w FROM (SELECT DISTINCT {_NORM} AS x FROM ph)),
have AS (SELECT DISTINCT {_NORM} AS norm, type FROM pool), ask AS (SELECT rec_id || '-' || clause_no AS phrase_id, rec_id AS sentence_id, {_NORM} AS q, type FROM ph WHERE label = 'user'),
pairs AS (SELECT a.q, h.norm, a.type, len(list_intersect(s.g, t.g)) / (len(s.g) + len(t.g) - len(list_intersect(s.g, t.g))) AS jg, len(list_intersect(s.w, t.w)) / (len(s.w) + len(t.w) - len(list_intersect(s.w, t.w))) AS jw
  FROM (SELECT DISTINCT q, type FROM ask) a JOIN have h ON h.type = a.type AND h.norm <> a.q JOIN sets s ON s.x = a.q JOIN sets t ON t.x = h.norm
  WHERE least(len(s.w), len(t.w)) >= 0.85 * greatest(len(s.w), len(t.w)) AND least(len(s.w), len(t.w)) > 0),
met AS (SELECT phrase_id, sentence_id, norm, ask.type, jg AS similarity, 0 AS exact FROM ask JOIN pairs ON pairs.q = ask.q AND pairs.type = ask.type WHERE jg >= 0.85 AND jw >= 0.85
  UNION ALL SELECT phrase_id, sentence_id, norm, ask.type, 1.0, 1 FROM ask JOIN have ON have.norm = ask.q AND have.type = ask.type),
found AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY phrase_id ORDER BY similarity DESC, exact DESC, norm) <= 5)"""


@query("phrase_candidates", f"WITH {_PHRASES}, {_CANDIDATES} SELECT phrase_id, norm, type, round(similarity, 6) AS similarity FROM found")
def phrase_candidates(spark, d):
    rows = _phrases(spark, d)
    edges = P.association(rows)
    return rounded(P.candidates(_asked(spark, d), P.build_index(P.phrase_pool(rows, edges), edges)[0]))


@query("exact_sentence_scores", f"""
WITH {_PHRASES}, sc AS (SELECT {_NORM} AS norm, type, label, sum(doc_cofreq) AS cofreq, max(pmi) AS pmi FROM edges GROUP BY 1, 2, 3), pr AS (SELECT label, 0.5 * ln(1 + sum(doc_cofreq)) AS base FROM edges GROUP BY 1),
q AS (SELECT rec_id AS sentence_id, {_NORM} AS norm, type FROM ph WHERE label = 'user'), h AS (SELECT sentence_id, label, sum(greatest(pmi, 0) * ln(1 + cofreq)) AS hit FROM q JOIN sc ON q.norm = sc.norm AND q.type = sc.type GROUP BY 1, 2),
s AS (SELECT i.sentence_id, pr.label, coalesce(hit, 0) + base AS score FROM (SELECT DISTINCT sentence_id FROM q) i CROSS JOIN pr LEFT JOIN h ON h.sentence_id = i.sentence_id AND h.label = pr.label),
m AS (SELECT *, exp(score - max(score) OVER (PARTITION BY sentence_id)) AS e FROM s)
SELECT sentence_id, label, round(score, 6) AS score, round(e / sum(e) OVER (PARTITION BY sentence_id), 6) AS probability FROM m""")  # fmt: skip
def exact_sentence_scores(spark, d):
    rows = _phrases(spark, d)
    edges = P.association(rows)
    _, scores = P.build_index(P.phrase_pool(rows, edges), edges)
    asked = _asked(spark, d)
    found = asked.select("phrase_id", X.normalize_phrase(F.col("text")).alias("norm"), "type", F.lit(1.0).alias("similarity"))
    return rounded(P.sentence_scores(asked, found, scores, P.label_prior(edges)))


@query("sentence_scores", f"""
WITH {_PHRASES}, {_CANDIDATES}, sc AS (SELECT {_NORM} AS norm, type, label, sum(doc_cofreq) AS cofreq, max(pmi) AS pmi FROM edges GROUP BY 1, 2, 3), pr AS (SELECT label, 0.5 * ln(1 + sum(doc_cofreq)) AS base FROM edges GROUP BY 1),
h AS (SELECT sentence_id, label, sum(greatest(pmi, 0) * ln(1 + cofreq) * similarity) AS hit FROM found q JOIN sc ON q.norm = sc.norm AND q.type = sc.type GROUP BY 1, 2),
s AS (SELECT i.sentence_id, pr.label, coalesce(hit, 0) + base AS score FROM (SELECT DISTINCT sentence_id FROM ask) i CROSS JOIN pr LEFT JOIN h ON h.sentence_id = i.sentence_id AND h.label = pr.label),
m AS (SELECT *, exp(score - max(score) OVER (PARTITION BY sentence_id)) AS e FROM s)
SELECT sentence_id, label, round(score, 6) AS score, round(e / sum(e) OVER (PARTITION BY sentence_id), 6) AS probability FROM m""")  # fmt: skip
def sentence_scores(spark, d):
    rows = _phrases(spark, d)
    edges = P.association(rows)
    keys, scores = P.build_index(P.phrase_pool(rows, edges), edges)
    asked = _asked(spark, d)
    return rounded(P.sentence_scores(asked, P.candidates(asked, keys), scores, P.label_prior(edges)))
