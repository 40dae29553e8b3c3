"""Queries: clauses and phrases by a parse.

No parser is installed, so these stand-in taggers know a word's kind by its
length; a real one plugs in the same way (``segment.Tagger``, ``ParsedToken``).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

from spanloom.functions import segment
from spanloom.plans.registry import query, table

_TOKEN = r"[A-Za-z']+|[^A-Za-z'\x20\x09-\x0D]"


def length_tagger(text: str) -> list[segment.Token]:
    """Words of 5, 10, ... characters are verbs, of 7, 14, ... open an adverbial clause, coordinators are known."""
    kind = lambda w: "CCONJ" if w.lower() in segment.COORDINATORS else "VERB" if len(w) % 5 == 0 else ""
    return [segment.Token(m[0], m.start(), m.end(), kind(m[0]), "advcl" if len(m[0]) % 7 == 0 else "") for m in re.finditer(_TOKEN, text)]


def length_parse(text: str) -> list[segment.ParsedToken]:
    """Verbs by length, words of two letters prepositions, of three determiners, all others nouns: subjects of the next verb or objects of the last."""
    spans = [(m.start(), m.end()) for m in re.finditer(_TOKEN, text)]
    words = [text[a:b] for a, b in spans]
    pos = ["VERB" if len(w) % 5 == 0 else "ADP" if len(w) == 2 else "DET" if len(w) == 3 else "NOUN" if w[0].isalpha() else "PUNCT" for w in words]
    verbs = [i for i, p in enumerate(pos) if p == "VERB"]
    root = verbs[0] if verbs else 0
    out = []
    for i, (w, p) in enumerate(zip(words, pos)):
        last = next((v for v in reversed(verbs) if v < i), root)
        after = next((v for v in verbs if v > i), None)
        if i == root:
            dep, head = "ROOT", i
        elif p == "VERB":
            dep, head = "conj", root
        elif p == "ADP":
            dep, head = "prep", last
        elif p == "DET" and i + 1 < len(words):
            dep, head = "det", i + 1
        elif p == "NOUN" and i and pos[i - 1] == "ADP":
            dep, head = "pobj", i - 1
        elif p == "NOUN":
            dep, head = ("nsubj", after) if after is not None and (i == 0 or pos[i - 1] != "VERB") else ("obj", last)
        else:
            dep, head = "punct", root
        out.append(segment.ParsedToken(w, *spans[i], pos=p, dep=dep, head_pos=pos[head], i=i, head=head, lemma=w.lower()))
    return out


def _texts(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))


def _list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in sorted(words)) + ")"


_BEGINS = f"(lower(x) IN {_list(segment.CONNECTIVES | segment.COORDINATORS)} OR length(x) % 7 = 0)"
_VERB = "coalesce(list_bool_or(list_transform(t[{a}:{b}], lambda w: length(w) % 5 = 0 AND lower(w) NOT IN " + _list(segment.COORDINATORS) + ")), false)"


@query("clause_cuts", f"""WITH w AS (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '{_TOKEN.replace("'", "''")}') AS t FROM conversations),
    c AS (SELECT conv_id, turn, t, unnest(range(1, len(t))) AS i FROM w), x AS (SELECT *, t[i + 1] AS x, t[i] AS p FROM c)
    SELECT conv_id, turn, CAST(i AS INTEGER) AS cut FROM x
    WHERE {_BEGINS} OR (i >= 2 AND p IN (',', ';', ':') AND {_VERB.format(a="greatest(i - 8, 1)", b="i - 1")} AND {_VERB.format(a="i + 1", b="i + 8")})""")
def clause_cuts(spark, d):
    """Tokens before which a clause may begin, by relations, connectives and pauses between verbs."""

    @F.pandas_udf("array<int>")
    def cuts(text: pd.Series) -> pd.Series:
        return pd.Series([segment.cut_places(length_tagger(t)) for t in text])

    return _texts(spark, d).select("conv_id", "turn", F.explode(cuts("text")).alias("cut"))


@query("flat_clauses", """WITH p AS (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[^,;]*[,;]|[^,;]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM conversations)
    SELECT conv_id, turn, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS clause FROM p""")
def flat_clauses(spark, d):
    """The older rule, without a parse: a piece ends with a comma or a semicolon."""

    @F.pandas_udf("array<string>")
    def flat(text: pd.Series) -> pd.Series:
        return pd.Series([segment.flat_clauses(t) for t in text])

    return _texts(spark, d).select("conv_id", "turn", F.posexplode(flat("text")).alias("pos", "clause"))


@query("clause_phrases")
def clause_phrases(spark, d):
    """Clauses of parsed turns with their typed phrases, as ranges of tokens."""

    @F.pandas_udf("array<struct<clause_no:int,clause_start:int,clause_end:int,type:string,start:int,`end`:int>>")
    def phrases(text: pd.Series) -> pd.Series:
        out = []
        for t in text:
            tokens = length_parse(t)
            ranges = segment.clause_ranges(tokens) if tokens else []
            out.append([{"clause_no": k, "clause_start": a, "clause_end": b, "type": kind, "start": s, "end": e} for k, (a, b) in enumerate(ranges) for s, e, kind in segment.phrase_ranges(tokens, a, b)])
        return pd.Series(out)

    return _texts(spark, d).select("conv_id", "turn", F.explode(phrases("text")).alias("p")).select("conv_id", "turn", "p.*")
