"""Text functions as Column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns and word lists.
WORDS_AND_SIGNS = r"[A-Za-z0-9']+|-{2,}|[^\sA-Za-z0-9']"
WORD_OR_SIGN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
CLAUSE_BREAK = r"(?i)[.!?;:]+|\s*[,-]\s*|\s+\b(?:and|but|or|so|because|while|although|though|however|therefore|moreover|whereas|meanwhile|plus)\b\s+"
DATES = (r"\b\d{1,2}/\d{1,2}/\d{2,4}\b", r"\b\d{4}-\d{2}-\d{2}\b")
TIME = r"\b\d{1,2}:\d{2}(?:\s*[ap]m)?\b"
NUMBER = r"\b\d+(?:\.\d+)?\b"
CUES = {
    "contrast": ["but", "however", "although", "yet", "whereas"],
    "elaboration": ["because", "so", "since", "therefore", "in order to", "as a result"],
}
PHRASE_CUES = (
    ("PP", r"\b(in|on|at|to|for|with|of|by)\b"),
    ("VP_COP", r"\b(is|are|was|were|am|be|been)\b"),
    ("VP", r"\b(ran|run|made|make|see|saw|want|wanted)\b"),
)
MARKDOWN = (
    (r"(?s)```.*?```", ""),
    (r"`([^`]*)`", "$1"),
    (r"(?m)^\s{0,3}#{1,6}\s*", ""),
    (r"!\[([^\]]*)\]\([^)]+\)", "$1"),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"\*\*([^*]+)\*\*", "$1"),
    (r"__([^_]+)__", "$1"),
    (r"\*([^*]+)\*", "$1"),
    (r"_([^_]+)_", "$1"),
    (r"(?m)^\s{0,3}>\s?", ""),
    (r"(?m)^\s*[-*+]\s+", "- "),
    (r"(?m)^\s*\d+\.\s+", "- "),
    (r"(?m)^\s*([-*_]\s*){3,}\s*$", ""),
    (r"[ \t]+\n", "\n"),
)
#: Label names that are known under other spellings; those that name themselves are left out.
LABEL_ALIASES = {
    "partnershippatient": "partenership_form_the_patient_side",
    "partnershipprovider": "partnership_from_the_provider_side",
    "shareddecisionpatient": "shared-decision_making_from_the_patient_side",
    "shareddecisionmakingfromthepatientside": "shared-decision_making_from_the_patient_side",
    "shareddecisionmakingfromtheproviderside": "shared-decision_making_form_the_provider_side",
    "carecoordinationpatient": "care_coordination_patient",
    "carecoordinationprovider": "care_coordination_provider",
    "economicstability": "economic_stability",
    "educationaccessandquality": "education_access_and_quality",
    "healthcareaccessandquality": "health_care_access_and_quality",
    "neighborhoodandbuiltenvironment": "neighborhood_and_built_environment",
    "socialandcommunitycontext": "social_and_community_context",
    "activeparticipation/involvement": "active_participation_/involvement",
    "expressopinions": "express_opinions",
    "statepreferences": "state_preferences",
    "requestsforopinion": "requests_for_opinion",
    "requestsfropinion": "requests_for_opinion",
    "exploreoptions": "explore_options",
    "seekingapproval": "seeking_approval",
    "approvalofdecision": "approval_of_decision",
}


def _find_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def squeeze(text: Column) -> Column:
    """Trimmed, with runs of white space as one blank."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def first_filled(*columns: Column) -> Column:
    """The first value that isn't blank, trimmed; null if all are."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def blank_words(text: Column) -> Column:
    """Distinct lower-case words between blanks."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def model_words(text: Column) -> Column:
    """Lower-case words of two or more word characters, in order."""
    return _find_all(F.lower(text), r"[\p{L}\p{N}_]{2,}")


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays of distinct values; 0 if their union is empty."""
    both, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Distinct runs of n characters of the text with a blank on each side."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    starts = F.when(F.length(padded) >= n, F.sequence(F.lit(1), F.length(padded) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(padded, i, F.lit(n))))


def normalize_phrase(text: Column) -> Column:
    """Lower-case and squeezed, with dates, times and numbers as placeholders, in that order."""
    out = F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")
    for pattern in DATES:
        out = F.regexp_replace(out, pattern, "<date>")
    return F.regexp_replace(F.regexp_replace(out, TIME, "<time>"), NUMBER, "<num>")


def normalize_for_match(text: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(text), r"[^a-z0-9'\s]", " "))


def codebook_id(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"\s+", "_")


def label_norm(text: Column) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_")), F.lit("&"), F.lit("and"))
    return F.lower(F.trim(F.replace(out, F.lit("__"), F.lit("_"))))


def label_alias(text: Column, aliases: dict[str, str] | None = None) -> Column:
    """The label that a normalised name stands for, or that name."""
    aliases = LABEL_ALIASES if aliases is None else aliases
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(table[label_norm(text)], label_norm(text))


def gold_key(text: Column) -> Column:
    return F.lower(F.replace(F.trim(text), F.lit(" "), F.lit("")))


def alias_head(text: Column) -> Column:
    """What stands before the first bracket."""
    return F.trim(F.regexp_extract(text, r"^([^(]*)", 1))


def tokens(text: Column) -> Column:
    """Words with apostrophes, long dashes and single other signs."""
    return _find_all(text, WORDS_AND_SIGNS)


def unicode_tokens(text: Column) -> Column:
    """Runs of word characters of any script, and single other signs."""
    return _find_all(F.trim(text), WORD_OR_SIGN)


def word_count(text: Column) -> Column:
    """Runs of word characters."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+"))


def blank_word_count(text: Column) -> Column:
    """Words between blanks, repeats counted."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def clause_segments(text: Column, least_words: int = 3) -> Column:
    """Number of segments between clause breaks that hold ``least_words`` words or more."""
    parts = F.split(squeeze(F.coalesce(text, F.lit(""))), CLAUSE_BREAK)
    return F.size(F.filter(parts, lambda p: F.size(F.filter(F.split(p, r"\s+"), lambda w: w != "")) >= least_words))


def clause_flags(text: Column, least_words: int = 3, cross: int = 3, long: int = 11) -> Column:
    """Both counts, and whether a span crosses clauses or is long."""
    n, segments = F.size(unicode_tokens(F.coalesce(text, F.lit("")))), clause_segments(text, least_words)
    return F.struct(n.alias("span_len_tokens"), segments.alias("num_clause_segments"), (n >= long).alias("is_long"), (segments >= cross).alias("is_cross"))


def topic_count(text: Column, words: list[str]) -> Column:
    """Whole-word hits of any of a topic's words."""
    import re

    return F.regexp_count(text, F.lit(r"(?i)\b(?:" + "|".join(re.escape(w) for w in words) + r")\b"))


def cue_features(text: Column) -> Column:
    low = F.lower(text)
    return F.struct(
        F.contains(text, F.lit("?")).cast("int").alias("has_question"), F.contains(low, F.lit("please")).cast("int").alias("has_please"),
        F.contains(low, F.lit("thank")).cast("int").alias("has_thanks"), word_count(text).alias("len_words"),
    )


def has_cue(text: Column, kind: str) -> Column:
    """Whether a cue of the kind occurs anywhere, inside words too."""
    low = F.lower(text)
    hits = [F.contains(low, F.lit(c)) for c in CUES[kind]]
    out = hits[0]
    for hit in hits[1:]:
        out = out | hit
    return out


def keyword_hit(text: Column, patterns: list[str]) -> Column:
    """Whether a pattern occurs as text or, where it looks like a regex, matches."""
    low, out = F.lower(text), F.lit(False)
    for p in patterns:
        if p.startswith("^") or p.endswith("$") or "\\" in p or "[" in p and "]" in p:
            out = out | F.rlike(low, F.lit("(?i)" + p))
        out = out | F.contains(low, F.lit(p.lower()))
    return out


def example_hash(anchor_label: Column, anchor: Column, neighbour_label: Column, neighbour: Column) -> Column:
    return F.sha1(F.concat(anchor_label, F.lit("||"), anchor, F.lit(">>"), neighbour_label, F.lit("||"), neighbour).cast("binary"))


def prefixed_label(entry: Column) -> Column:
    """(index, name) of ``1_2: name``; null without a colon."""
    parts = F.split(entry, ":", 2)
    return F.when(F.contains(entry, F.lit(":")), F.struct(F.trim(F.get(parts, 0)).alias("index"), F.trim(F.get(parts, 1)).alias("name")))


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, r'[<>:"/\\|?*]', "_")


def strip_markdown(text: Column) -> Column:
    for pattern, to in MARKDOWN:
        text = F.regexp_replace(text, pattern, to)
    return F.concat(F.trim(F.regexp_replace(text, r"^\s+|\s+$", "")), F.lit("\n"))


def mini_chunks(sentence: Column) -> Column:
    """Pieces between commas, semicolons and "and", typed by the first cue word that they hold."""
    parts = F.filter(F.transform(F.split(sentence, "[,;]| and "), lambda p: F.trim(p)), lambda p: p != "")

    def typed(p: Column) -> Column:
        kind = F.lit("NP")
        for name, pattern in reversed(PHRASE_CUES):
            kind = F.when(F.rlike(p, F.lit(pattern)), F.lit(name)).otherwise(kind)
        return F.struct(p.alias("text"), kind.alias("type"))

    return F.transform(parts, typed)


def stem_without(name: Column, suffixes: list[str]) -> Column:
    return F.regexp_replace(name, "_(" + "|".join(suffixes) + ")$", "")
