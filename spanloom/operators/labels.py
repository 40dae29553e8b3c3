"""Label selection, mapping and filters over annotation arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A dimension is broadcast while it has no more rows than this; beyond, the join shuffles.
BROADCAST_ROWS = 100_000


def small(dim: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``dim`` with a broadcast hint if it is counted to be small, else as it is."""
    return F.broadcast(dim) if dim.limit(rows + 1).count() <= rows else dim


def positional_label(codes: Column, level: str) -> Column:
    """Label of a code list: first for ``code``, second for ``subcode``, both (or the first) for ``combined``."""
    first, second = F.get(codes, 0), F.get(codes, 1)
    if level == "code":
        return first
    if level == "subcode":
        return second
    return F.when(second.isNotNull(), F.concat(first, F.lit(" → "), second)).otherwise(first)


def combined_label(code: Column, subcode: Column, require_both: bool = False) -> Column:
    """``code||subcode`` with ``∅`` for a missing half; null if both are missing or, if asked, either."""
    none = (code.isNull() | subcode.isNull()) if require_both else (code.isNull() & subcode.isNull())
    return F.when(~none, F.concat(F.coalesce(code, F.lit("∅")), F.lit("||"), F.coalesce(subcode, F.lit("∅"))))


def counting_label(code: Column, subcode: Column) -> Column:
    """``code_subcode``, or the one that is there."""
    return F.when(code.isNotNull() & subcode.isNotNull(), F.concat(code, F.lit("_"), subcode)).otherwise(F.coalesce(code, subcode))


def split_label(code: Column, subcode: Column, allowed: Sequence[str]) -> Column:
    """Pair if the subcode is allowed, the code alone if it is allowed and there is no subcode."""
    ok_code, ok_sub = F.coalesce(code.isin(*allowed), F.lit(False)), F.coalesce(subcode.isin(*allowed), F.lit(False))
    return F.when(ok_sub & code.isNotNull(), F.concat(code, F.lit("_"), subcode)).when(ok_sub, subcode).when(ok_code & subcode.isNull(), code)


def flat_label(code: Column, subcode: Column, allowed: Sequence[str]) -> Column:
    """The subcode if allowed, else the code if allowed; never both."""
    return F.coalesce(F.when(subcode.isin(*allowed), subcode), F.when(code.isin(*allowed), code))


def robust_lookup(raw: Column, mapping: dict[str, str]) -> Column:
    """Exact, then lower-case, then upper-case key."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(table[raw], table[F.lower(raw)], table[F.upper(raw)])


def mapped_labels(units: DataFrame, mapping: DataFrame, id_col: str = "id", codes_col: str = "codes") -> DataFrame:
    """id, code, subcode: the first label of each level among a unit's mapped codes; null if none maps."""
    tokens = units.select(id_col, F.posexplode_outer(codes_col).alias("pos", "raw"))
    dim = small(mapping.select(F.col("raw"), "matched_codebook_label", "level"))
    joined = tokens.join(dim, "raw", "left")
    pick = lambda level: F.min_by(F.when(F.col("level") == level, F.col("matched_codebook_label")), F.when(F.col("level") == level, F.col("pos")))
    return joined.groupBy(id_col).agg(pick("code").alias("code"), pick("subcode").alias("subcode"))


def map_labels(rows: DataFrame, mapping: DataFrame, label_col: str, miss: str = "keep") -> DataFrame:
    """``rows`` with ``mapped``: the codebook label; on a miss the raw one (keep), ``[UNKNOWN:x]`` (mark), or no row (drop).

    With drop, keys are compared in lower case.
    """
    dim = mapping.select(F.col("raw").alias("__raw"), F.col("matched_codebook_label").alias("mapped"))
    key = F.col(label_col)
    if miss == "drop":
        dim = dim.select(F.lower("__raw").alias("__raw"), "mapped").dropDuplicates(["__raw"])
        return rows.join(small(dim), F.lower(key) == F.col("__raw")).drop("__raw")
    out = rows.join(small(dim), key == F.col("__raw"), "left").drop("__raw")
    other = key if miss == "keep" else F.concat(F.lit("[UNKNOWN:"), key, F.lit("]"))
    return out.withColumn("mapped", F.coalesce("mapped", other))


def intent_types(rows: DataFrame, types: DataFrame, id_col: str, labels_col: str) -> DataFrame:
    """id and the sorted distinct intent types of its labels."""
    exploded = rows.select(id_col, F.explode_outer(labels_col).alias("label"))
    out = exploded.join(small(types.select("label", "intent_type").distinct()), "label", "left")
    return out.groupBy(id_col).agg(F.array_sort(F.collect_set("intent_type")).alias("label_type"))


def drop_removed(units: DataFrame, labels_col: str, removed: DataFrame, id_col: str = "id") -> DataFrame:
    """Units without any label in ``removed``; one such label drops the whole unit."""
    hit = units.select(id_col, F.explode(labels_col).alias("label")).join(small(removed.select("label").distinct()), "label", "left_semi")
    return units.join(hit.select(id_col).distinct(), id_col, "left_anti")


def only_allowed(rows: DataFrame, label_col: str, allowed: DataFrame) -> DataFrame:
    keys = allowed.select(F.col(allowed.columns[0]).alias("__key")).distinct()
    return rows.join(small(keys), F.col(label_col) == F.col("__key"), "left_semi")


def split_by_level(units: DataFrame, levels: Sequence[str] = ("code", "subcode", "subsubcode")) -> DataFrame:
    """id, level and the labels of that level, for units with (label, level) structs in ``labels``."""
    flat = units.select("id", F.posexplode("labels").alias("pos", "l")).where(F.col("l.level").isin(*levels))
    return flat.groupBy("id", F.col("l.level").alias("level")).agg(F.array_sort(F.collect_list(F.struct("pos", "l.label"))).alias("x")).select("id", "level", F.col("x.label").alias("labels"))


def split_by_type(messages: DataFrame, type_of: dict[str, str], kinds: Sequence[str]) -> DataFrame:
    """One row per message and kind, with annotations cut to the codes of that kind; messages without any are left out."""
    table = F.create_map(*[F.lit(x) for pair in type_of.items() for x in pair])
    sides = []
    for kind in kinds:
        cut = _cut_codes(table, kind)
        sides.append(messages.withColumn("annotations", F.filter(cut, lambda a: F.size(a["code"]) > 0)).where(F.size("annotations") > 0).withColumn("intent_type", F.lit(kind)))
    out = sides[0]
    for s in sides[1:]:
        out = out.unionByName(s)
    return out


def _cut_codes(table: Column, kind: str) -> Column:
    keep = lambda c: F.coalesce(table[c] == kind, F.lit(False))
    return F.transform("annotations", lambda a: F.struct(a["text_id"].alias("text_id"), a["text"].alias("text"), F.filter(a["code"], keep).alias("code"), F.array(F.lit(kind)).alias("label_type")))


def split_by_flag(messages: DataFrame, flag) -> DataFrame:
    """Messages with the annotations for which ``flag`` of the text holds, and with the others; ``is_cross`` tells which."""
    yes = messages.withColumn("annotations", F.filter("annotations", lambda a: flag(a["text"]))).withColumn("is_cross", F.lit(True))
    no = messages.withColumn("annotations", F.filter("annotations", lambda a: ~flag(a["text"]))).withColumn("is_cross", F.lit(False))
    return yes.unionByName(no).where(F.size("annotations") > 0)


def drop_rare(rows: DataFrame, label_col: str, above: int = 1) -> DataFrame:
    """Rows whose label occurs more than ``above`` times; counts meet rows in a join, so that no label is gathered in one task."""
    counts = rows.groupBy(F.col(label_col).alias("__label")).agg(F.count("*").alias("__n")).where(F.col("__n") > above)
    return rows.join(counts.select("__label"), F.col(label_col) == F.col("__label"), "left_semi")


def alias_hits(raws: DataFrame, rules: DataFrame, raw_col: str = "raw") -> DataFrame:
    """(target, raw): distinct raw labels that a target's rules match, exactly or as a regex, whatever the case.

    Rules are configuration: few, and compared with distinct labels only.
    """
    distinct = raws.select(F.col(raw_col).alias("raw")).where("raw IS NOT NULL").distinct()
    exact = rules.where("kind = 'exact'").select("target", F.lower("pattern").alias("key"))
    hits = distinct.join(small(exact), F.lower("raw") == F.col("key")).select("target", "raw")
    patterns = rules.where("kind = 'regex'").limit(BROADCAST_ROWS + 1).collect()
    if len(patterns) > BROADCAST_ROWS:
        raise ValueError(f"more than {BROADCAST_ROWS} regex rules")
    if patterns:
        tests = F.array(*[F.when(F.rlike("raw", F.lit("(?i)" + r["pattern"])), F.lit(r["target"])) for r in patterns])
        hits = hits.unionByName(distinct.select(F.explode(F.array_compact(tests)).alias("target"), "raw"))
    return hits.distinct()


def strip_columns(df: DataFrame, renames: dict[str, str] | None = None) -> DataFrame:
    """Column names in lower case with underscores, then renamed."""
    names = ["_".join(c.strip().lower().replace("-", " ").split()) for c in df.columns]
    return df.toDF(*[(renames or {}).get(n, n) for n in names])


def find_column(df: DataFrame, candidates: Sequence[str]) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


def missing_columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    return [c for c in wanted if c not in df.columns]


def one_hot(rows: DataFrame, labels_col: str, labels: Sequence[str]) -> DataFrame:
    return rows.select("*", *[F.array_contains(labels_col, label).cast("int").alias(label) for label in labels])
