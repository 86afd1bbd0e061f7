"""Counts, splits, coverage and cascades; labels for missing values are given by the caller and set at the end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import percentage, ratio
from weftgraph.operators.windows import first_values
from weftgraph.storage import stored


def counts_by(rows: DataFrame, *keys: str, missing: str | None = None, name: str = "n") -> DataFrame:
    """Rows for each combination of keys; a null key shows as `missing` if that is given."""
    columns = [F.coalesce(F.col(k).cast("string"), F.lit(missing)).alias(k) if missing is not None else F.col(k) for k in keys]
    return rows.groupBy(*columns).agg(F.count("*").alias(name))


def index_statistics(records: DataFrame, keys: Sequence[str] = ("type", "domain", "confidence"), missing: str = "None") -> DataFrame:
    """(key, value, n) for each key by itself, in one pass over the records."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(F.col(k).cast("string"), F.lit(missing)).alias("value")) for k in keys])
    return records.select(F.explode(pairs).alias("p")).groupBy("p.key", "p.value").agg(F.count("*").alias("n"))


def graph_statistics(edges: DataFrame) -> DataFrame:
    """One row: nodes on edges, edges, explicit and derived ones."""
    nodes = edges.select("src").union(edges.select("dst")).distinct().agg(F.count("*").alias("nodes"))
    totals = edges.agg(F.count("*").alias("edges"), F.count(F.when(~F.col("derived"), 1)).alias("explicit"), F.count(F.when(F.col("derived"), 1)).alias("derived"))
    return nodes.join(totals, F.lit(True))


def split_membership(members: DataFrame, subjects: DataFrame, subject: str = "subject", group: str = "group", unmapped: str = "unmapped") -> DataFrame:
    """(group, n): distinct subjects of each group, a subject counted in each it belongs to, and those in none as `unmapped`."""
    inside = members.where(F.col(group).isNotNull()).select(subject, group).distinct()
    inside = inside.join(subjects.select(subject).distinct(), subject, "left_semi")
    none = subjects.select(subject).distinct().join(inside.select(subject), subject, "left_anti").select(subject, F.lit(unmapped).alias(group))
    return inside.unionByName(none).groupBy(group).agg(F.count("*").alias("n"))


def split_exclusive(members: DataFrame, subject: str = "subject", group: str = "group", missing: str = "unmapped") -> DataFrame:
    """(group, n): each subject counted once, in its smallest group."""
    one = members.groupBy(subject).agg(F.min(group).alias(group))
    return one.groupBy(F.coalesce(group, F.lit(missing)).alias(group)).agg(F.count("*").alias("n"))


def split_sources(sources: DataFrame, operational: Sequence[str]) -> DataFrame:
    """(split, n) of subjects by their source types: operational if any is listed, knowledge if any other, else untagged."""
    kinds = sources.groupBy("subject").agg(F.max(F.col("source_type").isin(*operational)).alias("operational"), F.max(F.col("source_type").isNotNull()).alias("tagged"))
    label = F.when(F.coalesce("operational", F.lit(False)), "operational").when(F.col("tagged"), "knowledge").otherwise("untagged")
    return kinds.groupBy(label.alias("split")).agg(F.count("*").alias("n"))


def cascade(facts: DataFrame, levels: Sequence[str], subject: str, dimension: DataFrame | None = None) -> DataFrame:
    """(level, the levels, n): distinct subjects at each prefix of the hierarchy; members of a dimension without facts get 0.

    Subjects may belong to several members, so a level is counted by itself and is not the sum of the one below.
    """
    parts = []
    for depth in range(1, len(levels) + 1):
        keys = list(levels[:depth])
        counted = facts.groupBy(*keys).agg(F.countDistinct(subject).alias("n"))
        if dimension is not None:
            counted = dimension.select(*keys).distinct().join(counted, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
        rest = [F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in levels[depth:]]
        parts.append(counted.select(F.lit(depth).alias("level"), *keys, *rest, "n"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def headline(triples: DataFrame, subjects: DataFrame, type_p: str, class_types: Sequence[str], object_types: Sequence[str], datatype_types: Sequence[str], axiom_ps: Sequence[str]) -> DataFrame:
    """One row: classes, properties, individuals (of the de-noised subjects), relation assertions, axioms, triples."""
    objects = triples.where((F.col("p") == type_p) & F.col("o").isin(*object_types)).select(F.col("s").alias("p")).distinct().withColumn("_is_object", F.lit(True))
    joined = triples.join(objects, "p", "left")
    typed = F.col("p") == type_p
    counted = joined.agg(
        F.countDistinct(F.when(typed & F.col("o").isin(*class_types), F.col("s"))).alias("classes"),
        F.countDistinct(F.when(typed & F.col("o").isin(*object_types), F.col("s"))).alias("object_properties"),
        F.countDistinct(F.when(typed & F.col("o").isin(*datatype_types), F.col("s"))).alias("datatype_properties"),
        F.count(F.when(F.col("_is_object") & (F.col("s") != F.col("o")), 1)).alias("relations"),
        F.count(F.when(F.col("p").isin(*axiom_ps), 1)).alias("axioms"),
        F.count("*").alias("triples"),
    )
    return counted.join(subjects.agg(F.countDistinct("subject").alias("individuals")), F.lit(True))


def individuals(types: DataFrame, structural: Sequence[str], governance: Sequence[str], domains: DataFrame) -> DataFrame:
    """(subject, type) rows without structural types and without subjects all of whose types are governance types outside every domain.

    types: (subject, type); domains: (type, module), the modules that types belong to.
    """
    rows = types.where(~F.col("type").isin(*structural)).distinct().join(domains.select("type", "module").dropDuplicates(["type"]), "type", "left")
    hit = F.lit(False)
    for word in governance:
        hit = hit | F.lower("type").contains(word.lower())
    verdict = rows.groupBy("subject").agg(F.min(hit).alias("all_governance"), F.max(F.col("module").isNotNull()).alias("any_domain"))
    return rows.join(verdict.where("all_governance and not any_domain"), "subject", "left_anti").select("subject", "type")


def coverage(items: DataFrame, mapped: DataFrame, key: str, group: str | None = None) -> DataFrame:
    """(group, total, mapped, unmapped, pct): distinct keys of items that mapped (same key) has."""
    known = mapped.select(key).distinct().withColumn("_mapped", F.lit(1))
    rows = items.select(key, *([group] if group else [])).distinct().join(known, key, "left")
    grouped = rows.groupBy(group) if group else rows.groupBy()
    out = grouped.agg(F.count("*").alias("total"), F.count("_mapped").alias("mapped"))
    return out.withColumns({"unmapped": F.col("total") - F.col("mapped"), "pct": percentage(F.col("mapped"), F.col("total"))})


def gap(items: DataFrame, mapped: DataFrame, key: str, theme: str, name: str, themes: int = 8, samples: int = 5) -> DataFrame:
    """(theme, unmapped, samples): themes with most unmapped keys, ties by name, and the first names of each."""
    lost = items.dropDuplicates([key]).join(mapped.select(key).distinct(), key, "left_anti")
    picked = lost.groupBy(theme).agg(F.count("*").alias("unmapped")).orderBy(F.desc("unmapped"), theme).limit(themes)
    named = first_values(lost.join(F.broadcast(picked.select(theme)), theme, "left_semi"), [theme], name, samples, "samples")
    none = F.array().cast("array<string>")
    return picked.join(F.broadcast(named), theme, "left").withColumn("samples", F.coalesce("samples", none)).orderBy(F.desc("unmapped"), theme)


def alignment(items: DataFrame, mapped: DataFrame, key: str) -> DataFrame:
    """One row: total, covered, coverage (1 when there is nothing to cover)."""
    rows = items.select(F.lower(F.trim(key)).alias(key)).where(F.col(key) != "").distinct()
    known = mapped.select(F.lower(F.trim(key)).alias(key)).distinct().withColumn("_mapped", F.lit(1))
    out = rows.join(known, key, "left").agg(F.count("*").alias("total"), F.count("_mapped").alias("covered"))
    return out.withColumn("coverage", ratio(F.col("covered"), F.col("total")))


def families(entries: DataFrame, citations: int = 12) -> DataFrame:
    """(family, n, citations, restricted) of (family, citation, classification), most frequent first, ties by name."""
    out = entries.groupBy("family").agg(F.count("*").alias("n"), F.max(F.coalesce(F.col("classification") == "restricted", F.lit(False))).alias("restricted"))
    cited = first_values(entries, ["family"], "citation", citations, "citations")
    out = out.join(cited, "family", "left").withColumn("citations", F.coalesce("citations", F.array().cast("array<string>")))
    return out.select("family", "n", "citations", "restricted").orderBy(F.desc("n"), "family")


def daily_increase(rounds: DataFrame, day: Column, keys: Sequence[str]) -> DataFrame:
    """(day, key, added): what counters (before_k, after_k) gained, falls counted as 0."""
    each = F.array(*[F.struct(F.lit(k).alias("key"), F.greatest(F.lit(0), F.coalesce(F.col(f"after_{k}"), F.lit(0)) - F.coalesce(F.col(f"before_{k}"), F.lit(0))).alias("added")) for k in keys])
    return rounds.select(day.alias("day"), F.explode(each).alias("e")).groupBy("day", "e.key").agg(F.sum("e.added").alias("added"))


def map_delta(before: Column, after: Column) -> Column:
    """Map of after - before over the keys of either, a missing value as 0."""
    keys = F.array_distinct(F.concat(F.map_keys(before), F.map_keys(after)))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.coalesce(F.try_element_at(after, k), F.lit(0)) - F.coalesce(F.try_element_at(before, k), F.lit(0))))


def shortfall(deltas: DataFrame, weights: DataFrame) -> DataFrame:
    """Rows (side, dimension, delta) that gained nothing, looked at only if all sides have a positive weight.

    deltas: (side, dimension, delta); weights: (side, weight).
    """
    balanced = weights.agg(F.min("weight").alias("least")).where("least > 0")
    return deltas.where("delta <= 0").join(balanced, F.lit(True)).select("side", "dimension", "delta")


def integrity(entries: DataFrame, known: DataFrame, generic_share: float = 0.9, generic_least: int = 20) -> DataFrame:
    """One row of (entry, ref) rows: integrity (refs that are known), specificity (entries with a ref that is not generic), touch (known that entries reach).

    A ref that at least `generic_share` of the entries name is generic, once there are `generic_least` entries.
    """
    pairs = entries.select("entry", "ref").distinct()
    total = pairs.select("entry").distinct().agg(F.count("*").alias("entries"))
    used = pairs.where("ref is not null").groupBy("ref").agg(F.count("*").alias("n"))
    flagged = used.join(total, F.lit(True)).withColumn("generic", (F.col("entries") >= generic_least) & (F.col("n") >= generic_share * F.col("entries")))
    flagged = flagged.join(known.select("ref").distinct().withColumn("_known", F.lit(1)), "ref", "left")
    refs = flagged.agg(F.count("*").alias("refs"), F.count("_known").alias("known_refs"))
    special = pairs.join(flagged.where("not generic").select("ref"), "ref", "left_semi").agg(F.countDistinct("entry").alias("special"))
    size = known.select("ref").distinct().agg(F.count("*").alias("known"))
    row = total.join(refs, F.lit(True)).join(special, F.lit(True)).join(size, F.lit(True))
    return row.select(
        ratio(F.col("known_refs"), F.col("refs"), 4, 1.0).alias("integrity"), ratio(F.col("special"), F.col("entries"), 4, 0.0).alias("specificity"), ratio(F.col("known_refs"), F.col("known"), 4, 0.0).alias("touch")
    )


def golden(results: DataFrame) -> DataFrame:
    """(file, total, failed) of (file, expected, verdict)."""
    return results.groupBy("file").agg(F.count("*").alias("total"), F.count(F.when(~F.col("expected").eqNullSafe(F.col("verdict")), 1)).alias("failed"))


def proposals(entities: DataFrame, models: DataFrame, separator: str | None = None) -> DataFrame:
    """(entity_id, affects, models): entities with economic hooks, each with the sorted ids of all models, as an array or joined by `separator`.

    The ids are joined once and not for each entity; entities are dealt anew, as a file of few MB holds very many.
    """
    every = models.agg(F.array_sort(F.collect_set("id")).alias("models"))
    if separator is not None:
        # stored, so that the text is made before and not after the join
        every = stored(every.select(F.array_join("models", separator).alias("models")), "models")
    hooked = entities.where(F.size(F.coalesce(F.col("economic_hooks.affects"), F.array().cast("array<string>"))) > 0).select(F.col("id").alias("entity_id"), F.col("economic_hooks.affects").alias("affects"))
    # one row
    return hooked.repartition(int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), "entity_id").join(F.broadcast(every), F.lit(True))


def approved_sets(models: DataFrame, keys: Sequence[str], *arrays: str) -> DataFrame:
    """The union of each array column for each key."""
    return models.groupBy(*keys).agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(a)))).alias(a) for a in arrays])
