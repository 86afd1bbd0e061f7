"""Applying changes: additive merges, first-wins mappings, quarantine, upserts, fingerprints and skipping."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.windows import first_per_key
from weftgraph.storage import dealt, exists, stored


def added(current: DataFrame, proposed: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """current with the first proposal of each new key; rows that exist stay as they are."""
    new = first_per_key(proposed, key, order).join(current.select(*key), list(key), "left_anti")
    return current.unionByName(new.select(*current.columns))


def property_mappings(current: DataFrame, proposed: DataFrame, declared: DataFrame, codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mappings, quarantine): proposals (code, target, ord) with a declared target, a real code and a free place; the first one wins.

    quarantine: (code, target, reason).
    """
    clean = proposed.withColumn("code", F.lower(F.trim("code")))
    real = codes.select(F.lower(F.trim("code")).alias("code")).distinct().withColumn("_real", F.lit(True))
    known = declared.select("target").distinct().withColumn("_known", F.lit(True))
    taken = current.select(F.lower(F.trim("code")).alias("code"), F.col("target").alias("_taken")).dropDuplicates(["code"])
    joined = clean.join(real, "code", "left").join(known, "target", "left").join(taken, "code", "left")
    reason = F.when(F.col("_known").isNull(), "undeclared target").when(F.col("_real").isNull(), "unknown code").when(F.col("_taken").isNotNull() & (F.col("_taken") != F.col("target")), "occupied").when(F.col("_taken").isNotNull(), "present")
    joined = joined.withColumn("reason", reason)
    ranked = joined.withColumn("_nth", F.row_number().over(Window.partitionBy("code", F.col("reason").isNull()).orderBy("ord")))
    won = ranked.where("reason is null and _nth = 1").select("code", "target")
    lost = ranked.where("(reason is not null and reason <> 'present') or (reason is null and _nth > 1)").select("code", "target", F.coalesce("reason", F.lit("later proposal")).alias("reason"))
    return current.select("code", "target").unionByName(won), lost


def by_content(current: DataFrame, incoming: DataFrame, key: str, content: str) -> DataFrame:
    """incoming with state: new, same (identical content, to be skipped) or conflict (other content, to be quarantined); never an overwrite."""
    have = current.select(key, F.sha2(F.col(content), 256).alias("_have")).dropDuplicates([key])
    digest = F.sha2(F.col(content), 256)
    state = F.when(F.col("_have").isNull(), "new").when(F.col("_have") == digest, "same").otherwise("conflict")
    return incoming.join(have, key, "left").withColumn("state", state).drop("_have")


def upserted(current: DataFrame, incoming: DataFrame, owner: str, digest: str) -> DataFrame:
    """current with incoming rows whose (owner, digest) it lacks, each once."""
    return added(current, incoming, [owner, digest], [digest])


def split_rejected(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason)."""
    marked = rows.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def classified(changes: DataFrame, least: str = "medium") -> DataFrame:
    """changes (kind, provenance struct, verdict) with gate: auto or the reason for review.

    Only additions of enough confidence, with provenance, that a verdict does not hold back, apply by themselves.
    """
    rank = {"low": 0, "medium": 1, "high": 2}
    p = F.col("provenance")
    level = F.create_map(*[x for k, v in rank.items() for x in (F.lit(k), F.lit(v))])[p["confidence"]]
    gate = (
        F.when(F.col("kind") != "addition", "only additions apply by themselves")
        .when(p.isNull() | p["source_type"].isNull(), "no provenance")
        .when(F.coalesce(level, F.lit(-1)) < rank[least], "confidence")
        .when((p["source_type"] == "web") & (F.coalesce(p["ref"], F.lit("")) == ""), "web source without reference")
        .when(F.col("verdict").isNull() | (F.col("verdict") != "pass"), "verdict")
        .otherwise("auto")
    )
    return changes.withColumn("gate", gate)


def defaults(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Columns filled where they are null."""
    return rows.withColumns({name: F.coalesce(F.col(name), value) for name, value in values.items()})


def split_provenance(triples: DataFrame, provenance_types: Sequence[str], type_p: str) -> tuple[DataFrame, DataFrame]:
    """(instances, provenance): a triple belongs to provenance if its subject has a provenance type."""
    # triples of many subjects are few bytes, and sorted in memory
    triples = dealt(triples, "s", each=200_000)
    nodes = triples.where((F.col("p") == type_p) & F.col("o").isin(*provenance_types)).select("s").distinct()
    return triples.join(nodes, "s", "left_anti"), triples.join(nodes, "s", "left_semi")


def fingerprint(rows: DataFrame) -> str:
    """A digest of a table that does not depend on the order of its rows; repeated rows count."""
    hashed = rows.select(F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256).alias("h"))
    # sums of 32-bit parts of the row digests, exact whatever the order
    parts = [F.sum(F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"p{k}") for k in range(8)]
    row = hashed.agg(F.count("*").cast("string").alias("n"), *parts).first()
    return hashlib.sha256("|".join(str(v) for v in row).encode()).hexdigest()


def run_if_changed(state: dict[str, str], name: str, inputs: Sequence[DataFrame], stage: Callable[[], object], always: bool = False) -> tuple[dict[str, str], bool]:
    """Runs a stage unless its inputs have the fingerprint of its last good run; a stage that raises leaves the state as it was."""
    key = "|".join(fingerprint(df) for df in inputs)
    if not always and state.get(name) == key:
        return state, False
    stage()
    return state | {name: key}, True


#: Goes into every key of a memo; another one makes all that is kept stale.
MEMO_VERSION = "1"


def memo_keys(inputs: DataFrame, gate: str, parts: str = "input", version: str = MEMO_VERSION) -> DataFrame:
    """(gate, key): for each gate the digest of all its inputs, whatever their order; repeated rows count.

    inputs: a column `gate`, a column `parts` that names the input a row belongs to, and any others.  The key covers the
    version, the names and all columns of the rows, so a verdict can't be taken for other inputs than its own.
    """
    rest = sorted(c for c in inputs.columns if c not in (gate, parts))
    row = F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256)
    hashed = inputs.select(F.col(gate).alias("gate"), F.col(parts).cast("string").alias("part"), row.alias("h"))
    sums = [F.sum(F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"s{k}") for k in range(8)]
    digests = hashed.groupBy("gate", "part").agg(F.count("*").cast("string").alias("n"), *sums)
    one = F.sha2(F.concat_ws("|", F.coalesce("part", F.lit("\x00")), "n", *[f"s{k}" for k in range(8)]), 256)
    return digests.groupBy("gate").agg(F.array_sort(F.collect_list(one)).alias("all")).select("gate", F.sha2(F.concat_ws("|", F.lit(version), "all"), 256).alias("key"))


def remembered(keys: DataFrame, path: str) -> DataFrame:
    """keys with `hit`: whether the memo at path has the key as passed.  Without a memo nothing is a hit."""
    if not exists(keys.sparkSession, path):
        return keys.withColumn("hit", F.lit(False))
    known = keys.sparkSession.read.parquet(path).select("gate", "key").distinct().withColumn("_hit", F.lit(True))
    return keys.join(known, ["gate", "key"], "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def checked(inputs: DataFrame, gate: str, check: Callable[[DataFrame], DataFrame], path: str, parts: str = "input", version: str = MEMO_VERSION) -> DataFrame:
    """(gate, status, hit): `pass` or `fail` of every gate of inputs; only gates whose inputs have changed are checked.

    check takes the inputs of the gates to be checked and gives the gates (column gate) that fail.  Passes are put into
    the memo at path if they are not in it, each with its key; fails never are, so they are checked again every time.
    The memo is a folder of Parquet files that later drivers read; a check that raises leaves it as it was.  Null gates
    are left out.
    """
    inputs = inputs.where(F.col(gate).isNotNull())
    keys = stored(remembered(memo_keys(inputs, gate, parts, version), path), "keys")
    due = keys.where("not hit").select(F.col("gate").alias(gate))
    failed = check(inputs.join(due, gate, "left_semi")).select(F.col(gate).alias("gate")).distinct().withColumn("_failed", F.lit(True))
    verdicts = stored(keys.join(failed, "gate", "left").select("gate", "key", "hit", F.when(F.col("_failed") & ~F.col("hit"), "fail").otherwise("pass").alias("status")), "verdicts")
    new = verdicts.where("not hit and status = 'pass'").select("gate", "key")
    if not new.isEmpty():
        new.coalesce(1 + new.count() // 1_000_000).write.mode("append").parquet(path)
    return verdicts.select("gate", "status", "hit")


def bisected(items: Sequence[str], passes: Callable[[Sequence[str]], bool], budget: int = 32) -> tuple[list[str], list[str], int]:
    """(accepted, rejected, checks): groups that pass are taken whole, others are halved; beyond the budget the unproven are rejected."""
    accepted, rejected, used, queue = [], [], 0, [list(items)] if items else []
    while queue:
        group = queue.pop(0)
        if used >= budget:
            rejected += group
            continue
        used += 1
        if passes([*accepted, *group]):
            accepted += group
        elif len(group) == 1:
            rejected += group
        else:
            half = len(group) // 2
            queue = [group[:half], group[half:], *queue]
    return accepted, rejected, used


def batch_status(items: DataFrame, done: DataFrame, failed: DataFrame, key: str = "id") -> DataFrame:
    """(id, status): skipped if done before, failed with its reason, else ok."""
    a, b = done.select(key).distinct().withColumn("_done", F.lit(True)), failed.select(key, "reason").dropDuplicates([key])
    status = F.when(F.col("_done"), "skipped").when(F.col("reason").isNotNull(), "failed").otherwise("ok")
    return items.select(key).distinct().join(a, key, "left").join(b, key, "left").select(key, status.alias("status"), "reason")


def purged(parents: DataFrame, children: DataFrame, key: str, active: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(parents, children) without finished parents and what belongs to them; active statuses stay."""
    kept = parents.where(F.col("status").isin(*active))
    return kept, children.join(kept.select(key), key, "left_semi")
