"""Folds that turn append-only arrivals into current rows.

Every fold is one aggregation by key over an arrival number ``seq``; replaying or splitting the
arrivals into batches in any way gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _last(c: str, seq: Column) -> Column:
    return F.max_by(c, seq)


def _last_filled(c: str, seq: Column) -> Column:
    return F.max_by(c, F.when(F.col(c).isNotNull(), seq))


def latest_wins(arrivals: DataFrame, keys: list[str], seq: str, first_only: tuple[str, ...] = ()) -> DataFrame:
    """The last row of each key; columns ``first_only`` keep their first value."""
    s, rest = F.col(seq), [c for c in arrivals.columns if c not in keys]
    picked = (F.min_by(c, s).alias(c) if c in first_only else _last(c, s).alias(c) for c in rest)
    return arrivals.groupBy(*keys).agg(*picked)


def precedence_merge(arrivals: DataFrame, keys: list[str], seq: str, source: str, authority: str, filled: list[str], plain: list[str]) -> DataFrame:
    """Arrivals from ``authority`` can't be overruled by others once one has come.

    Of what is accepted, columns ``filled`` keep the last value that isn't null, columns
    ``plain`` the last value.
    """
    first = F.min(F.when(F.col(source) == authority, F.col(seq))).over(Window.partitionBy(*keys))
    accepted = arrivals.withColumn("_first", first).where(F.col("_first").isNull() | (F.col(seq) <= F.col("_first")) | F.col(source).eqNullSafe(authority))
    s = F.col(seq)
    return accepted.groupBy(*keys).agg(*(_last_filled(c, s).alias(c) for c in filled), *(_last(c, s).alias(c) for c in plain))


#: Columns of votes by how they merge.
VOTE_FILLED, VOTE_PLAIN = ["result_text", "ja", "nein", "enthaltung", "members", "file_id"], ["top_label", "source", "image_url", "image_sha"]


def merge_votes(arrivals: DataFrame, seq: str = "seq") -> DataFrame:
    """Votes by meeting and agenda anchor; without an anchor they are ignored, empty members are null."""
    a = arrivals.where(F.coalesce("agenda_anchor", F.lit("")) != "").withColumn("members", F.when(F.size("members") > 0, F.col("members")))
    out = precedence_merge(a, ["meeting_id", "agenda_anchor"], seq, "source", "pdf", VOTE_FILLED, VOTE_PLAIN)
    return out.withColumn("id", F.concat_ws(":", "meeting_id", "agenda_anchor"))


def snapshot_replace(old: DataFrame, new: DataFrame, group: list[str]) -> DataFrame:
    """Groups that the new snapshot names are replaced whole; a group it doesn't name stays."""
    return old.join(new.select(*group).distinct(), group, "left_anti").unionByName(new)


def source_priority(arrivals: DataFrame, keys: list[str], seq: str, source: str, names_from: str, name: str, seen: str) -> DataFrame:
    """``name`` from the last arrival of one source, else the first one of any; ``seen`` first and last of all."""
    s = F.col(seq)
    own = F.max_by(name, F.when(F.col(source) == names_from, s))
    return arrivals.groupBy(*keys).agg(F.coalesce(own, F.min_by(name, s)).alias(name), F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"))


def classify_changes(new: DataFrame, prior: DataFrame, keys: list[str], size: str, modified: str, sha: str, readable: Column | None = None) -> DataFrame:
    """``change`` of each incoming file: new, unchanged, touched (other metadata, same content), refused or changed.

    Size and modification time decide first; where both are equal, the content isn't looked at.
    Content that isn't ``readable`` (a page in place of a PDF) is refused, whether there was a file before or not.
    """
    p = prior.select(*keys, F.col(size).alias("_size"), F.col(modified).alias("_modified"), F.col(sha).alias("_sha"), F.lit(True).alias("_known"))
    same_meta = F.col("_known").isNotNull() & F.col(size).eqNullSafe(F.col("_size")) & F.col(modified).eqNullSafe(F.col("_modified"))
    refused = F.lit(False) if readable is None else ~F.coalesce(readable, F.lit(False))
    change = F.when(same_meta, "unchanged").when(refused, "refused").when(F.col("_known").isNull(), "new").when(F.col(sha).eqNullSafe(F.col("_sha")), "touched").otherwise("changed")
    return new.join(p, keys, "left").withColumn("change", change).drop("_size", "_modified", "_sha", "_known")


#: Columns of files by where they come from: where a file hangs, and what belongs to its content.
ASSOCIATION = ["meeting_id", "agenda_anchor", "label", "doc_type"]
CONTENT = ["url", "filename", "sha256", "size", "remote_modified", "local_path", "text_status", "submitters", "downloaded_at"]


def apply_changes(prior: DataFrame, classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, superseded versions) after files classified by ``classify_changes`` came in.

    An unchanged file gets its association only, a touched one its modification time as well; new and
    changed ones take all their columns and wait for enrichment anew, unless that was skipped on purpose; refused ones leave everything as it was.
    """
    new = classified.where("change <> 'refused'").select("id", "change", *(F.col(c).alias(f"n_{c}") for c in ASSOCIATION + CONTENT))
    j = prior.withColumn("_was", F.lit(True)).join(new, "id", "full")
    fresh, seen = F.col("change").isin("new", "changed"), F.col("change").isNotNull()
    out = {c: F.when(seen, F.col(f"n_{c}")).otherwise(F.col(c)) for c in ASSOCIATION}
    out |= {c: F.when(fresh, F.col(f"n_{c}")).otherwise(F.col(c)) for c in CONTENT}
    out["remote_modified"] = F.when(fresh | (F.col("change") == "touched"), F.col("n_remote_modified")).otherwise(F.col("remote_modified"))
    out["enrich_status"] = F.when(fresh, carried_status(F.col("enrich_status"))).otherwise(F.col("enrich_status"))
    files = j.select(*(out.get(c, F.col(c)).alias(c) for c in prior.columns))
    old = j.where(F.col("_was") & (F.col("change") == "changed") & F.col("sha256").isNotNull())
    return files, old.select(F.col("id").alias("file_id"), "sha256", "size", "remote_modified", "local_path", "downloaded_at")


def carried_status(before: Column) -> Column:
    """Enrichment of content that came anew: what was skipped on purpose stays skipped, anything else waits."""
    return F.when(before == "skipped", "skipped").otherwise("pending")


def seed_actions(found: DataFrame, prior: DataFrame, keys: list[str], status: str = "text_status") -> DataFrame:
    """``action`` for each file of a dump: ``refresh`` where its text is there already, ``retry`` where it isn't, else ``insert``."""
    p = prior.select(*keys, F.col(status).alias("_status"), F.lit(True).alias("_known"))
    action = F.when(F.col("_status") == "ok", "refresh").when(F.col("_known"), "retry").otherwise("insert")
    return found.join(p, keys, "left").withColumn("action", action).drop("_status", "_known")


def seed_files(prior: DataFrame, dump: DataFrame) -> DataFrame:
    """Files after a dump's rows (association, ``url, filename, text_status, submitters``) were taken in.

    Downloaded texts aren't overruled: such files get their association only.  Files that are inserted count as skipped for enrichment.
    """
    own = ["url", "filename", "text_status", "submitters"]
    new = seed_actions(dump, prior, ["id"]).select("id", "action", *(F.col(c).alias(f"n_{c}") for c in ASSOCIATION + own))
    j = prior.join(new, "id", "full")
    out = {c: F.when(F.col("action").isNotNull(), F.col(f"n_{c}")).otherwise(F.col(c)) for c in ASSOCIATION}
    out |= {c: F.when(F.col("action").isin("retry", "insert"), F.col(f"n_{c}")).otherwise(F.col(c)) for c in own}
    out["enrich_status"] = F.when(F.col("action") == "insert", "skipped").otherwise(F.col("enrich_status"))
    return j.select(*(out.get(c, F.col(c)).alias(c) for c in prior.columns))


def version_history(arrivals: DataFrame, keys: list[str], seq: str, sha: str) -> DataFrame:
    """A row for each distinct content of a key that a later one superseded, with when that was.

    Equal neighbours are no new version; a content that returns is kept once, when first superseded.
    """
    w = Window.partitionBy(*keys).orderBy(seq)
    a = arrivals.withColumn("_prev", F.lag(sha).over(w)).where(F.col("_prev").isNull() | (F.col("_prev") != F.col(sha)))
    a = a.withColumn("superseded_at", F.lead(seq).over(w)).where("superseded_at is not null").drop("_prev")
    rest = [c for c in a.columns if c not in (*keys, sha)]
    return a.groupBy(*keys, sha).agg(*(F.min_by(c, F.col(seq)).alias(c) for c in rest))


def retry_budget(attempts: DataFrame, keys: list[str], seq: str, success: str, most: int = 3) -> DataFrame:
    """Failures since the last success of each key, if any; ``exhausted`` from ``most`` on."""
    last = F.max(F.when(F.col(success), F.col(seq))).over(Window.partitionBy(*keys))
    failed = attempts.withColumn("_last", last).where(~F.col(success) & (F.col("_last").isNull() | (F.col(seq) > F.col("_last"))))
    return failed.groupBy(*keys).agg(F.count("*").cast("int").alias("attempts"), F.max(seq).alias("last_attempt")).withColumn("exhausted", F.col("attempts") >= most)


def override_own(rows: DataFrame, override: DataFrame, key: str, value: str) -> DataFrame:
    """``own`` flags with an authoritative value for some keys: that one is own, others of the key aren't; it is added if absent."""
    o = override.select(key, F.col(value).alias("_own"))
    kept = rows.join(o, key, "left").select(key, value, F.when(F.col("_own").isNotNull(), F.col(value) == F.col("_own")).otherwise(F.col("own")).alias("own"))
    return kept.union(o.select(key, F.col("_own").alias(value), F.lit(True).alias("own"))).groupBy(key, value).agg(F.max("own").alias("own"))


def replace_per_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys in ``new`` are replaced; a key whose new rows are all null loses its rows."""
    value = [c for c in new.columns if c != key]
    return snapshot_replace(old, new, [key]).where(F.coalesce(*(F.col(c).cast("string") for c in value)).isNotNull())
