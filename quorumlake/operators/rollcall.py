"""Roll-call analytics: attribution, party lines, cohesion, agreement, dissent.

Everything is a chain of aggregations.  ``entries`` has one row for each
person of a roll call; a vote's entries are pre-aggregated by party before anything is joined, so what
is shuffled later has a row for each vote and party.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_initial, roll_initial, roll_surname, surname

CAST = ("ja", "nein", "enthaltung")


def attribute(entries: DataFrame, members: DataFrame) -> DataFrame:
    """``entries`` (vote_id, body_id, name, vote) with ``party``, null where it isn't unique.

    Candidates are the members of the vote's committee with the entry's surname, else of any
    committee; an initial narrows them unless it leaves none.
    """
    m = members.where(F.coalesce("party_code", F.lit("")) != "").select("body_id", surname(F.col("name")).alias("sn"), first_initial(F.col("name")).alias("initial"), "party_code")
    pair = F.struct("initial", F.col("party_code").alias("code"))
    own = m.groupBy("body_id", "sn").agg(F.collect_set(pair).alias("own"))
    every = m.groupBy("sn").agg(F.collect_set(pair).alias("every"))
    e = entries.withColumn("sn", roll_surname(F.col("name"))).withColumn("ini", roll_initial(F.col("name")))
    e = e.join(own, ["body_id", "sn"], "left").join(every, "sn", "left")
    found = F.coalesce("own", "every", F.array().cast(e.schema["every"].dataType))
    narrow = F.filter(found, lambda x: x["initial"].isNull() | (x["initial"] == F.col("ini")))
    chosen = F.when(F.col("ini").isNotNull() & (F.size(narrow) > 0), narrow).otherwise(found)
    codes = F.array_distinct(F.transform(chosen, lambda x: x["code"]))
    return e.withColumn("party", F.when(F.size(codes) == 1, F.element_at(codes, 1))).drop("sn", "ini", "own", "every")


def party_counts(entries: DataFrame, keys: tuple[str, ...] = ("vote_id",)) -> DataFrame:
    """Counts of the four choices for each vote and party; an empty choice is an absence."""
    w = F.coalesce(F.when(F.col("vote") != "", F.col("vote")), F.lit("abwesend"))
    return entries.where("party is not null").groupBy(*keys, "party").agg(*(F.count_if(w == k).alias(k) for k in (*CAST, "abwesend")))


def line(ja: Column, nein: Column, enthaltung: Column) -> Column:
    """The choice most cast; of equal ones yes before no before abstention; null if none was cast."""
    return F.when(ja + nein + enthaltung == 0, None).when(ja >= F.greatest(nein, enthaltung), "ja").when(nein >= enthaltung, "nein").otherwise("enthaltung")


def party_lines(counts: DataFrame) -> DataFrame:
    """``counts`` of parties that cast a vote, with their line, votes cast and votes with the line."""
    c = counts.withColumn("line", line(*map(F.col, CAST))).where("line is not null")
    with_line = F.when(F.col("line") == "ja", F.col("ja")).when(F.col("line") == "nein", F.col("nein")).otherwise(F.col("enthaltung"))
    return c.withColumn("cast", F.col("ja") + F.col("nein") + F.col("enthaltung")).withColumn("with_line", with_line)


def cohesion(lines: DataFrame) -> DataFrame:
    sums = (F.sum(k).alias(k) for k in (*CAST, "abwesend", "with_line"))
    out = lines.groupBy("party").agg(F.count("*").alias("votes"), F.sum("cast").alias("members_cast"), *sums)
    return out.withColumn("cohesion", F.col("with_line") / F.col("members_cast")).withColumn("attendance", 1 - F.col("abwesend") / (F.col("members_cast") + F.col("abwesend")))


def agreement(lines: DataFrame, key: str = "vote_id") -> DataFrame:
    """Share of common votes with equal lines, for each pair of parties ``a < b``.

    A vote's lines, at most one for each party, are one array; pairs come from it, without a join.
    """
    per = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("party", "line"))).alias("x"))
    pairs = F.flatten(F.transform("x", lambda a, i: F.transform(F.slice("x", i + 2, F.size("x")), lambda b: F.struct(a["party"].alias("a"), b["party"].alias("b"), (a["line"] == b["line"]).cast("int").alias("same")))))
    return per.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.same").alias("same"), F.count("*").alias("n")).withColumn("agree", F.col("same") / F.col("n"))


def agreement_matrix(pairs: DataFrame) -> DataFrame:
    """Both directions of every pair."""
    return pairs.select("a", "b", "agree", "n").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "agree", "n"))


def dissent(entries: DataFrame, lines: DataFrame, key: str = "vote_id") -> DataFrame:
    """For each name as the roll calls spell it: votes cast and those against the party's line."""
    cast = entries.where(F.col("vote").isin(*CAST) & F.col("party").isNotNull())
    joined = cast.join(lines.select(key, "party", "line"), [key, "party"])
    return joined.groupBy("name").agg(F.min("party").alias("party"), F.count_if(F.col("vote") != F.col("line")).alias("dissents"), F.count("*").alias("votes")).where("dissents > 0")


def top_dissenters(found: DataFrame, n: int = 20) -> DataFrame:
    return found.orderBy(F.desc("dissents"), F.desc("votes"), "name").limit(n)


def vote_totals(votes: DataFrame) -> DataFrame:
    """One row: votes, those with a roll call, unanimous and contested ones (``ja, nein, enthaltung, members``)."""
    ja, nein, enth = (F.coalesce(k, F.lit(0)) for k in CAST)
    counted = ja + nein + enth > 0
    return votes.agg(
        F.count("*").alias("votes"),
        F.count_if(F.size("members") > 0).alias("with_rollcall"),
        F.count_if(counted & (nein == 0) & (enth == 0)).alias("unanimous"),
        F.count_if(counted & (nein > 0)).alias("contested"),
    )


def person_votes(entries: DataFrame, members: DataFrame, full_name: str) -> DataFrame:
    """Entries of one person: same surname, no contradicting initial, and, without one, a surname that
    is unique on the committee or, if nobody there has it, among all; one entry for each vote.

    ``entries`` has ``vote_id, body_id, position, name, vote`` and what else is to be kept.
    """
    target = F.lit(full_name)
    known = members.select("body_id", surname(F.col("name")).alias("sn")).where(F.col("sn") == surname(target))
    here = known.groupBy("body_id").agg(F.count("*").alias("here"))
    every = known.agg(F.count("*").alias("every"))  # one row
    e = entries.where((surname(target) != "") & (roll_surname(F.col("name")) == surname(target))).join(here, "body_id", "left").join(F.broadcast(every), how="inner")
    ini = roll_initial(F.col("name"))
    fits = ini.isNull() | first_initial(target).isNull() | (ini == first_initial(target))
    clear = ini.isNotNull() | (F.coalesce("here", "every") <= 1)
    e = e.where(fits & clear).drop("here", "every")
    rest = [c for c in e.columns if c != "vote_id"]
    return e.groupBy("vote_id").agg(F.min_by(F.struct(*rest), "position").alias("e")).select("vote_id", "e.*")
