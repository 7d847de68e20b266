"""Driver queries for roll calls and full-text search.

Analogue of the vote tables: a *vote* is a shipping date, a *member* a supplier, a *party* the
supplier's region, and the *choice* follows from return flag and line status.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fts
from ..operators import rollcall as rc
from .registry import Tables, query

_ENTRIES = """
e AS (SELECT l_shipdate AS vote_id, s_name AS name, r_name AS party,
  CASE WHEN l_returnflag = 'A' THEN 'ja' WHEN l_returnflag = 'N' THEN 'nein' WHEN l_linestatus = 'F' THEN 'enthaltung' ELSE 'abwesend' END AS vote
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
c AS (SELECT vote_id, party, count(*) FILTER (WHERE vote = 'ja') AS ja, count(*) FILTER (WHERE vote = 'nein') AS nein, count(*) FILTER (WHERE vote = 'enthaltung') AS enthaltung, count(*) FILTER (WHERE vote = 'abwesend') AS abwesend FROM e GROUP BY 1, 2),
l AS (SELECT *, ja + nein + enthaltung AS cast_n, CASE WHEN ja >= greatest(nein, enthaltung) THEN 'ja' WHEN nein >= enthaltung THEN 'nein' ELSE 'enthaltung' END AS line, greatest(ja, nein, enthaltung) AS with_line FROM c WHERE ja + nein + enthaltung > 0)
"""
_DAY = "CAST(CAST(vote_id AS DATE) AS VARCHAR)"


def entries(spark, sf) -> DataFrame:
    t = Tables(spark, sf)
    s = t.supplier.select("s_suppkey", "s_name", "s_nationkey").join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    s = s.select("s_suppkey", F.col("s_name").alias("name"), F.col("r_name").alias("party"))
    flag = F.col("l_returnflag")
    vote = F.when(flag == "A", "ja").when(flag == "N", "nein").when(F.col("l_linestatus") == "F", "enthaltung").otherwise("abwesend")
    return t.lineitem.select("l_suppkey", F.col("l_shipdate").alias("vote_id"), vote.alias("vote")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("vote_id", "name", "party", "vote")


def lines(spark, sf) -> DataFrame:
    return rc.party_lines(rc.party_counts(entries(spark, sf)))



def _with_day(df: DataFrame) -> DataFrame:
    return df.withColumn("vote_id", F.to_date("vote_id").cast("string"))


@query(f"WITH {_ENTRIES} SELECT {_DAY} AS vote_id, party, ja, nein, enthaltung, abwesend FROM c")
def party_vote_counts(spark, sf):
    return _with_day(rc.party_counts(entries(spark, sf)))


@query(f"WITH {_ENTRIES} SELECT {_DAY} AS vote_id, party, line, cast_n AS \"cast\", with_line FROM l")
def party_line(spark, sf):
    return _with_day(lines(spark, sf)).select("vote_id", "party", "line", "cast", "with_line")


@query(f"WITH {_ENTRIES} SELECT party, count(*) AS votes, sum(cast_n)::BIGINT AS members_cast, sum(ja)::BIGINT AS ja, sum(nein)::BIGINT AS nein, sum(enthaltung)::BIGINT AS enthaltung, sum(abwesend)::BIGINT AS abwesend, sum(with_line)::BIGINT AS with_line, sum(with_line) / sum(cast_n) AS cohesion, 1 - sum(abwesend) / (sum(cast_n) + sum(abwesend)) AS attendance FROM l GROUP BY party")
def party_cohesion(spark, sf):
    return rc.cohesion(lines(spark, sf))


@query(f"WITH {_ENTRIES} SELECT a.party AS a, b.party AS b, count(*) FILTER (WHERE a.line = b.line) AS same, count(*) AS n FROM l a JOIN l b ON a.vote_id = b.vote_id AND a.party < b.party GROUP BY 1, 2")
def pair_agreement(spark, sf):
    return rc.agreement(lines(spark, sf)).drop("agree")


@query(f"WITH {_ENTRIES}, p AS (SELECT a.party AS a, b.party AS b, count(*) FILTER (WHERE a.line = b.line) / count(*) AS agree, count(*) AS n FROM l a JOIN l b ON a.vote_id = b.vote_id AND a.party < b.party GROUP BY 1, 2) SELECT a, b, agree, n FROM p UNION ALL SELECT b, a, agree, n FROM p")
def agreement_matrix(spark, sf):
    return rc.agreement_matrix(rc.agreement(lines(spark, sf)))


@query(f"WITH {_ENTRIES} SELECT name, min(party) AS party, count(*) FILTER (WHERE vote <> line) AS dissents, count(*) AS votes FROM e JOIN l USING (vote_id, party) WHERE vote IN ('ja', 'nein', 'enthaltung') GROUP BY name HAVING count(*) FILTER (WHERE vote <> line) > 0 ORDER BY dissents DESC, votes DESC, name LIMIT 20")
def top_dissenters(spark, sf):
    e = entries(spark, sf)
    return rc.top_dissenters(rc.dissent(e, rc.party_lines(rc.party_counts(e))))


@query(f"WITH {_ENTRIES}, v AS (SELECT vote_id, count(*) FILTER (WHERE vote = 'ja') AS ja, count(*) FILTER (WHERE vote = 'nein') AS nein, count(*) FILTER (WHERE vote = 'enthaltung') AS enth, count(*) FILTER (WHERE vote = 'abwesend') AS away FROM e GROUP BY 1) SELECT count(*) AS votes, count(*) FILTER (WHERE away > 0) AS with_rollcall, count(*) FILTER (WHERE ja + nein + enth > 0 AND nein = 0 AND enth = 0) AS unanimous, count(*) FILTER (WHERE nein > 0) AS contested FROM v")
def vote_totals(spark, sf):
    """Votes whose roll call lists who was away; the others have no members."""
    e = entries(spark, sf)
    away = F.collect_list(F.when(F.col("vote") == "abwesend", F.col("name")))
    v = e.groupBy("vote_id").agg(*(F.count_if(F.col("vote") == k).alias(k) for k in rc.CAST), away.alias("members"))
    return rc.vote_totals(v)


@query("SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS vote_id, min_by(l_returnflag, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey) AS vote FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_suppkey = 3 GROUP BY l_shipdate")
def person_votes(spark, sf):
    t = Tables(spark, sf)
    members = t.supplier.select(F.col("s_nationkey").alias("body_id"), F.concat(F.lit("Dr. Ada Name"), F.col("s_suppkey").cast("string")).alias("name"))
    e = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_shipdate").alias("vote_id"), F.col("s_nationkey").alias("body_id"), (F.col("l_orderkey") * 100000000 + F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("position"),
        F.concat(F.lit("Name"), F.col("l_suppkey").cast("string"), F.lit(", A.")).alias("name"), F.col("l_returnflag").alias("vote"))
    return _with_day(rc.person_votes(e, members, "Ada Name3")).select("vote_id", "vote")


# ---------------------------------------------------------------- full-text search

#: Tokens as the queries below need them; the test texts hold letters with diacritics.
_TOKENS = r"regexp_extract_all(strip_accents(lower(replace(text, 'ß', '§'))), '[\p{L}\p{N}§]+')"
_POSTED = f"p AS (SELECT doc_id, unnest({_TOKENS}) AS term, generate_subscripts({_TOKENS}, 1) AS pos FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, len({_TOKENS}) AS length FROM documents)"


def _index(spark, sf) -> tuple[DataFrame, DataFrame]:
    d = Tables(spark, sf).documents.select("doc_id", "text")
    return fts.postings(d, "doc_id", ["text"]), fts.lengths(d, "doc_id", ["text"])


@query(f"WITH {_POSTED} SELECT doc_id AS doc, count(*) AS n, count(DISTINCT term) AS terms FROM p GROUP BY 1")
def fts_postings(spark, sf):
    return _index(spark, sf)[0].groupBy("doc").agg(F.count("*").alias("n"), F.count_distinct("term").alias("terms"))


@query(r"SELECT n_nationkey, pos, phrase FROM (SELECT n_nationkey, unnest(range(len(w) + 1)) AS pos, unnest(list_append(w, 'foo bar')) AS phrase FROM (SELECT n_nationkey, regexp_extract_all(lower(n_name), '[a-z0-9]+') AS w FROM nation))")
def fts_tokens(spark, sf):
    names = Tables(spark, sf).nation.select("n_nationkey", "n_name").collect()  # 25 rows; queries are taken apart on the driver
    return spark.createDataFrame([(n, i, " ".join(p)) for n, name in names for i, p in enumerate(fts.query_phrases(f"{name} (foo-bar)"))], "n_nationkey long, pos int, phrase string")


def _bm25(words: list[str]) -> str:
    hits = ", ".join(f"h{i} AS (SELECT doc_id, count(*) AS f FROM p WHERE starts_with(term, '{w}') GROUP BY 1)" for i, w in enumerate(words))
    idf = lambda i: f"(CASE WHEN ln((n_docs - (SELECT count(*) FROM h{i}) + 0.5) / ((SELECT count(*) FROM h{i}) + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - (SELECT count(*) FROM h{i}) + 0.5) / ((SELECT count(*) FROM h{i}) + 0.5)) END)"
    score = " + ".join(f"{idf(i)} * (h{i}.f * 2.2) / (h{i}.f + 1.2 * (0.25 + 0.75 * length / mean))" for i in range(len(words)))
    joins = " ".join(f"JOIN h{i} ON h{i}.doc_id = s.doc_id" for i in range(len(words)))
    return f"WITH {_POSTED}, {hits}, t AS (SELECT count(*) AS n_docs, avg(length) AS mean FROM s) SELECT s.doc_id AS doc, -({score}) AS score FROM s {joins} CROSS JOIN t"


@query(f"SELECT doc FROM ({_bm25(['enan', 'thre'])})")
def fts_and_prefix(spark, sf):
    return fts.search(*_index(spark, sf), "Enan, THRE!").select("doc")


@query(f"SELECT doc, round(score, 9) AS score FROM ({_bm25(['licens', 'version'])})")
def fts_search(spark, sf):
    return fts.search(*_index(spark, sf), "licens version").select("doc", F.round("score", 9).alias("score"))


@query(f"SELECT doc, round(score, 9) AS score FROM ({_bm25(['thint'])}) ORDER BY score, doc DESC LIMIT 10")
def bm25_topk(spark, sf):
    found = fts.search(*_index(spark, sf), "thint")
    return found.orderBy("score", F.desc("doc")).limit(10).select("doc", F.round("score", 9).alias("score"))


@query(f"SELECT count(*) AS n FROM ({_bm25(['eran'])})")
def fts_count(spark, sf):
    return fts.search(*_index(spark, sf), "eran").agg(F.count("*").alias("n"))


@query(f"WITH {_POSTED} SELECT DISTINCT a.doc_id AS doc FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'apache' AND starts_with(b.term, 'licen')")
def fts_phrase(spark, sf):
    return fts.search(*_index(spark, sf), "apache-licen").select("doc")


@query(r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS raw FROM documents WHERE text ILIKE '%apache%'), h AS (SELECT *, list_transform(raw, lambda x: starts_with(regexp_replace(strip_accents(lower(x)), '[^\p{L}\p{N}]', '', 'g'), 'apache')) AS hit FROM w), f AS (SELECT *, greatest(1, least(list_position(hit, true), greatest(1, len(raw) - 19) + 19) - 19) AS s FROM h WHERE list_contains(hit, true)) SELECT doc_id, (CASE WHEN s > 1 THEN ' … ' ELSE '' END) || array_to_string(list_transform(range(s, least(s + 20, len(raw) + 1)), lambda i: CASE WHEN hit[i] THEN '[' || raw[i] || ']' ELSE raw[i] END), ' ') || (CASE WHEN s + 20 <= len(raw) THEN ' … ' ELSE '' END) AS snippet FROM f")
def fts_snippet(spark, sf):
    d = Tables(spark, sf).documents.where(F.contains(F.lower("text"), F.lit("apache")))
    return d.select("doc_id", fts.snippet(F.col("text"), "apache", 20, "[", "]").alias("snippet")).where(F.contains("snippet", F.lit("[")))
