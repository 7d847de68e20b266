"""Full-text search: postings, AND of prefix phrases, BM25, snippets.

Tokens are runs of letters and digits, lower-cased and without diacritics (ß stays).  A
posting is (doc, col, pos, term).  A query reads the postings of its words only: the
index is written in ranges of terms, and a prefix or a word is pushed down to the files' statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters whose diacritics are folded away.
_ACCENTED = "äöüáàâãåāăąéèêëēĕėęěíìîïīĭįóòôõōŏőúùûũūŭůűųñńņňçćĉċčýÿŷžźżşśŝšťţďğĝġģřŕŗľĺļķĵĥ"
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def folded(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(c), _FOLD_PAIRS[0], _FOLD_PAIRS[1]), r"\p{Mn}", "")


def _pairs() -> tuple[str, str]:
    import unicodedata

    kept = [(a, unicodedata.normalize("NFD", a)[0]) for a in dict.fromkeys(_ACCENTED) if len(unicodedata.normalize("NFD", a)) > 1]
    return "".join(a for a, _ in kept), "".join(b for _, b in kept)


_FOLD_PAIRS = _pairs()


def tokens(c: Column) -> Column:
    """Folded tokens of a text, in order; null gives none."""
    return F.regexp_extract_all(folded(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def postings(docs: DataFrame, id_: str, columns: list[str]) -> DataFrame:
    """(doc, col, pos, term) of the named columns of each row."""
    parts = F.array(*(F.struct(F.lit(i).alias("col"), tokens(F.col(c)).alias("terms")) for i, c in enumerate(columns)))
    t = docs.select(F.col(id_).alias("doc"), F.explode(parts).alias("p"))
    return t.select("doc", "p.col", F.posexplode("p.terms").alias("pos", "term"))


def lengths(docs: DataFrame, id_: str, columns: list[str]) -> DataFrame:
    """(doc, length): tokens in all columns."""
    n = sum((F.size(tokens(F.col(c))) for c in columns), F.lit(0))
    return docs.select(F.col(id_).alias("doc"), n.cast("long").alias("length"))


def write_index(posted: DataFrame, path: str) -> None:
    """Postings in ranges of (term, doc), so that a frequent term takes as many files as it needs; files know their first and last term."""
    posted.repartitionByRange("term", "doc", "col", "pos").sortWithinPartitions("term", "doc", "col", "pos").write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str, id_type: str = "string") -> DataFrame:
    return spark.read.schema(f"doc {id_type}, col int, pos int, term string").parquet(path)


def query_phrases(query: str) -> list[list[str]]:
    """Phrases of folded words, folded by the index's own table."""
    import re
    import unicodedata

    low = query.lower().translate(str.maketrans(*_FOLD_PAIRS))
    plain = "".join(c for c in low if unicodedata.category(c) != "Mn")
    return [p for t in re.findall(r"(?:[^\W_]|-)+", plain) if (p := [w for w in t.split("-") if w])]


def phrase_hits(posted: DataFrame, phrase: list[str]) -> DataFrame:
    """(doc, hits): occurrences of a phrase inside one column; its last word is a prefix."""
    *whole, last = phrase
    ends = F.startswith(F.col("term"), F.lit(last))
    if not whole:
        return posted.where(ends).groupBy("doc").agg(F.count("*").alias("hits"))
    # every word votes for the place where the phrase would start
    steps = [(F.col("term") == w) for w in whole] + [ends]
    votes = F.array_compact(F.array(*(F.when(c, F.struct((F.col("pos") - i).alias("start"), F.lit(i).alias("word"))) for i, c in enumerate(steps))))
    any_word = F.lit(False)
    for c in steps:
        any_word = any_word | c
    at = posted.where(any_word).select("doc", "col", F.explode(votes).alias("v"))
    found = at.groupBy("doc", "col", "v.start").agg(F.count_distinct("v.word").alias("n")).where(F.col("n") == len(phrase))
    return found.groupBy("doc").agg(F.count("*").alias("hits"))


def search(posted: DataFrame, sizes: DataFrame, query: str) -> DataFrame:
    """(doc, score) of documents holding every phrase; the least score is the best (BM25, negated).

    A query without words finds nothing.
    """
    phrases = query_phrases(query)
    if not phrases:
        return sizes.where("false").select("doc", F.lit(0.0).alias("score"))
    stats = sizes.agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean"))  # one row
    hits = None
    for i, p in enumerate(phrases):
        own = phrase_hits(posted, p).withColumnRenamed("hits", f"h{i}")
        hits = own if hits is None else hits.join(own, "doc", "full")
    seen = hits.agg(*(F.count(f"h{i}").alias(f"n{i}") for i in range(len(phrases))))  # one row
    full = hits.where(" and ".join(f"h{i} is not null" for i in range(len(phrases)))).join(sizes, "doc").join(F.broadcast(stats)).join(F.broadcast(seen))
    return full.select("doc", bm25([(F.col(f"h{i}"), F.col(f"n{i}")) for i in range(len(phrases))], F.col("length"), F.col("n_docs"), F.col("mean")).alias("score"))


def bm25(terms: list[tuple[Column, Column]], length: Column, n_docs: Column, mean: Column) -> Column:
    """Negated BM25 of (hits, documents with the phrase); an idf that isn't positive counts a millionth."""
    score = F.lit(0.0)
    for f, n in terms:
        idf = F.log((n_docs - n + 0.5) / (n + 0.5))
        idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
        score = score + idf * (f * (K1 + 1)) / (f + K1 * (1 - B + B * length / mean))
    return -score


def snippet(text: Column, query: str, width: int = 20, left: str = "\x01", right: str = "\x02", gap: str = " … ") -> Column:
    """The first window of ``width`` words with the most different query words, hits between marks."""
    words = [w for p in query_phrases(query) for w in p]
    bit = lambda w: sum((F.when(F.startswith(w, F.lit(q)), F.lit(1 << i)).otherwise(F.lit(0)) for i, q in enumerate(words)), F.lit(0))
    raw = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")
    marked = F.transform(raw, lambda w: F.struct(w.alias("w"), bit(F.regexp_replace(folded(w), r"[^\p{L}\p{N}]", "")).alias("m")))

    def show(x: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(x) - width + 1, F.lit(1)))
        seen = lambda s: F.bit_count(F.aggregate(F.slice(x, s, width), F.lit(0), lambda a, y: a.bitwiseOR(y["m"])))
        best = F.array_max(F.transform(starts, lambda s: F.struct(seen(s).alias("n"), (-s).alias("s"))))
        return _let(-best["s"], lambda at: F.concat(
            F.when(at > 1, gap).otherwise(""),
            F.concat_ws(" ", F.transform(F.slice(x, at, width), lambda y: F.when(y["m"] > 0, F.concat(F.lit(left), y["w"], F.lit(right))).otherwise(y["w"]))),
            F.when(at + width <= F.size(x), gap).otherwise(""),
        ))

    return _let(marked, show)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; lambdas would compute it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)
