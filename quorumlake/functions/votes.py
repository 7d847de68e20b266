"""Votes and enrichment results as models return them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import OTHER, tolerant_int

# Words for a choice.
ALIASES = {
    "ja": "ja", "yes": "ja", "dafür": "ja", "zustimmung": "ja", "nein": "nein", "no": "nein", "dagegen": "nein", "ablehnung": "nein",
    "enthaltung": "enthaltung", "enthalten": "enthaltung", "abstention": "enthaltung", "abwesend": "abwesend", "absent": "abwesend", "nicht anwesend": "abwesend",
}
# Categories of documents.
CATEGORIES = ["Bauen & Stadtentwicklung", "Umwelt & Klima", "Verkehr & Mobilität", "Soziales & Gesundheit", "Bildung & Kultur", "Finanzen & Haushalt", "Wirtschaft & Wissenschaft", "Verwaltung & Organisation", "Sicherheit & Ordnung", OTHER]


def choice(c: Column, aliases: dict[str, str] = ALIASES, default: str = "abwesend") -> Column:
    known = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.trim(F.lower(F.coalesce(c, F.lit(""))))), F.lit(default))


RAW_VOTE = "ja string, nein string, enthaltung string, members array<struct<name:string,vote:string>>"


def vote_of(json: Column) -> Column:
    """A result's struct, null if it isn't JSON or has none of the three counts; members need a name."""
    raw = F.from_json(salvaged(json), RAW_VOTE)
    ja, nein, enth = (tolerant_int(raw[k]) for k in ("ja", "nein", "enthaltung"))
    named = F.filter(F.coalesce(raw["members"], F.array()), lambda m: F.coalesce(m["name"], F.lit("")) != "")
    members = F.transform(named, lambda m: F.struct(F.trim(m["name"]).alias("name"), choice(m["vote"]).alias("vote")))
    return F.when(F.coalesce(ja, nein, enth).isNotNull(), F.struct(ja.alias("ja"), nein.alias("nein"), enth.alias("enthaltung"), members.alias("members")))


def salvaged(text: Column) -> Column:
    """The outermost braces of a reply, code fences and prose aside; null if there are none."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def category(c: Column, vocabulary: list[str] = CATEGORIES, default: str = OTHER) -> Column:
    """The vocabulary's spelling, case aside; anything else is the default."""
    known = F.create_map(*(F.lit(x) for v in vocabulary for x in (v.lower(), v)))
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(F.coalesce(c, F.lit(""))))), F.lit(default))


def string_list(json: Column, cap: int) -> Column:
    """A JSON value as a list of filled strings: a bare string is split at commas, of objects ``name`` or
    ``value`` counts; at most ``cap``."""
    as_list = F.from_json(json, "array<string>")
    bare = F.split(F.from_json(F.concat(F.lit('{"x":'), json, F.lit("}")), "x string")["x"], ",")
    items = F.when(F.startswith(F.ltrim(json), F.lit("[")), as_list).when(F.startswith(F.ltrim(json), F.lit('"')), bare)
    named = lambda x: F.when(F.startswith(x, F.lit("{")), F.coalesce(F.get_json_object(x, "$.name"), F.get_json_object(x, "$.value"), F.lit(""))).otherwise(x)
    return F.slice(F.filter(F.transform(F.coalesce(items, F.array()), lambda x: F.trim(named(x))), lambda x: x != ""), 1, cap)


def enrichment(json: Column) -> Column:
    raw = salvaged(json)
    get = lambda path: F.get_json_object(raw, path)
    entity = lambda k: string_list(F.coalesce(get(f"$.entities.{k}"), F.lit("[]")), 8).alias(k)
    listed = F.coalesce(get("$.topics"), F.lit("[]"))
    listed = F.when(F.startswith(F.ltrim(listed), F.lit("[")), listed).otherwise(F.to_json(F.split(listed, ",")))
    return F.when(
        F.try_parse_json(raw).isNotNull(),
        F.struct(
            F.trim(F.coalesce(get("$.summary_de"), F.lit(""))).alias("summary_de"), F.trim(F.coalesce(get("$.summary_en"), F.lit(""))).alias("summary_en"),
            category(get("$.category")).alias("category"), string_list(listed, 7).alias("topics"), F.struct(*map(entity, ("people", "orgs", "locations"))).alias("entities"),
        ),
    )
