"""Text expressions; all stay in the JVM and take Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def like_ascii_ci(c: Column, pattern: str) -> Column:
    """SQLite's LIKE: only A-Z ignore case, there is no escape character."""
    body = ascii_lower(F.lit(pattern.replace("\\", "\\\\")))
    return F.like(ascii_lower(c), body)


def contains_ascii_ci(c: Column, needle: str) -> Column:
    return like_ascii_ci(c, f"%{needle}%")


def squash(c: Column) -> Column:
    """White space runs become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def blank_to_null(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t != "", t)


def first_filled(*cs: Column) -> Column:
    """The first that is neither null nor blank, trimmed."""
    return F.coalesce(*map(blank_to_null, cs))


def int_prefix(c: Column) -> Column:
    """SQLite's CAST to integer: the leading number, else 0."""
    return F.coalesce(F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def dotted_order(c: Column) -> list[Column]:
    """Sort keys of ``TOP 3.1``: (3, 1); a third level isn't seen."""
    rest = F.replace(F.coalesce(c, F.lit("")), F.lit("TOP "), F.lit(""))
    dot = F.instr(rest, ".")
    return [int_prefix(rest), F.when(dot > 0, int_prefix(F.substr(rest, dot + 1, F.length(rest)))).otherwise(F.lit(0).cast("bigint"))]


def tolerant_int(c: Column) -> Column:
    """``"5.0"`` is 5, halves go to even, anything else is null."""
    return F.bround(F.trim(c.cast("string")).try_cast("double")).try_cast("int")


# ---------------------------------------------------------------- classification

# Keywords of labels in order of precedence, and their document types.
DOC_TYPE_RULES = [
    ("niederschrift", "Niederschrift"), ("abstimmungsergebnis", "Abstimmungsergebnis"), ("wortprotokoll", "Wortprotokoll"), ("protokoll", "Protokoll"),
    ("beschlussvorlage", "Beschlussvorlage"), ("beschluss", "Beschluss"), ("einladung", "Einladung"), ("tagesordnung", "Tagesordnung"),
    ("antrag", "Antrag"), ("anfrage", "Anfrage"), ("vorlage", "Vorlage"), ("präsentation", "Präsentation"), ("praesentation", "Präsentation"),
    ("geschäftsordnung", "Geschäftsordnung"), ("anlage", "Anlage"), ("plan", "Plan"), ("karte", "Karte"),
]

# Paper types of the source and their document types.
PAPER_TYPES = {"Beschlussvorlage": "Beschlussvorlage", "Informationsvorlage": "Vorlage", "Anfrage": "Anfrage", "Antrag": "Antrag", "Änderungs-/Ergänzungsantrag": "Antrag", "Offenlage": "Vorlage"}

# Codes of council groups and the patterns that name them.
GROUP_PATTERNS = [
    ("CDU", [r"\bCDU\b"]),
    ("B90", [r"B[üu]ndnis\s*90", r"\bGR[ÜU]NE[NR]?\b", r"\bGruene[nr]?\b", r"Die\s+Gr[üu]nen"]),
    ("SPD", [r"\bSPD\b"]),
    ("LIN", [r"\bDIE\s+LINKE\b", r"\bLINKE\b", r"\bLinke\b"]),
    ("FDP", [r"\bFDP\b"]),
    ("AFD", [r"\bAfD\b", r"\bAFD\b"]),
    ("FWV", [r"\bFWV\b", r"\bFW\b", r"Freie\s+W[äa]hler"]),
    ("KAL", [r"\bKAL\b", r"Karlsruher\s+Liste"]),
    ("VOL", [r"\bVolt\b"]),
    ("PAR", [r"Die\s+PARTEI", r"\bPARTEI\b"]),
    ("HEI", [r"Die\s+Heimat"]),
]
ADMIN = "SVK"
# Document types of the administration, of council groups, and those with a number of their own.
ADMIN_TYPES = ["Beschlussvorlage", "Vorlage", "Niederschrift", "Protokoll", "Wortprotokoll", "Tagesordnung", "Einladung", "Abstimmungsergebnis", "Geschäftsordnung", "Präsentation", "Plan", "Karte", "Beschluss"]
GROUP_TYPES = ["Antrag", "Anfrage"]
OWN_NUMBER_TYPES = ["Beschlussvorlage", "Vorlage", "Antrag", "Anfrage", "Beschluss"]
OTHER = "Sonstiges"


def first_rule(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The value of the first rule whose keyword the lower-cased text contains."""
    low = F.lower(F.coalesce(c, F.lit("")))
    out = None
    for word, value in rules:
        hit = F.contains(low, F.lit(word))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return F.lit(default) if out is None else out.otherwise(default)


def document_type(label: Column) -> Column:
    return first_rule(label, DOC_TYPE_RULES, OTHER)


def paper_document_type(paper_type: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in PAPER_TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.when(paper_type != "", paper_type)), F.when(F.startswith(paper_type, F.lit("Haushalt")), "Antrag"))


def document_type_of(label: Column, paper_type: Column) -> Column:
    """By label; the paper's type counts only where the label says nothing."""
    by_label = document_type(label)
    return F.when(by_label == OTHER, F.coalesce(paper_document_type(paper_type), by_label)).otherwise(by_label)


def tags(c: Column, patterns: list[tuple[str, list[str]]]) -> Column:
    """Codes, in the list's order, of which any pattern is found."""
    c = F.coalesce(c, F.lit(""))
    return F.array_compact(F.array(*(F.when(F.rlike(c, F.lit("|".join(f"(?:{p})" for p in found))), code) for code, found in patterns)))


def submitters(label: Column, fulltext: Column, doc_type: Column, patterns: list[tuple[str, list[str]]] = GROUP_PATTERNS) -> Column:
    """Motions: groups named by the label, else by the first 800 characters; the administration's
    types: its code; else the label alone."""
    by_label = tags(label, patterns)
    kind = F.coalesce(doc_type, F.lit(""))
    motion = F.when(F.size(by_label) > 0, by_label).otherwise(tags(F.substring(fulltext, 1, 800), patterns))
    return F.when(kind.isin(GROUP_TYPES), motion).when(kind.isin(ADMIN_TYPES), F.array(F.lit(ADMIN))).otherwise(by_label)


# ---------------------------------------------------------------- numbers of proposals

# Fixed value: a proposal number as headers write it.
NUMBER = r"(?:Vorlage|Drucksache)(?:n-?\s?Nr\.?|nummer)?\s*[:\s]\s*(20\d{2}\s*[/-]\s*\d{3,5})"


def normal_number(c: Column) -> Column:
    """``2026 / 0324`` and ``2026-0324`` become ``2026/0324``; a range of budget years is null."""
    n = F.replace(F.regexp_replace(c, r"\s", ""), F.lit("-"), F.lit("/"))
    year, seq = F.element_at(F.split(n, "/"), 1), F.element_at(F.split(n, "/"), 2)
    budget = (F.length(seq) == 4) & F.startswith(seq, F.lit("20")) & (F.abs(seq.try_cast("int") - year.try_cast("int")) <= 1)
    return F.when(~budget, n)


def proposal_numbers(c: Column, pattern: str = NUMBER) -> Column:
    """Distinct valid numbers in order of appearance."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(1))
    return F.array_distinct(F.array_compact(F.transform(found, normal_number)))


def proposal_references(label: Column, fulltext: Column) -> Column:
    return proposal_numbers(F.concat(F.coalesce(label, F.lit("")), F.lit("\n"), F.substring(F.coalesce(fulltext, F.lit("")), 1, 200_000)))


def own_number(label: Column, fulltext: Column, doc_type: Column) -> Column:
    head = F.concat(F.coalesce(label, F.lit("")), F.lit("\n"), F.substring(F.coalesce(fulltext, F.lit("")), 1, 1500))
    return F.when(doc_type.isin(OWN_NUMBER_TYPES), F.try_element_at(proposal_numbers(head), F.lit(1)))


def reference_base(c: Column) -> Column:
    found = F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*(20\d{2}/\d{3,5})", 1)
    return F.when(found != "", found)


def derived_anchor(anchor: Column, label: Column) -> Column:
    """The file's own anchor, else ``top3.1`` from ``TOP 3.1`` in the label."""
    found = F.regexp_extract(F.coalesce(label, F.lit("")), r"TOP\s*(\d+(?:\.\d+)*)", 1)
    return F.coalesce(F.when(anchor != "", anchor), F.when(found != "", F.concat(F.lit("top"), found)))


# ---------------------------------------------------------------- names

# What counts as a title in names.
TITLE = r"(?i)^(dr|prof|dipl|ing|med|rer|nat|phil|jur|habil|h|c)[.\-]*$"
INLINE_TITLE = r"(?i)\b(?:dr|prof|dipl|ing|med|rer|nat|phil|jur|habil)\.\s*"


def _name_words(name: Column) -> Column:
    return F.filter(F.split(F.trim(F.coalesce(name, F.lit(""))), r"(?U)\s+"), lambda t: t != "")


def _name_core(name: Column) -> Column:
    return F.filter(_name_words(name), lambda t: ~F.endswith(t, F.lit(".")) & ~F.rlike(t, F.lit(TITLE)))


def surname(name: Column) -> Column:
    """Last word that is no title, else the last word, else empty; case-folded."""
    core, words = _name_core(name), _name_words(name)
    return casefold(F.coalesce(F.try_element_at(core, F.lit(-1)), F.try_element_at(words, F.lit(-1)), F.lit("")))


def first_initial(name: Column) -> Column:
    core = _name_core(name)
    return F.when(F.size(core) >= 2, casefold(F.substring(F.element_at(core, 1), 1, 1)))


def roll_surname(name: Column) -> Column:
    n = F.trim(F.coalesce(name, F.lit("")))
    bare = F.regexp_replace(F.substring_index(n, ",", 1), INLINE_TITLE, "")
    return casefold(F.coalesce(F.try_element_at(_name_words(bare), F.lit(-1)), F.lit("")))


def roll_initial(name: Column) -> Column:
    n = F.trim(F.coalesce(name, F.lit("")))
    after = F.rtrim(F.trim(F.substr(n, F.instr(n, ",") + 1, F.length(n))), F.lit("."))
    return F.when((F.instr(n, ",") > 0) & (after != ""), casefold(F.substring(after, 1, 1)))


# ---------------------------------------------------------------- flags and statuses


def meeting_public(title: Column) -> Column:
    """True, false, or null where a title says both or neither."""
    low = F.lower(F.coalesce(title, F.lit("")))
    closed = F.contains(low, F.lit("nicht öffentlich")) | F.contains(low, F.lit("nichtöffentlich"))
    rest = F.replace(F.replace(low, F.lit("nicht öffentlich"), F.lit("")), F.lit("nichtöffentlich"), F.lit(""))
    open_ = F.contains(rest, F.lit("öffentlich"))
    return F.when(closed & ~open_, False).when(open_ & ~closed, True)


def item_public(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.contains(low, F.lit("nicht öffentlich")) | F.contains(low, F.lit("nichtöffentlich")), False).when(F.contains(low, F.lit("öffentlich")), True)


def text_status(text: Column, failed: Column | None = None) -> Column:
    """``ok`` for 20 characters or more once trimmed, ``error`` if reading failed, else ``needs_ocr``."""
    ok = F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) >= 20, "ok").otherwise("needs_ocr")
    return ok if failed is None else F.when(failed, "error").otherwise(ok)


# Characters kept of a text by purpose.
CAPS = {"head": 800, "own_number": 1500, "bulk_prompt": 6000, "served": 8000, "prompt": 24_000, "references": 200_000, "stored": 400_000}


def capped(c: Column, purpose: str) -> Column:
    return F.substring(c, 1, CAPS[purpose])


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), (">", "&gt;"), ("<", "&lt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def ics_escape(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    for a, b in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\n", "\\n")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def content_id(c: Column) -> Column:
    """First 16 digits of the SHA-1, for files without a number."""
    return F.substring(F.sha1(c), 1, 16)
