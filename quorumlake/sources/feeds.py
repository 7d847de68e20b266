"""Text sinks: calendar (ICS) and feed (RSS)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import rfc2822, time_window
from ..functions.text import ics_escape, xml_escape

CRLF = "\r\n"
_ZONE = [
    "BEGIN:VTIMEZONE", "TZID:Europe/Berlin", "BEGIN:DAYLIGHT", "TZOFFSETFROM:+0100", "TZOFFSETTO:+0200", "TZNAME:CEST", "DTSTART:19700329T020000", "RRULE:FREQ=YEARLY;BYMONTH=3;BYDAY=-1SU", "END:DAYLIGHT",
    "BEGIN:STANDARD", "TZOFFSETFROM:+0200", "TZOFFSETTO:+0100", "TZNAME:CET", "DTSTART:19701025T030000", "RRULE:FREQ=YEARLY;BYMONTH=10;BYDAY=-1SU", "END:STANDARD", "END:VTIMEZONE",
]


def ics_event(domain: Column, stamp: Column, id_: Column, day: Column, time: Column, summary: Column, location: Column, title: Column, url: Column) -> Column:
    """A session's event; without a readable time it lasts the day.  Null parts are left out."""
    w = time_window(time, day)
    fmt = "yyyyMMdd'T'HHmmss"
    timed = F.concat_ws(CRLF, F.concat(F.lit("DTSTART;TZID=Europe/Berlin:"), F.date_format(w["start"], fmt)), F.concat(F.lit("DTEND;TZID=Europe/Berlin:"), F.date_format(w["end"], fmt)))
    whole = F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format(day, "yyyyMMdd"))
    filled = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(name), c))
    return F.concat_ws(
        CRLF, F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), id_, F.lit("@"), domain), F.concat(F.lit("DTSTAMP:"), stamp), F.when(w.isNotNull(), timed).otherwise(whole),
        F.concat(F.lit("SUMMARY:"), ics_escape(summary)), filled("LOCATION:", F.when(location != "", ics_escape(location))), filled("URL:", url),
        F.concat(F.lit("DESCRIPTION:"), ics_escape(F.concat(F.coalesce(title, F.lit("")), F.lit(" · "), F.coalesce(url, F.lit(""))))), F.lit("END:VEVENT"),
    )


def ics_calendar(events: DataFrame, order: list[Column], name: str, limit: int = 500) -> str:
    """The calendar's text from rows with ``ics``; at most ``limit`` events come to the driver."""
    rows = [r.ics for r in events.orderBy(*order).limit(limit).select("ics").collect()]
    head = ["BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:-//quorumlake//EN", "CALSCALE:GREGORIAN", "METHOD:PUBLISH", f"X-WR-CALNAME:{name}", "X-WR-TIMEZONE:Europe/Berlin"]
    return CRLF.join([*head, *_ZONE, *rows, "END:VCALENDAR"]) + CRLF


def rss_item(base: Column, id_: Column, label: Column, downloaded: Column, parts: list[Column], summary: Column) -> Column:
    filled = [F.when(F.coalesce(p.cast("string"), F.lit("")) != "", p.cast("string")) for p in parts]
    about = F.concat(F.concat_ws(" · ", *filled), F.when(F.coalesce(summary, F.lit("")) != "", F.concat(F.lit("\n\n"), summary)).otherwise(""))
    title = F.coalesce(F.when(label != "", label), id_)
    return F.concat(
        F.lit("<item><title>"), xml_escape(title), F.lit("</title><link>"), xml_escape(F.concat(base, F.lit("/?doc="), id_)), F.lit('</link><guid isPermaLink="false">'), xml_escape(id_), F.lit("</guid>"),
        F.coalesce(F.concat(F.lit("<pubDate>"), rfc2822(downloaded), F.lit("</pubDate>")), F.lit("")), F.lit("<description>"), xml_escape(about), F.lit("</description></item>"),
    )


def rss_channel(items: DataFrame, order: list[Column], title: str, link: str, about: str, limit: int = 50) -> str:
    """The feed's text from rows with ``item``; at most ``limit`` items come to the driver."""
    from xml.sax.saxutils import escape

    rows = [r["item"] for r in items.orderBy(*order).limit(limit).select("item").collect()]
    return f'<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>{escape(title)}</title><link>{escape(link)}</link><description>{escape(about)}</description><language>de-de</language>{"".join(rows)}</channel></rss>'
