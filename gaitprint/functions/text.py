"""Normal forms of text columns, and what a user agent tells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's text methods see it.
SPACE = r"(?U)[\s\x1c-\x1f]"
# First match decides.
FAMILIES = (("headless", ("headless",)), ("yandex", ("yabrowser",)), ("edge", ("edg/",)), ("firefox", ("firefox",)), ("chrome", ("chrome", "crios")), ("safari", ("safari",)))
SYSTEMS = (("android", ("android",)), ("ios", ("iphone", "ipad")), ("windows", ("windows",)), ("mac", ("macintosh",)), ("linux", ("linux", "x11")))
AUTOMATED = "headless|python|curl|wget|scrapy|selenium|httpclient|bot"
PLATFORMS = {"desktop": "web", "iphone": "ios"}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def label(name: str) -> Column:
    """Lower-cased and stripped; blank is null."""
    return F.nullif(F.lower(strip(F.col(name))), F.lit(""))


def platform(name: str = "platform") -> Column:
    plain = label(name)
    return F.coalesce(*[F.when(plain == old, new) for old, new in PLATFORMS.items()], plain)


def query(name: str = "search_query") -> Column:
    return F.nullif(F.regexp_replace(F.lower(strip(F.col(name))), f"{SPACE}+", " "), F.lit(""))


def user_agent(name: str = "user_agent") -> Column:
    return F.lower(strip(F.coalesce(F.col(name), F.lit(""))))


def _first(ua: Column, table) -> Column:
    out = F.lit("other")
    for name, marks in reversed(table):
        hit = F.lit(False)
        for m in marks:
            hit = hit | ua.contains(m)
        out = F.when(hit, name).otherwise(out)
    return out


def family(ua: Column) -> Column:
    return _first(ua, FAMILIES)


def system(ua: Column) -> Column:
    return _first(ua, SYSTEMS)


def automated(ua: Column) -> Column:
    return ua.rlike(AUTOMATED)
