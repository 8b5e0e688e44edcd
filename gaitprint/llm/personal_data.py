"""Personal data (operator 9), with DataFrame functions only.

Regular expressions propose spans, checks confirm them (Luhn for cards, mod 97 for IBANs, ranges and digit
counts for the others), and words near a span adjust its score.  Emails, IPv4 addresses, cards and phones
are the base kinds: what their checks confirm is always reported.  IBANs and US social security numbers are
the further kinds: they are reported if their score reaches ``MIN_SCORE``.

The patterns are written so that the JVM's matcher needs neither recursion nor more than a few steps back:
possessive loops, and starts only where a run of the first class begins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitprint.llm.common import free_name, own_columns

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
MIN_SCORE = 0.6
#: Characters before and after a span (up to the next proposal of its kind) that are searched for words.
NEAR = 40

#: Length of an IBAN by the countries that have it.
_IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR",
    27: "BI CF CG CM DJ FR GA GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN_KNOWN = "(?:" + "|".join(c for known in _IBAN_COUNTRIES.values() for c in known.split()) + ")"
#: A known country's IBAN has its length, so that what follows it is left alone; with another country code it is a run of
#: capitals and digits, which ends before a known one.
_IBAN = "|".join(
    [rf"(?:{known.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{length - 4}}}+" for length, known in _IBAN_COUNTRIES.items()]
    + [rf"(?!{_IBAN_KNOWN})[A-Z]{{2}}[0-9]{{2}}(?:(?: (?!{_IBAN_KNOWN}[0-9]{{2}}))?[A-Z0-9]){{11,30}}+"]
)
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
#: What proposes a span.  Cards and phones are proposed only with a fitting number of digits.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN})(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A cheap test that a text must pass to be searched for a kind at all.
_HINTS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")),
    "card": lambda t: F.rlike(t, F.lit(r"[0-9](?:[ -]?[0-9]){11}")),
    "phone": lambda t: F.rlike(t, F.lit(r"\+[0-9]")),
    "iban": lambda t: F.rlike(t, F.lit(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]")),
    "ssn": lambda t: F.rlike(t, F.lit(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")),
}
#: Scores of a confirmed span without any word near it, what a word for or against the kind adds, and the words.
_START = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4}
_FOR, _AGAINST = 0.2, -0.3
_WORDS_FOR = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach)\b",
    "ip": r"(?i)\b(?:ip|address|host|server|login|logged)\b",
    "card": r"(?i)\b(?:card|credit|debit|visa|mastercard|amex|payment|paid)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp)\b",
    "iban": r"(?i)\b(?:iban|account|bank|transfer|konto|compte|cuenta)\b",
    "ssn": r"(?i)\b(?:ssn|social security|taxpayer)\b",
}
_WORDS_AGAINST = {
    "email": r"(?i)\b(?:example|noreply)\b",
    "ip": r"(?i)\b(?:version|release|section|chapter)\b",
    "card": r"(?i)\b(?:isbn|order|serial|tracking)\b",
    "phone": r"(?i)\b(?:score|version|isbn)\b",
    "iban": r"(?i)\b(?:serial|model|part)\b",
    "ssn": r"(?i)\b(?:serial|part|order|isbn)\b",
}
#: Numbers of one block of the scans below, and code points of one piece of a text that is masked.
_BLOCK, _PIECE = 512, 1024


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body, or a function in it, reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(values: Column, zero: int, combine: Callable[[Column, Column], Column]) -> Column:
    """For each number of an array what ``combine`` makes of all before it; in blocks, so that long arrays don't cost their square."""

    def within(block: Column) -> Column:
        start = F.struct(F.lit(zero).cast("long").alias("all"), F.array().cast("array<bigint>").alias("out"))
        step = lambda acc, x: F.struct(combine(acc["all"], x).alias("all"), F.concat(acc["out"], F.array(acc["all"])).alias("out"))
        return F.aggregate(block, start, step)

    def blocks(v: Column) -> Column:
        last = F.greatest(F.ceil(F.size(v) / _BLOCK).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: within(F.slice(v, i * _BLOCK + 1, F.lit(_BLOCK))))

    def joined(each: Column) -> Column:
        bases = within(F.transform(each, lambda b: b["all"]))["out"]
        return F.flatten(F.zip_with(each, bases, lambda b, base: F.transform(b["out"], lambda x: combine(x, base))))

    return _let(_let(values, blocks), joined)


def _luhn(digits: Column) -> Column:
    """Whether a text of digits passes Luhn's check."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _mod97(text: Column) -> Column:
    """Whether an IBAN without blanks has remainder 1."""
    turned = F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 4))

    def add(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _confirmed(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.rlike(found, F.lit(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
    if kind == "card":
        return _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        plain = F.replace(found, F.lit(" "), F.lit(""))
        return F.length(plain).between(15, 34) & _mod97(plain)
    return ~F.rlike(found, F.lit("^(?:000|666|9)|-00-|-0000$"))


def _kind_spans(text: Column, kind: str) -> Column:
    """Spans of one kind in a text: start, rank of the kind, kind, end (exclusive), score; in code points."""
    rank = KINDS.index(kind)
    cut = F.struct(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)).alias("found"), F.split(text, PATTERNS[kind], -1).alias("pieces"))

    def parts(c: Column) -> Column:
        n = F.size(c["found"])
        return F.transform(
            F.arrays_zip(c["found"].alias("found"), F.slice(c["pieces"], F.lit(1), n).alias("before"), F.slice(c["pieces"], F.lit(2), n).alias("after")),
            lambda x: F.struct(
                x["found"].alias("found"),
                F.length(x["before"]).alias("gap"),
                (F.length(x["before"]) + F.length(x["found"])).cast("long").alias("step"),
                F.concat(F.right(x["before"], F.lit(NEAR)), F.lit(" "), F.left(x["after"], F.lit(NEAR))).alias("near"),
            ),
        )

    def span(x: Column, at: Column) -> Column:
        score = F.lit(_START[kind]) + F.when(F.rlike(x["near"], F.lit(_WORDS_FOR[kind])), _FOR).otherwise(0.0)
        score = score + F.when(F.rlike(x["near"], F.lit(_WORDS_AGAINST[kind])), _AGAINST).otherwise(0.0)
        return F.struct(
            (at + x["gap"]).alias("start"),
            F.lit(rank).alias("rank"),
            F.lit(kind).alias("kind"),
            (at + x["step"]).alias("end"),
            F.round(F.least(F.lit(1.0), score), 2).alias("score"),
            _confirmed(kind, x["found"]).alias("good"),
        )

    add = lambda a, b: a + b
    spans = _let(_let(cut, parts), lambda p: F.zip_with(p, _scan(F.transform(p, lambda x: x["step"]), 0, add), span))
    good = F.filter(spans, lambda s: s["good"] & (F.lit(kind in BASE_KINDS) | (s["score"] >= MIN_SCORE)))
    empty = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,score:double,good:boolean>>")
    return F.coalesce(F.when(_HINTS[kind](text), good), empty)


def find_spans(docs: DataFrame, name: str = "pii_spans") -> DataFrame:
    """``docs`` (``text``) with ``pii_spans`` (or another ``name``): all reported spans by start, then kind in the order of ``KINDS``.

    Each span is a struct of start, rank, kind, end (exclusive), score and good; positions are code points.
    Null and empty texts have none; other columns and repeated rows stay (a column of that name is replaced).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn(name, F.array_sort(F.concat(*[_kind_spans(text, k) for k in KINDS])))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 (of the base spans as text), spans (all of them as text) and their scores.

    Null and empty texts have no spans (counts 0, empty texts, the hash of an empty text); null doc_ids and
    repeated rows stay; an empty table gives no rows.
    """
    found = find_spans(docs.select("doc_id", "text")).select("doc_id", "pii_spans")
    count = lambda kind: F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii_spans", lambda s: s["rank"] < len(BASE_KINDS))
    scores = F.array_join(F.transform("pii_spans", lambda s: s["score"].cast("string")), ",")
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("pii_spans")).alias("spans"), scores.alias("scores"))


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by its kind in square brackets; same columns.

    Of overlapping spans the first takes the place of all.  Null texts stay null, null doc_ids and repeated rows
    stay, an empty table gives no rows.  An n_chars column is set to the new length.  The text is put together
    from pieces of bounded length, so many spans in one long text cost no more each than few.
    """
    spans = free_name(docs, "pii_spans")
    found, any_ = find_spans(docs, spans), F.size(spans) > 0
    text = F.col("text")

    def between(pieces: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / _PIECE).cast("int")
        some = F.array_join(F.slice(pieces, first + 1, F.floor(end / _PIECE).cast("int") - first + 1), "")
        return F.substring(some, (start - first * _PIECE + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))

    def rebuilt(c: Column) -> Column:
        ends = F.transform(c["spans"], lambda s: s["end"])
        seen = _scan(ends, 0, lambda a, b: F.greatest(a, b))
        one = lambda s, at: F.when(s["start"] >= at, F.concat(between(c["pieces"], at, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
        # The last piece may be empty, so that a cut can end where the text does.
        return F.concat(F.array_join(F.zip_with(c["spans"], seen, one), ""), between(c["pieces"], F.array_max(ends), F.length(text).cast("long")))

    cut = F.struct(F.col(spans).alias("spans"), F.concat(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)), F.array(F.lit(""))).alias("pieces"))
    changed = found.withColumn("text", F.when(any_, _let(cut, rebuilt)).otherwise(text))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = changed.withColumn("n_chars", F.when(any_, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return changed.select(*own_columns(docs))
