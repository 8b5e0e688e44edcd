"""Page text: against a deduction written out plainly with the standard library's parser, and the rules for what a page marks."""

import random
import time
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest

from gaitprint.llm import page_text

PAGES = "page_id long, url string, html string"


class Plain(HTMLParser):
    """Blocks of a well-formed page as (path, text); a path's steps are (name, class, place among bare divisions)."""

    def __init__(self, page):
        super().__init__()
        self.path, self.places, self.blocks, self.tags, self.links, self.in_link = [], [Counter()], [], Counter(), {}, False
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.in_link = True
            return
        names, place = dict(attrs).get("class", ""), 1
        if tag in ("div", "section") and not names:
            self.places[-1][tag] += 1
            place = self.places[-1][tag]
        self.path.append((tag, names, place))
        self.places.append(Counter())
        self.tags[tuple(self.path)] += 1

    def handle_endtag(self, tag):
        if tag == "a":
            self.in_link = False
            return
        assert self.path.pop()[0] == tag
        self.places.pop()

    def handle_data(self, data):
        if data.strip():
            self.blocks.append((tuple(self.path), data.strip()))
            self.links[self.blocks[-1]] = self.in_link


def deduced(pages):
    """(article path or None, fixed texts) of a host's distinct pages that mark nothing, by the definition: occurrence vectors written out."""
    parsed = list({tuple(p.blocks): p for p in map(Plain, pages)}.values())
    vectors = defaultdict(list)
    tokens = {t for p in parsed for t in (*p.tags, *p.blocks)}
    for t in tokens:
        vectors[tuple(p.tags[t] if t in p.tags else p.blocks.count(t) for p in parsed)].append(t)
    enough = [v for v in vectors if (n := sum(x > 0 for x in v)) >= 3 and 2 * n >= len(parsed)]
    valid = {t for v in enough if len(vectors[v]) >= 2 for t in vectors[v]}
    common = {t for v in enough for t in vectors[v]}
    fixed = {t for t in valid if isinstance(t[-1], str)}
    varied = lambda path: sum(len(t[1]) for p in parsed for t in p.blocks if t[0][: len(path)] == path and t not in fixed and not p.links[t])
    paths = [t for t in common if not isinstance(t[-1], str)]
    heads = [t for t in paths if t[-1][0] in ("h1", "h2", "h3") and varied(t)]
    level = min((t[-1][0] for t in heads), default="")
    title = lambda path: sum(varied(t) for t in heads if t[-1][0] == level and t[: len(path)] == path)
    at, article = (), None
    while True:
        into = [t for t in paths if len(t) == len(at) + 1 and t[: len(at)] == at and t[-1][0] in ("html", "body", "div", "section") and 2 * varied(t) > varied(at) and title(t) == title(at)]
        if not into:
            return article, fixed
        at = into[0]
        article = at if at in valid else article


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n))


def site(rng, host, n):
    """Pages of one host in bare divisions without a telling tag or class: an article each, between texts that vary as well and with lines that all, most or few share."""
    shared = [f"Line {x} of {host} says so." for x in "abcdef"]
    pages = []
    for i in range(n):
        lines = [f"<p>{x}</p>" for k, x in enumerate(shared) if rng.random() < (1, 1, 0.7, 0.7, 0.3, 0.1)[k]]
        body = "".join(f"<p>{words(rng, rng.randint(15, 40))}</p>" for _ in range(rng.randint(2, 4)))
        links = "".join(f"<li><a href='/x'>{words(rng, 1)}</a></li>" for _ in range(5))
        pages.append((i, f"https://{host}/{i}", f"<html><body><div><ul>{links}</ul></div><div><p>{words(rng, 4)}</p></div><div><h1>{words(rng, 3)}</h1>{body}{''.join(lines)}</div><div><p>{words(rng, 3)}</p></div></body></html>"))
    return pages


def test_results_are_what_a_plain_deduction_gives(spark):
    rng = random.Random(21)
    hosts = {f"h{k}.example": site(rng, f"h{k}.example", n) for k, n in enumerate((3, 8, 40))}
    pages = [(1000 * k + i, url, html) for k, rows in enumerate(hosts.values()) for i, url, html in rows]
    odd = [(9000, None, "<p>x"), (9001, "http://h1.example/e", None), (9002, "http://one.example/e", "")]
    table = spark.createDataFrame(pages + odd + pages[-3:], PAGES)
    known = {r["host"]: r for r in page_text.templates(table).collect()}
    assert all(known[h]["article"] for h in hosts)
    got = Counter((r["page_id"], r["text"]) for r in page_text.extract(table).collect())
    wanted, whole = Counter(), 0
    for k, (host, rows) in enumerate(hosts.items()):
        article, fixed = deduced([html for _, _, html in rows])
        assert article[-1] == ("div", "", 3) and len(fixed) == len(known[host]["texts"])
        for i, _, html in rows:
            text = "\n\n".join(t for path, t in Plain(html).blocks if path[: len(article)] == article and (path, t) not in fixed)
            wanted[1000 * k + i, text] += 1 + ((1000 * k + i, host) in [(p[0], "h2.example") for p in pages[-3:]])
            whole += page_text.main_text(html) != text
    assert got == wanted + Counter([(9000, "x"), (9001, ""), (9002, "")])
    assert whole > 40  # an empty template gives something else


def host_of(pages, spark):
    rows = [(i, f"http://s.example/{i}", html) for i, html in enumerate(pages)]
    return [r["text"] for r in sorted(page_text.extract(spark.createDataFrame(rows, PAGES)).collect(), key=lambda r: r["page_id"])]


def test_facts_headings_and_comments(spark):
    # Facts that differ in numbers only are no template, and headings that articles share stay with what they head.
    facts = [f"<body><article><h1>Town {c}</h1><p>Population: {2017 + i} people</p><p>Area: {7 + i} km</p><h2>History</h2><p>Old {c * 40}.</p><h2>More</h2><p>Share this page.</p></article></body>" for i, c in enumerate("abcdef")]
    assert host_of(facts, spark)[1] == "Town b\n\nPopulation: 2018 people\n\nArea: 8 km\n\nHistory\n\nOld " + "b" * 40 + "."
    # An article of any length isn't joined by unmarked text around it, on a host with or without a template.
    for size in (30, 799, 801, 9000):
        pages = [f"<body><article><p>{c * 100}</p></article><div><p>{c.upper() * size}</p></div></body>" for c in "abcdef"]
        assert host_of(pages, spark) == [c * 100 for c in "abcdef"] and page_text.main_text(pages[0]) == "a" * 100
    # A list of links inside the article's slot is a slot of its own; links in sentences stay.
    linked = [f"<body><div class=x><h1>T {c}</h1><p>{c * 60} <a href=/>see {c}</a></p><ul class=y><li><a href=/>{c} 1</a></li><li><a href=/>{c} 2</a></li></ul></div></body>" for c in "abcdef"]
    assert host_of(linked, spark)[0] == "T a\n\n" + "a" * 60 + " see a"


def test_a_template_that_nests_nowhere_and_ties():
    assert page_text.resolved([]) == page_text.Template()
    lost = [(5, page_text.CONTAINER, 4, True, 100, 0), (6, page_text.TEXT, 5, True, 10, 0)]
    assert page_text.resolved(lost) == page_text.Template(0, frozenset(), frozenset([6]))
    halves = [(1, page_text.CONTAINER, 0, True, 50, 0), (2, page_text.CONTAINER, 0, True, 50, 0)]
    assert page_text.resolved(halves).article == 0  # none of two equal parts has most of the text


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "</p>" * 50_000, "<body>" * 50_000 + "x", "<form>" + "<div>" * 50_000 + "<main></main>" * 50_000, "<p></div>" * 50_000])
def test_time_is_linear(page):
    start = time.monotonic()
    page_text.parse(page)
    assert time.monotonic() - start < 10


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("İ <SCRIPT>var x</SCRIPT><p>after it", "İ\n\nafter it"),
        ("<article><div class='share-price'><p>Body</p></div><div class='share-bar'>no</div><div id=adSlot>no</div></article>", "Body"),
        ("<article class='promo'><p>All</p></article><nav>no</nav>", "All"),
        ("<form><nav>n</nav><main><p>Body</p><form>x</form></main></form>", "Body"),
        ("<article><p>T</p><section id=comments><article><p>reader</p></article></section><aside><article>q</article></aside></article>", "T"),
        ("<p>a &lt;b&gt; &amp;amp; \n\t c&nbsp;d</p>", "a <b> &amp; c d"),
        (None, ""),
        ("", ""),
        ("<p>" + "long text " * 50_000 + "</p>", ("long text " * 50_000).strip()),
        ("<div>" * 3000 + "deep", "deep"),
    ],
)
def test_marks(html, text):
    assert page_text.main_text(html or "") == text


def test_ties_repeats_nulls_and_clashing_columns(spark):
    pages = [(1, "http://a.b/1", "<div>same size</div><section>size same</section>", "x", 1), (1, "http://a.b/1", "<div>same size</div><section>size same</section>", "x", 1), (None, None, None, "y", 2), (None, "http://a.b/2", "<p>Null id</p>", None, None)]
    table = spark.createDataFrame(pages, PAGES + ", text string, n_chars int")
    got = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in page_text.extract(table).collect()), key=repr)
    assert got == sorted([(1, "http://a.b/1", "same size", 9)] * 2 + [(None, None, "", 0), (None, "http://a.b/2", "Null id", 7)], key=repr)
