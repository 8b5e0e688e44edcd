"""Main text of web pages by equivalence-class template deduction (operator 7).

A page's tokens are its block tags and its texts.  A tag is told apart by its path: the names of the blocks around
it with their classes and ids, and for bare divisions their place among alike siblings.  A text is told apart by its
path and its characters.  A token's occurrence vector says how often it occurs in each page of its host; tokens with
one vector form an equivalence class, and classes of several tokens that most of the host's pages have are valid.
Valid classes nest by their paths into the host's template, a tree of tags with the texts that don't change.

What the template doesn't fix are its slots: a text lies in the slot of the nearest template tag around it.  The host
says what its slots hold: how many of their characters are fixed texts, how many are links, how many vary.  From
the root, the article is the template's one article or main element whose text varies for the most part or, where
there is none, the innermost division that still has most of the varying text and the title (the highest heading that
varies).  A page's main text are the texts in the article's slot and those below it, without fixed texts (but a fixed
heading stays if it heads a text that stays), without slots of which half or more are links, and without blocks that
their own element or names mark as something else.  Marked slots don't count when the article is looked for either.

Where the host has no such article, or the page hasn't it, or another outermost division of the page has more text
than it, the page is read by its own marks: the text of its article or main elements; if they hold no blocks of
their own, or there are none, that of the outermost division with the most text as well; text outside of divisions
keeps the page whole.

Copies of a page are no evidence of a template: pages of a host whose own text is equal (all but marked
parts) count as one page.

Vectors are never built: a token's vector is represented by its page count and a sum of hashes of
(page, count), which partial aggregation adds up, so no task holds a host.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaitprint.llm.common import slices, stage_table

#: Share of a host's distinct pages, and distinct pages at least, that have a valid class; tokens that a class has at least.
SUPPORT, PAGES, CLASS = 0.5, 3, 2
#: A token that every page has.
ANY = -1
#: Pages of a host are spread over so many groups when they meet their template.
SALT = 32
#: What a token is: a text, or a tag by what it can be.  Tags of the last kinds, from ``HEADING + 1`` to ``HEADING + 6``, are headings.
TEXT, TAG, GROUP, CONTAINER, MAIN, ARTICLE, HEADING = 0, 1, 2, 3, 4, 5, 10
#: Added to the kind of a tag that is or lies in something marked as other than the article.
MARKED = 32

_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol option p pre section select"
    " summary svg table tbody td template textarea tfoot th thead title tr ul".split()
)
_RAW = frozenset("script style textarea title noscript iframe template svg xmp".split())
_EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OTHER = frozenset("head nav footer aside form button select menu dialog object".split())
_MAIN = frozenset(("article", "main"))
#: Elements that hold no more than the page itself, and those below them that can be a slot's container.
_PAGE = frozenset(("", "html", "body"))
_CONTAINERS = frozenset(("div", "section", "center"))
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th".split())
#: Kinds of tags: what can hold the article, and what can be a slot of links.
_KINDS = {
    **dict.fromkeys("html body div section center form table tbody tr td".split(), CONTAINER), "main": MAIN, "article": ARTICLE,
    **dict.fromkeys("ul ol menu nav header footer aside".split(), GROUP), **{f"h{i}": HEADING + i for i in range(1, 7)},
}
#: Words that mark a block as something other than the article, where one name of its class, id or role is made of
#: such words and of words about layout alone ("share-bar", but not "share-price").
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer"
    " menu modal nav navbar navigation newsletter notice notices notification pagination popup promo promoted related search share sharing"
    " sidebar signup social sponsor sponsored subscribe toolbar widget masthead contentinfo complementary".split()
)
_LAYOUT = frozenset(
    "area article articles bar blog block bottom box button buttons center column container content form frame global google group icons inner item items"
    " left link links list main media message module outer page panel post posts reader readers right root row section shell site slot space stories story"
    " text thread top unit user users wrap wrapper zone".split()
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Where a raw element ends, whatever the case of its name.
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I | re.A) for name in _RAW}
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")


def _marked(attributes: str) -> bool:
    for _, value in _ATTRIBUTE.findall(attributes):
        for name in value.strip("\"'").split():
            words = [w.lower() for w in _WORDS.findall(name)]
            if not _MARKS.isdisjoint(words) and all(w in _MARKS or w in _LAYOUT for w in words):
                return True
    return False


class Block:
    """A run of text: its token, its container (0 is the page), where it belongs (article, other by its element or by a mark, or neither),
    whether it lies in the host's article and there in a slot of links, whether it is a heading, whether it lies in no block of an article's own, and the text itself."""

    __slots__ = ("bare", "dropped", "heading", "inside", "main", "marked", "other", "slot", "text", "token")

    def __init__(self, token: int, slot: int, top: _Open, text: str):
        self.token, self.slot, self.text = token, slot, text
        self.main, self.other, self.marked, self.inside, self.dropped = top.main, top.other, top.marked, top.inside, top.dropped
        self.bare = top.name in _MAIN
        self.heading = HEADING < _KINDS.get(top.name, 0) <= HEADING + 6


class _Open:
    """An open block: its path, the outermost container it lies in (0: none), its flags, the children it had by path, and the characters in it."""

    __slots__ = ("chars", "dropped", "hard", "inside", "links", "main", "marked", "name", "other", "outer", "path", "seen")

    def __init__(self, name: str, path: int, above: _Open | None = None):
        self.name, self.path, self.seen, self.chars, self.links = name, path, None, 0, 0
        if above is None:
            self.main = self.other = self.hard = self.marked = self.inside = self.dropped = False
            self.outer = None
        else:
            self.main, self.other, self.hard, self.marked, self.inside, self.dropped, self.outer = above.main, above.other, above.hard, above.marked, above.inside, above.dropped, above.outer


@dataclass(frozen=True)
class Template:
    """What a host's pages share: the tag that holds their article (0: the page), tags whose slots are links, and fixed texts."""

    article: int = 0
    slots: frozenset[int] = frozenset()
    texts: frozenset[int] = frozenset()


def _names(attributes: str) -> str:
    """A tag's classes and ids, numbers within them aside."""
    if "=" not in attributes:
        return ""
    return " ".join(sorted(_DIGITS.sub("", v.strip("\"'")) for k, v in _ATTRIBUTE.findall(attributes) if k.lower() != "role"))


def parse(page: str, template: Template = Template()) -> tuple[list[Block], dict[int, list[int]]]:
    """A page's blocks in order, and its tokens: how often each occurs, its kind, the path around it, its characters, and those of them in links.

    Time is linear in the page, however its tags are nested or left open.
    """
    blocks: list[Block] = []
    tokens: dict[int, list[int]] = {}
    stack = [_Open("", 0)]
    opened: Counter = Counter()
    held: list[str] = []
    linked = 0
    link = False
    at, end = 0, len(page)
    quoted = True

    def hold(text: str) -> None:
        nonlocal linked
        held.append(text)
        if link:
            linked += len(text)

    def close_block() -> None:
        nonlocal linked, link
        if held:
            text = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
            held.clear()
            if text:
                top = stack[-1]
                token = xxhash.xxh64_intdigest(text, top.path) >> 1
                links = min(linked, len(text))
                blocks.append(Block(token, top.outer or 0, top, text))
                top.chars += len(text)
                top.links += links
                note(token, TEXT, top.path, len(text), links, 1)
        linked, link = 0, False

    def note(token: int, kind: int, parent: int, chars: int, links: int, times: int) -> None:
        known = tokens.get(token)
        if known is None:
            tokens[token] = [times, kind, parent, chars, links]
        else:
            known[0] += times
            known[3] += chars
            known[4] += links

    def pop() -> None:
        last = stack.pop()
        opened[last.name] -= 1
        known = tokens[last.path]
        known[3] += last.chars
        known[4] += last.links
        stack[-1].chars += last.chars
        stack[-1].links += last.links

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            hold(page[at:])
            break
        if lt > at:
            hold(page[at:lt])
        if page.startswith("<!--", lt):
            close = page.find("-->", lt + 4)
            at = end if close < 0 else close + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            close = page.find(">", lt)
            at = end if close < 0 else close + 1
            continue
        m = _TAG.match(page, lt) if quoted else None
        if m is None:
            m = _NAME.match(page, lt)
            if m is None:
                hold("<")
                at = lt + 1
                continue
            quoted = False  # a quote is left open somewhere: from here on a tag ends at the next >
            close = page.find(">", m.end())
            at = end if close < 0 else close + 1
            closing, name, attributes = m[1], m[2].lower(), page[m.end() : max(m.end(), at - 1)]
        else:
            at = m.end()
            closing, name, attributes = m[1], m[2].lower(), m[3]
        if name in _RAW and not closing:
            if attributes.endswith("/"):
                continue
            close = _RAW_END[name].search(page, at)
            close_block()
            gt = page.find(">", close.start()) if close else -1
            at = end if gt < 0 else gt + 1
            continue
        if name == "br":
            hold(" ")
            continue
        if name == "a":
            link = not closing
            continue
        if name not in _BLOCKS:
            continue
        close_block()
        if closing:
            if opened[name]:
                while stack[-1].name != name:
                    pop()
                pop()
            continue
        if name in _EMPTY:
            continue
        if stack[-1].name in _LEAVES and (name in _LEAVES or stack[-1].name == "p"):
            pop()  # a paragraph or item that was left open ends where the next block begins
        above = stack[-1]
        names = _names(attributes)
        path = xxhash.xxh64_intdigest(name + " " + names if names else name, above.path) >> 1
        if name in _CONTAINERS and not names:
            if above.seen is None:
                above.seen = Counter()
            above.seen[path] += 1
            if (place := above.seen[path]) > 1:
                path = xxhash.xxh64_intdigest(str(place), path) >> 1
        new = _Open(name, path, above)
        if path == template.article:  # the host knows better than marks around its article
            new.inside, new.main, new.other, new.hard, new.marked, new.dropped = True, False, False, False, False, False
        elif path in template.slots:
            new.dropped = True
        if name in _MAIN:
            if new.other and not new.main:  # a form around the whole page is no form of the page
                new.other = new.hard
            new.main = True
        if path != template.article:
            other = name in _OTHER or (name == "header" and not new.main)
            new.other = new.other or other
            new.hard = new.hard or (other and name != "form")
            new.marked = new.marked or (name not in ("html", "body") and _marked(attributes))
        if new.outer is None and name not in _PAGE:
            new.outer = path if name in _CONTAINERS else 0
        note(path, _KINDS.get(name, TAG) + (MARKED if new.other or new.marked else 0), above.path, 0, 0, 1)
        stack.append(new)
        opened[name] += 1
    close_block()
    while len(stack) > 1:
        pop()
    return blocks, tokens


def _by_marks(blocks: list[Block]) -> list[Block]:
    """The main text of a page of which nothing is known but the page."""
    free = [b for b in blocks if not b.other]
    free = [b for b in free if not b.marked] or free  # a page that marks all it has marks nothing
    if any(b.main and not b.bare for b in free):
        return [b for b in free if b.main]
    size: Counter = Counter()
    for b in free:
        if not b.main:
            size[b.slot] += len(b.text)
    whole = not size or 0 in size
    slot = None if whole else max(size.items(), key=lambda x: x[1])[0]
    return [b for b in free if whole or b.main or b.slot == slot]


def _headed(blocks: list[Block], fixed: frozenset[int]) -> list[Block]:
    """``blocks`` without fixed texts; a fixed heading stays where text that isn't fixed comes before the next heading."""
    kept: list[Block] = []
    text = False
    for b in reversed(blocks):
        stays = b.token not in fixed or (b.heading and text)
        if stays:
            kept.append(b)
        text = not b.heading and (text or stays)
    return kept[::-1]


def main_text(page: str | None, template: Template = Template()) -> str:
    """The blocks of a page that hold its main text, joined by empty lines; ``template`` is its host's."""
    blocks, _ = parse(page or "", template)
    article = [b for b in blocks if b.inside and not b.dropped]
    if article:
        free = [b for b in article if not b.other]
        free = _headed([b for b in free if not b.marked] or free, template.texts)
        size = sum(len(b.text) for b in free)
        rest: Counter = Counter()
        for b in blocks:
            if not (b.inside or b.other or b.marked or b.token in template.texts):
                rest[b.slot] += len(b.text)
        if free and (free[0].main or size >= max(rest.values(), default=0)):
            return "\n\n".join(b.text for b in free)
    return "\n\n".join(b.text for b in _headed(_by_marks(blocks), template.texts))


def resolved(tokens: Iterable[tuple[int, int, int, bool, int, int]]) -> Template:
    """The template that a host's common tokens (token, kind, path around it, in a valid class or not, characters, those in links) nest into."""
    tags: dict[int, tuple[int, bool, int, int]] = {0: (CONTAINER, True, 0, 0)}
    below: dict[int, list[int]] = {}
    fixed: Counter = Counter()
    texts = set()
    for token, kind, parent, valid, chars, links in sorted(tokens):
        if kind != TEXT:
            tags[token] = (kind, valid, chars, links)
            below.setdefault(parent, []).append(token)
        elif valid:
            texts.add(token)
            fixed[parent] += max(0, chars - links)
    order = [0]
    for tag in order:  # from the root down, so that backwards it leads up; tags whose path doesn't lead to the root nest nowhere
        order.extend(below.get(tag, ()))
    free: Counter = Counter()
    marked: Counter = Counter()
    for tag in reversed(order):
        kind, _, chars, links = tags[tag]
        for child in below.get(tag, ()):
            fixed[tag] += fixed[child]
            marked[tag] += marked[child]
        if tag == 0:
            chars, links = (sum(tags[c][i] for c in below.get(0, ())) for i in (2, 3))
        varied = max(0, chars - links - fixed[tag])
        if kind & MARKED:
            marked[tag] = varied
        free[tag] = max(0, varied - marked[tag])
    level = min((tags[t][0] for t in order if HEADING < tags[t][0] < MARKED and free[t]), default=0)
    titles: Counter = Counter()
    for tag in reversed(order):
        titles[tag] = free[tag] if tags[tag][0] == level else sum(titles[c] for c in below.get(tag, ()))

    def outermost(kinds: tuple[int, ...], top: int) -> list[int]:
        found, rest = [], list(below.get(top, ()))
        for tag in rest:
            kind, valid, chars, _ = tags[tag]
            if valid and kind in kinds and 2 * free[tag] > chars:
                found.append(tag)
            else:
                rest.extend(below.get(tag, ()))
        return found

    article = 0
    said = outermost((MAIN, ARTICLE), 0)
    if len(said) == 1:
        article = said[0]
        inner = outermost((ARTICLE,), article)
        if tags[article][0] == MAIN and len(inner) == 1 and titles[inner[0]] == titles[article]:
            article = inner[0]
    elif not said:
        at: int | None = 0
        while at is not None:
            at = next((t for t in below.get(at, ()) if tags[t][0] == CONTAINER and 2 * free[t] > free[at] and titles[t] == titles[at]), None)
            if at is not None and tags[at][1]:
                article = at
    if article:
        inside = list(below.get(article, ()))
        for tag in inside:
            inside.extend(below.get(tag, ()))
    else:
        inside = order[1:]
    slots = {t for t in inside if tags[t][1] and tags[t][0] % MARKED in (GROUP, CONTAINER) and 0 < tags[t][2] <= 2 * tags[t][3]}
    return Template(article, frozenset(slots), frozenset(texts))


def host(url: str = "url"):
    """Lower-cased host of a url; null if there is none."""
    return F.lower(F.nullif(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


_TOKEN = pa.struct([("token", pa.int64()), ("n", pa.int32()), ("kind", pa.int32()), ("parent", pa.int64()), ("chars", pa.int64()), ("links", pa.int64())])
_COMMON = "array<struct<token:long,kind:int,parent:long,valid:boolean,chars:long,links:long>>"


def common_tokens(pages: DataFrame) -> DataFrame:
    """host, tokens: the tokens that most of each host's distinct pages have, and whether they are of valid classes (``pages``: url, html).

    A host has at most 1 / SUPPORT times as many common tokens as its pages have tokens on average.
    """
    hosted = pages.select(host().alias("host"), F.col("html").cast("string").alias("html")).where("host IS NOT NULL AND html IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 4 << 20):
            contents, wholes, tokens = [], [], []
            for text in batch.column(1).to_pylist():
                blocks, found = parse(text)
                contents.append(xxhash.xxh64_intdigest(b"".join(b.token.to_bytes(8, "little") for b in blocks if not (b.other or b.marked))) >> 1)
                tokens.append([*((t, *x) for t, x in sorted(found.items())), (ANY, 1, TEXT, 0, 0, 0)])
                wholes.append(xxhash.xxh64_intdigest(repr(tokens[-1])) >> 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(contents, pa.int64()), pa.array(wholes, pa.int64()), pa.array([[dict(zip(_TOKEN.names, t, strict=True)) for t in ts] for ts in tokens], pa.list_(_TOKEN))],
                names=["host", "content", "whole", "tokens"],
            )

    # Pages of a host with equal text of their own are one witness, with the tokens of the one among them whose tokens hash lowest.
    parsed = hosted.mapInArrow(count, "host string, content long, whole long, tokens array<struct<token:long,n:int,kind:int,parent:long,chars:long,links:long>>")
    distinct = parsed.groupBy("host", "content").agg(F.min_by("tokens", "whole").alias("tokens"))
    each = distinct.select("host", "content", F.inline("tokens")).withColumn("place", F.pmod(F.xxhash64("content", "n"), F.lit(1 << 32)))
    vectors = each.groupBy("host", "token").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("place").alias("vector"), F.min("kind").alias("kind"), F.min("parent").alias("parent"), F.sum("chars").alias("chars"), F.sum("links").alias("links")
    )
    often = stage_table(vectors.where(F.col("pages") >= PAGES), "vectors")
    sizes = often.where(F.col("token") == ANY).select("host", F.col("pages").alias("all"))
    common = often.where(F.col("token") != ANY).join(sizes, "host").where(F.col("pages") >= SUPPORT * F.col("all")).drop("all")
    classes = common.groupBy("host", "pages", "vector").agg(F.collect_list(F.struct("token", "kind", "parent", "chars", "links")).alias("members"))
    flagged = classes.select("host", (F.size("members") >= CLASS).alias("valid"), F.inline("members"))
    return flagged.groupBy("host").agg(F.collect_list(F.struct("token", "kind", "parent", "valid", "chars", "links")).alias("tokens"))


def templates(pages: DataFrame) -> DataFrame:
    """host, article, slots, texts: each host's :class:`Template` (``pages``: url, html)."""

    def nest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                t = resolved(tuple(x.values()) for x in batch.column(1)[i].as_py())
                columns = [pa.array([t.article], pa.int64()), pa.array([sorted(t.slots)], pa.list_(pa.int64())), pa.array([sorted(t.texts)], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *columns], names=["host", "article", "slots", "texts"])

    tokens = common_tokens(pages)
    return tokens.mapInArrow(nest, "host string, article long, slots array<long>, texts array<long>")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    text is the main text of the whole page (empty if there is none, or if html is null or empty), n_chars
    its code points.  A page without a host, or of a host of fewer than three distinct pages, has no template and is
    read by its own marks alone.  Repeated rows stay; an empty table gives no rows.
    """
    known = stage_table(templates(pages), "templates")
    every = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).withColumnRenamed("host", "h")
    salted = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host().alias("host"))
    salted = salted.withColumn("s", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int"))
    joined = salted.join(every, (F.col("host") == F.col("h")) & (F.col("s") == F.col("salt")), "left").select("page_id", "url", "html", "host", "article", "slots", "texts")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str | None, Template] = {}
        for batch in slices(batches, "html", 4 << 20):
            texts = []
            for i, (page, name) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if name not in seen:
                    if len(seen) > 256:
                        seen.clear()
                    seen[name] = Template(batch.column(4)[i].as_py() or 0, *(frozenset(batch.column(c)[i].as_py() or ()) for c in (5, 6)))
                texts.append(main_text(page, seen[name]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return joined.mapInArrow(read, "page_id long, url string, text string, n_chars long")
