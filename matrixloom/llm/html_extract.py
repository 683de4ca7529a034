"""Main text of web pages by consensus host paths.

Every page's containers are scored by the text of the blocks in them, and the page votes for the path of
its best one: the tags and classes from the root, digits generalised. Spark adds the votes up per host.
Each page is then read again with its host's winning path; a page without that path takes its own
best container.

Inside the container, elements that never hold an article's text go, and parts whose names say so
("site-nav"). Names that only hint at it ("notice-period", "social-science") are put to the host's votes
too: such a path goes if its text is mostly the same on the host's pages or mostly links.
"""

from __future__ import annotations

import html as entities
import re
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, parts, table

#: Paths of hosts that are broadcast (some 100 bytes each, 20 MB at most); more are joined.
BROADCAST_PATHS = 50_000
#: Longer paths go on as a hash of their text.
PATH_CHARS = 400

# Element classes of HTML (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
HEAD_ONLY = frozenset("base basefont bgsound link meta noscript script style template title head html".split())
CONTAINERS = frozenset("article body center div main section td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that never hold the article's text.
DROPPED = frozenset("aside button canvas dialog footer form head iframe input menu nav noembed noframes noscript object option script select style svg template textarea title xmp".split())
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Words that may stand beside those in the name of such a part (fixed values); other words leave it to the host's votes.
PART_WORDS = frozenset(
    "a area article bar block body bottom box btn button buttons c column container content desktop drawer element first fixed floating form global group header holder icons inline inner item items js l last layer "
    "left level line link links list main mobile module n number outer overlay page panel placeholder posts primary r region right row s secondary section signup site slot small sticky strip tabs text the thread top unit wrap wrapper zone".split()
)
#: Words that mark a part whatever stands beside them: adverts and reader comments.
ALWAYS_WORDS = frozenset("ad ads adv advert advertisement advertising adverts comment comments disqus promo promoted promotion replies reply respond sponsor sponsored".split())
#: A path that names hint at goes if so much of its text is links, or if its different texts are at most this share of its pages.
LINKED, DIFFERENT = 0.5, 0.5
#: A part that words mark is kept if it holds so much of the page's text, or more article text than is outside such parts.
MOST = 0.8
#: Words of a class or id that mark such parts.
DROPPED_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adverts banner breadcrumb breadcrumbs byline-social comment comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation "
    "newsletter notice notices notification pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar sidebars skip social sponsor sponsored subscribe subscription teaser toolbar widget widgets".split()
)
IMPLIED_END = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
#: An implied end does not reach beyond these.
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}

TOKEN = re.compile(r"<!--(?:-?>|.*?--!?>|.*\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=|[\"'])*+)>", re.S)
ATTR = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
WORDS = re.compile(r"[a-z]+")
NUMBER = re.compile(r"[0-9]+")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I | re.A) for t in RAW}
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] for m in ATTR.finditer(text)} if "=" in text else {}


def _drops(tag: str, attrs: dict[str, str]) -> bool:
    return tag in DROPPED or attrs.get("role", "").lower() in DROPPED_ROLES or attrs.get("aria-hidden") == "true"


def _marked(attrs: dict[str, str], first: bool = False) -> int:
    """2 if a name among class and id is a dropped part's, 1 if one hints at it; with `first`, 2 for any whose first word does."""
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    if names == " ":
        return 0
    found = 0
    for name in CAMEL.sub(" ", names).lower().split() if first else names.split():
        words = WORDS.findall(CAMEL.sub(" ", name).lower())
        if first:
            words = words[:1]
        if not DROPPED_WORDS.isdisjoint(words):
            sure = first or not ALWAYS_WORDS.isdisjoint(words) or all(w in DROPPED_WORDS or w in PART_WORDS for w in words)
            found = max(found, 1 + sure)
    return found


class Doubt:
    """A part marked by words, or the page outside such parts: its text, and that in articles; path if words only hint at it."""

    __slots__ = ("around", "chars", "articles", "linked", "digest", "kept", "path")

    def __init__(self, around: Doubt | None, path: str | None = None):
        self.around, self.chars, self.articles, self.linked, self.digest, self.kept, self.path = around, 0, 0, 0, 0, False, path


class Node:
    """A container and its link to the one around it; inner ones have larger numbers."""

    __slots__ = ("number", "path", "around")

    def __init__(self, number: int, path: str, around: Node | None):
        self.number, self.path, self.around = number, path, around


class Block:
    __slots__ = ("text", "node", "linked", "doubt")

    def __init__(self, text: str, node: Node | None, linked: int, doubt: Doubt | None):
        self.text, self.node, self.linked, self.doubt = text, node, linked, doubt


def _path(around: str, tag: str, attrs: dict[str, str]) -> str:
    label = ".".join([tag, *sorted(NUMBER.sub("N", c) for c in attrs.get("class", "").split())])
    path = f"{around}>{label}" if around else label
    return path if len(path) <= PATH_CHARS else "#" + xxhash.xxh3_128_hexdigest(path)


def blocks_of(html: str | None, marks: bool = True, gone: frozenset[str] = frozenset(), hinted: list | None = None) -> list[Block]:
    """Text blocks outside dropped parts, in page order; node is the innermost container around. Without marks, words drop nothing.

    gone: paths that names hint at and the host dropped. hinted: gets (path, characters, of links, digest of the text) of the parts that names hint at.
    """
    out: list[Block] = []
    stack: list[tuple[str, str, Node | None, bool, bool, Doubt | None, bool]] = []  # tag, path, container, dropped, in an article, marked part, in its article
    top = ("", "", None, False, False, None, False)
    page, doubts, marked_any = Doubt(None), [], False
    open_at: dict[str, list[int]] = {}  # places of a tag's open elements
    blocks_at: list[int] = []  # places of open elements that are no inline ones
    parts: list[str] = []
    linked = node = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                _, _, container, _, _, part, within = stack[-1] if stack else top
                out.append(Block(text, container, linked, part))
                part = part or page
                part.chars += len(text)
                part.linked += linked
                part.digest = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), part.digest)
                part.articles += len(text) * within
            parts.clear()
            linked = 0

    def pop() -> str:
        tag = stack.pop()[0]
        open_at[tag].pop()
        if blocks_at and blocks_at[-1] == len(stack):
            blocks_at.pop()
        return tag

    def add(raw: str, decode: bool = True) -> None:
        nonlocal linked
        if raw and not (stack and stack[-1][3]):
            text = entities.unescape(raw) if decode and "&" in raw else raw
            parts.append(text)
            if open_at.get("a"):
                linked += len(text.strip())

    html = html or ""
    at, search = 0, TOKEN.search
    while m := search(html, at):
        add(html[at : m.start()])
        at = m.end()
        if not m["tag"]:
            if m["cdata"] is not None:
                add(m["cdata"], False)
            continue
        tag = m["tag"].lower()
        inline = tag in INLINE
        if m["end"]:
            if open_at.get(tag):
                if not inline:
                    flush()
                depth = open_at[tag][-1]
                # an inline end does not close the blocks inside it
                if not inline or not blocks_at or blocks_at[-1] < depth:
                    while len(stack) > depth:
                        pop()
            elif tag in ("br", "p"):
                add(" ")
            continue
        if open_at.get("head") and tag not in HEAD_ONLY:
            while pop() != "head":
                pass
        if not inline:
            flush()
            if tag in CLOSES_P and open_at.get("p"):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        while len(stack) > i:
                            pop()
                        break
                    if stack[i][0] not in INLINE:
                        break
            if tag in IMPLIED_END:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in IMPLIED_END[tag]:
                        while len(stack) > i:
                            pop()
                        break_at = tag in ("li", "dt", "dd", "option")
                        if break_at:
                            break
                        continue
                    if i < len(stack) and stack[i][0] in SCOPES[tag]:
                        break
        if tag in VOID:
            if tag == "br":
                add(" ")
            continue
        attrs = _attributes(m["attrs"])
        _, path, around, dropped, inside, doubt, within = stack[-1] if stack else top
        inside = inside or tag in ("article", "main")
        # a page's header goes; one inside the article keeps its headings only
        if not dropped:
            dropped = _drops(tag, attrs) or tag == "header" and not inside
            if tag in ("article", "main"):
                within = within or doubt is None or not _marked(attrs, True)
            elif marks and not dropped and tag not in ("body", "html") and (sure := _marked(attrs)):
                own = None if sure == 2 else _path(path, tag, attrs)
                if inline:
                    dropped = sure == 2
                    marked_any = marked_any or dropped
                elif own is None or own in gone or hinted is not None:
                    marked_any = True
                    doubt, within = Doubt(doubt, None if own in gone else own), within and own is not None and own not in gone
                    doubts.append(doubt)
        elif tag in HEADINGS and any(s[0] == "header" and s[4] and s[3] for s in stack) and not any(s[3] and s[0] != "header" for s in stack):
            dropped = False
        if tag == "header" and inside:
            dropped = True
        if tag in CONTAINERS or tag in ("html", "table", "tr", "ul", "ol"):
            path = _path(path, tag, attrs)
            if tag in CONTAINERS:
                node += 1
                around = Node(node, path, around)
        stack.append((tag, path, around, dropped, inside, doubt, within))
        open_at.setdefault(tag, []).append(len(stack) - 1)
        if not inline:
            blocks_at.append(len(stack) - 1)
        if tag in RAW and m["attrs"][-1:] != "/":
            end = RAW_END[tag].search(html, at)
            at = end.start() if end else len(html)
    add(html[at:])
    flush()
    if not marked_any:
        return out
    total = page.chars + sum(d.chars for d in doubts)
    if hinted is not None:  # each with its own text, without that of inner ones
        hinted += [(d.path, d.chars, d.linked, d.digest) for d in doubts if d.path is not None and d.chars]
    for d in reversed(doubts):  # inner ones first
        d.kept = d.path is not None or d.articles > page.articles or 0 < MOST * total <= d.chars
        if d.kept and d.around:
            d.around.chars += d.chars
            d.around.articles += d.articles
    for d in doubts:
        d.kept = d.kept and (d.around is None or d.around.kept)
    return [b for b in out if b.doubt is None or b.doubt.kept] or blocks_of(html, False)


def best_path(blocks: list[Block]) -> tuple[str, float] | None:
    """The path of the container with the best score: text of its own blocks, a share of its inner containers'."""
    shares: dict[int, float] = {}
    nodes: dict[int, Node] = {}
    for b in blocks:
        if b.node:
            shares[b.node.number] = shares.get(b.node.number, 0.0) + max(0, len(b.text) - 2 * b.linked) + 1
            node = b.node
            while node and node.number not in nodes:
                nodes[node.number] = node
                node = node.around
    if not nodes:
        return None
    scores: dict[int, float] = {}
    for n in sorted(nodes, reverse=True):  # inner containers first, each once
        path, around = nodes[n].path, nodes[n].around
        scores[n] = shares[n] * (1.25 if path.rpartition(">")[2].partition(".")[0] in ("article", "main") else 1.0)
        if around:
            shares[around.number] = shares.get(around.number, 0.0) + 0.6 * shares[n]
    n = max(scores, key=lambda k: (scores[k], -k))
    return nodes[n].path, scores[n]


def _inside(blocks: list[Block], winner: str) -> list[Block]:
    """Blocks with a container of that path around them, at any depth."""
    known: dict[int, bool] = {}

    def within(node: Node | None) -> bool:
        passed = []
        while node and node.number not in known and node.path != winner:
            passed.append(node.number)
            node = node.around
        found = node is not None and (node.path == winner or known[node.number])
        known.update(dict.fromkeys(passed, found))
        return found

    return [b for b in blocks if within(b.node)]


def text_of(blocks: list[Block], winner: str | None) -> str:
    """Blocks in the containers of the winning path, or else of the page's own best path, or else all."""
    inside = _inside(blocks, winner) if winner is not None else []
    if not inside and (own := best_path(blocks)):
        inside = _inside(blocks, own[0])
    return "\n\n".join(b.text for b in inside or blocks)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


VOTES = "host string, path string, hinted boolean, score double, chars long, linked long, digest long"


def _votes(batches):
    for batch in parts(batches):
        rows = []
        for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            hinted, host = [], host_of(url)
            if best := best_path(blocks_of(html, hinted=hinted)):
                rows.append((host, best[0], False, best[1], None, None, None))
            rows += [(host, path, True, None, chars, linked, digest - (1 << 63)) for path, chars, linked, digest in hinted]
        kinds = (pa.string(), pa.string(), pa.bool_(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["host", "path", "hinted", "score", "chars", "linked", "digest"])


def _hosts(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([host_of(u) for u in batch.column(1).to_pylist()], pa.string())], names=["page_id", "url", "html", "host"])


def _texts(batches):
    for batch in parts(batches):
        texts = [text_of(blocks_of(h, gone=frozenset(g or ())), w) for h, w, g in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def _texts_with(winners: dict[str, str], gone: dict[str, list[str]]):
    def run(batches):
        for batch in batches:
            hosts = [host_of(u) for u in batch.column(1).to_pylist()]
            more = [pa.array([winners.get(h) for h in hosts], pa.string()), pa.array([gone.get(h) for h in hosts], pa.list_(pa.string()))]
            yield from _texts([pa.RecordBatch.from_arrays([*batch.columns, *more], names=["page_id", "url", "html", "path", "gone"])])

    return run


def consensus(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, path, hinted): of each host the winning path, by pages, then total score, then name; and the hinted paths to drop."""
    votes = scratch.keep(pages.select("url", "html").mapInArrow(_votes, VOTES), "votes")
    tally = votes.where("not hinted").groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(F.round("score", 3)).alias("score"))
    winners = tally.groupBy("host").agg(F.max_by("path", F.struct("n", "score", "path")).alias("path")).withColumn("hinted", F.lit(False))
    texts = votes.where("hinted").groupBy("host", "path", "digest").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    paths = texts.groupBy("host", "path").agg(F.sum("n").alias("n"), F.count("*").alias("texts"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    same = (F.col("n") > 1) & (F.col("texts") <= DIFFERENT * F.col("n"))
    gone = paths.where(same | (F.col("linked") > LINKED * F.col("chars"))).select("host", "path", F.lit(True).alias("hinted"))
    return scratch.keep(winners.unionByName(gone), "consensus")


def extract(pages: DataFrame, *, broadcast_paths: int = BROADCAST_PATHS) -> DataFrame:
    """page_id, url, text, n_chars: one row per input row.

    Null and empty pages have an empty text. Pages without a usable url vote together, under an empty host;
    repeated rows vote as often as they occur. Broken markup is read as browsers do in the common cases; text
    outside any element is text; pages of any length and depth are read whole. Blocks are joined by blank
    lines. Other columns of `pages` are ignored.
    """
    scratch = Scratch(pages.sparkSession, "html-extract")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    voted = consensus(base, scratch)
    schema = "page_id long, url string, text string, n_chars long"
    few = voted.limit(broadcast_paths + 1).collect()
    if len(few) <= broadcast_paths:
        gone: dict[str, list[str]] = {}
        for r in few:
            if r.hinted:
                gone.setdefault(r.host, []).append(r.path)
        return base.mapInArrow(_texts_with({r.host: r.path for r in few if not r.hinted}, gone), schema)
    of_host = voted.groupBy("host").agg(F.max(F.when(~F.col("hinted"), F.col("path"))).alias("path"), F.collect_list(F.when(F.col("hinted"), F.col("path"))).alias("gone"))
    # written, so that the join's sides are both plain exchanges and Spark can split a hot host's pages
    of_host = scratch.keep(of_host, "hosts")
    with_host = base.mapInArrow(_hosts, "page_id long, url string, html string, host string")
    return with_host.join(of_host, "host", "left").select("page_id", "url", "html", "path", "gone").mapInArrow(_texts, schema)


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op9_html_extract": op9_html_extract}
ORACLE_SQL: dict[str, str] = {}
