"""Main text of web pages by wrapper induction over pages of one host.

A bounded sample of each host's pages (SAMPLE of them, those with the smallest hashes in as many hash classes) is parsed
to outlines and aligned by simple tree matching. Aligned nodes that hold the same text on every sampled page become
template, those that vary are slots. The content is the deepest region with more than HEAVY of the text in slots that is
not in links, whatever its elements and classes are called; only where that region holds an article or main, or there is
none, names count too. That is a host's wrapper: the region's path and the template nodes inside it, each known by its path and its
text, so that other nodes of the same path stay. The sample only proposes template: what is not met on every page of the
host that has its path is struck out. Every page is then cut by the
wrapper of its host; where its path is missing or holds less of the page's own text than a region must, or the host has
one page or outlines that were cut, the region is found on the page itself.

Inside an article, plain text blocks (no class, id or role) are always content, even if every page has them: pages of a
host may repeat an article. Furniture is told by element (nav, footer, form ...), role or class words; class words never
make furniture of html, body, main, h1, an article (unless in another one) or what holds one of main, h1 and article.

Defined cases: null, empty and text-less pages give an empty text; a null url is a host of its own; repeated rows are
all extracted; pages keep all of their blocks, however long; columns beyond those named are not read; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import html as _html
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

#: Pages of a host that are aligned, and nodes and depth of an outline at most; a host of longer ones has no region.
SAMPLE = 6
MAX_NODES = 1500
MAX_DEPTH = 60
#: Shares of the text that varies: a region that is an article or main has more than the first, any other more than the second.
NAMED, HEAVY = 0.3, 0.75
#: A table of wrappers up to this size is broadcast; a larger one is joined by host.
BROADCAST_BYTES = 64 << 20

#: Elements of HTML by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noframes xmp".split())
FURNITURE = frozenset("script style noscript template textarea title iframe noframes head nav footer aside form button select svg canvas object audio video dialog menu".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup promo promotion related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget".split()
)

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: A path into an article or main.
_NAMED = re.compile(r"(^|>)(article|main)\b|:main")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")


class Node:
    __slots__ = ("tag", "label", "plain", "furniture", "hinted", "kids", "parent")

    def __init__(self, tag: str, attrs: str, parent: "Node | None"):
        self.tag, self.parent, self.kids = tag, parent, []
        self.label, self.plain, self.hinted = tag, True, False
        self.furniture = tag in FURNITURE
        if attrs and "=" in attrs or attrs and "hidden" in attrs:
            found = {m[1].lower(): _html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)}
            names = " ".join(found.get(k, "") for k in ("class", "id")).strip()
            role = found.get("role", "").lower()
            if names or role:
                self.plain = False
                self.label = f"{tag}.{'.'.join(sorted(_SPLIT.sub(' ', names.lower()).split()))}:{role}"
                self.hinted = not HINTS.isdisjoint(_SPLIT.split(names.lower()))
                self.furniture |= role in ROLES
            if "hidden" in found or found.get("aria-hidden") == "true":
                self.furniture = True

    def text(self) -> str:
        out: list[str] = []
        stack = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack.extend(reversed(x.kids))
        return "".join(out)


def unhint(node: Node) -> None:
    """Class words count neither for elements of main text nor for those above; inside an article, parts of it may be articles."""
    if node.tag in ("html", "body"):
        node.hinted = False
    if node.tag not in ("article", "main", "h1") and not node.label.endswith(":main"):
        return
    above = [node]
    while above[-1].parent is not None and not above[-1].furniture:
        above.append(above[-1].parent)
        if above[-1].tag == "article":
            return  # it has done so for those above
    for x in above:
        x.hinted = False


def parse(source: str) -> Node:
    """A DOM of elements and decoded texts. Unclosed and misnested elements are closed where HTML would, roughly."""
    root = top = Node("#", "", None)
    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if m is None:
            top.kids.append(_html.unescape(source[at:]))
            break
        if m.start() > at:
            top.kids.append(_html.unescape(source[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            x = top
            while x is not None and x.tag != tag:
                # an inline end tag does not close a block
                x = None if tag in INLINE and x.tag not in INLINE else x.parent
            if x is not None and x.parent is not None:
                top = x.parent
            continue
        if tag in CLOSES_P:
            x = top
            while x.tag in INLINE and x.parent is not None:
                x = x.parent
            if x.tag == "p":
                top = x.parent
        if tag in ("li", "dd", "dt", "option", "tr", "td", "th"):
            same = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}[tag]
            stop = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "option": ("select",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",)}[tag]
            x = top
            while x.parent is not None and x.tag not in stop and x.tag not in same:
                x = x.parent
            while x.tag in same:
                top = x = x.parent
        node = Node(tag, m[3], top)
        top.kids.append(node)
        unhint(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*[^>]*(?:>|$)", re.I).search(source, at)
            node.kids.append(source[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not m[3].endswith("/"):
            top = node
    return root


def _has(node: Node, tag: str) -> bool:
    stack = [node]
    while stack:
        x = stack.pop()
        if not isinstance(x, str):
            if x.tag == tag:
                return True
            stack.extend(x.kids)
    return False


def dropped(node: Node, inside: bool) -> bool:
    """Furniture. Inside an article, a header or hinted element that has the headline stays."""
    if node.furniture:
        return True
    if node.hinted or node.tag == "header":
        return not (inside and node.tag not in ("body", "html") and _has(node, "h1"))
    return False


def blocks(region: Node, inside: bool, template: dict[str, set[str]] = {}) -> list[str]:
    """Text blocks of a region, without furniture and template: for paths from the root, the keys of nodes that are dropped."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join("".join(run).split())
        if text:
            out.append(text)
        run.clear()

    stack: list = [(region, path_of(region), inside, False)]
    while stack:
        x, path, within, leaving = stack.pop()
        if isinstance(x, str):
            run.append(x)
            continue
        if leaving:
            flush()
            continue
        if x is not region:
            if dropped(x, within) or path in template and not (x.plain and within) and key(x) in template[path]:
                flush()
                continue
            within = within or x.tag in ("article", "main")
        if x.tag == "br":
            run.append(" ")
        if x.tag not in INLINE:
            flush()
            stack.append((x, path, within, True))
        for k in reversed(x.kids):
            stack.append((k, path if isinstance(k, str) else f"{path}>{k.label}", within, False))
    flush()
    return out


def path_of(node: Node) -> str:
    labels = []
    while node is not None:
        labels.append(node.label)
        node = node.parent
    return ">".join(reversed(labels))


def key(node: Node) -> str:
    """Hash of the text of a node."""
    return hashlib.blake2b("\n".join(blocks(node, True)).encode("utf-8", "replace"), digest_size=12).hexdigest()


def seen(root: Node, paths: set[str]) -> dict[str, set[str]]:
    """Of those paths that a page has: the keys of all nodes there."""
    above = {p[: m.start()] for p in paths for m in re.finditer(">", p)}
    found: dict[str, set[str]] = {}
    stack = [(root, root.label)]
    while stack:
        x, path = stack.pop()
        if path in paths:
            found.setdefault(path, set()).add(key(x))
        if path in above:
            stack.extend((k, f"{path}>{k.label}") for k in x.kids if not isinstance(k, str))
    return found


def _by_path(nodes: list) -> dict[str, set[str]]:
    out: dict[str, set[str]] = {}
    for path, k in nodes:
        out.setdefault(path, set()).add(k)
    return out


def _walk(root: Node):
    """Elements that are not furniture, in order, with their paths."""
    stack = [(root, root.label)]
    while stack:
        x, path = stack.pop()
        yield x, path
        stack.extend((k, f"{path}>{k.label}") for k in reversed(x.kids) if not isinstance(k, str) and not dropped(k, False))


def _mass(node: Node) -> int:
    """Characters of text below that are neither furniture nor links."""
    total, stack = 0, [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            total += len(x.strip())
        elif x is node or not dropped(x, False) and x.tag != "a":
            stack.extend(x.kids)
    return total


def _own_mass(top: Node, known: dict[str, set[str]], without: list[Node]) -> int:
    """Characters below that are neither furniture, links, nodes known by path and key, nor in some other nodes."""
    total, stack = 0, [(top, path_of(top))]
    while stack:
        x, path = stack.pop()
        if isinstance(x, str):
            total += len(x.strip())
        elif x is top or not (dropped(x, False) or x.tag == "a" or x in without or path in known and key(x) in known[path]):
            stack.extend((k, path if isinstance(k, str) else f"{path}>{k.label}") for k in x.kids)
    return total


def own_region(root: Node) -> tuple[list[Node], bool]:
    """The content of a page by itself: its articles, else main, else the smallest element with most of the text."""
    for wanted in (lambda x: x.tag == "article", lambda x: x.tag == "main" or x.label.endswith(":main")):
        found = []
        for x, _ in _walk(root):
            if wanted(x):
                up = x.parent
                while up is not None and up not in found:
                    up = up.parent
                if up is None:
                    found.append(x)
        if any(_mass(x) for x in found):
            return found, True
    best, total = root, _mass(root)
    while True:
        kids = [k for k in best.kids if not isinstance(k, str) and not dropped(k, False) and k.tag not in INLINE]
        heavy = [k for k in kids if _mass(k) > 0.75 * total]
        if not heavy or heavy[0].tag in ("p", "h1", "h2", "li", "pre", "blockquote"):
            return [best], False
        best = heavy[0]


# -- wrapper induction ---------------------------------------------------------------------------------------------


class Slot:
    """A node of an outline: a label, its texts on the pages where it was met, and its children."""

    __slots__ = ("label", "plain", "texts", "kids", "link", "furniture")

    def __init__(self, node: Node, depth: int, budget: list[int]):
        self.label, self.plain, self.link, self.furniture = node.label, node.plain, node.tag == "a", dropped(node, False)
        budget[0] -= not self.furniture
        self.kids: list[Slot] = []
        own = []
        for k in node.kids:
            if isinstance(k, str):
                own.append(k)
            elif k.tag in RAW:
                continue
            elif k.tag in INLINE or self.furniture:
                own.append(k.text())
            elif budget[0] > 0 and depth < MAX_DEPTH:
                # children of one label in a row fold to one slot, which holds what repeats
                s = Slot(k, depth + 1, budget)
                if self.kids and self.kids[-1].label == s.label:
                    self.kids[-1].fold(s)
                else:
                    self.kids.append(s)
            else:
                own.append(k.text())
                budget[0] = -1  # cut
        self.texts = [" ".join("".join(own).split())]

    def fold(self, other: "Slot") -> None:
        self.texts[0] = f"{self.texts[0]} {other.texts[0]}".strip()
        for k in other.kids:
            same = next((m for m in self.kids if m.label == k.label), None)
            if same:
                same.fold(k)
            else:
                self.kids.append(k)


def match(a: Slot, b: Slot, memo: dict) -> int:
    """Simple tree matching: nodes in the largest common top-down, order-keeping tree."""
    if a.label != b.label:
        return 0
    key = (id(a), id(b))
    if key not in memo:
        row = [0] * (len(b.kids) + 1)
        table = [row]
        for x in a.kids:
            new = [0]
            for j, y in enumerate(b.kids):
                new.append(max(new[j], row[j + 1], row[j] + match(x, y, memo)))
            table.append(new)
            row = new
        memo[key] = 1 + row[-1], table
    return memo[key][0]


def align(a: Slot, b: Slot, memo: dict) -> None:
    """Merge b into a along the best match: texts of matched nodes gather, nodes of b alone are added."""
    if match(a, b, memo) == 0:
        return
    a.texts += b.texts
    table = memo[id(a), id(b)][1]
    i, j, pairs, alone = len(a.kids), len(b.kids), [], []
    while i and j:
        m = match(a.kids[i - 1], b.kids[j - 1], memo)
        if m and table[i][j] == table[i - 1][j - 1] + m:
            pairs.append((a.kids[i - 1], b.kids[j - 1]))
            i, j = i - 1, j - 1
        elif table[i][j] == table[i - 1][j]:
            i -= 1
        else:
            alone.append((i, b.kids[j - 1]))
            j -= 1
    alone += [(0, b.kids[k]) for k in reversed(range(j))]
    for x, y in pairs:
        align(x, y, memo)
    for at, y in alone:
        a.kids.insert(at, y)


def induce(pages: list[str]) -> dict:
    """The wrapper of some pages of a host: region, its path, empty if there is none or outlines were cut; path and key of nodes
    that are the same on all pages: template, those below the region (all, if outlines were cut), and outside, the others."""
    roots = [parse(p) for p in pages]
    budgets = [[MAX_NODES] for _ in roots]
    tree, *others = (Slot(r, 0, b) for r, b in zip(roots, budgets))
    for other in others:
        align(tree, other, {})
    whole = all(b[0] >= 0 for b in budgets)
    varying: dict[str, int] = {}  # text of slots that is not in links
    content: dict[str, int] = {}  # nor in furniture
    constant: set[str] = set()

    def visit(s: Slot, path: str, furniture: bool, link: bool) -> tuple[int, int]:
        furniture, link = furniture or s.furniture, link or s.link
        texts = [t for t in s.texts if t]
        same = len(roots) >= 3 and len(s.texts) >= len(roots) and len(set(s.texts)) == 1 and bool(texts)
        mass = 0 if link or same else sum(map(len, texts))
        kids = [visit(k, f"{path}>{k.label}", furniture, link) for k in s.kids]
        if same and not any(k for k, _ in kids):
            constant.add(path)
        got = mass + sum(k for k, _ in kids), (0 if furniture else mass) + sum(k for _, k in kids)
        varying[path], content[path] = varying.get(path, 0) + got[0], content.get(path, 0) + got[1]
        return got

    slots, total = visit(tree, tree.label, False, False)
    region = ""
    for masses, most in ((varying, slots), (content, total)):
        heavy = [p for p, m in masses.items() if m > HEAVY * most and not re.search(r">(p|h\d|li|pre|blockquote)\b[^>]*$", p)]
        region = region or max(heavy, key=len, default="")
    if total and not _NAMED.search(region):
        named = [p for p, m in content.items() if m > NAMED * total and re.search(r"(^|>)(article|main)\b[^>]*$|:main$", p)]
        region = min((p for p in named if not region or p.startswith(region + ">")), key=len, default=region)
    if not whole:
        region = ""
    met = [seen(r, constant if total else set()) for r in roots]
    same = sorted([p, k] for p in met[0] for k in set.intersection(*(m.get(p, set()) for m in met)))
    inner = [x for x in same if not whole or region and x[0].startswith(region + ">")]
    return {"region": region, "template": inner, "outside": [x for x in same if x not in inner]}


def absent(source: str | None, wrapper: dict) -> list[tuple[str, str]]:
    """What a wrapper holds for the same on all pages, but is not so on this one: its path is there with other texts only."""
    nodes = _by_path(wrapper["template"] + wrapper["outside"])
    found = seen(parse(source or ""), set(nodes))
    return [(p, k) for p, met in found.items() for k in nodes[p] - met]


def extract(source: str | None, wrapper: dict | None) -> str:
    """Main text of a page: blocks joined by two line feeds."""
    return cut(source, wrapper)[0]


def cut(source: str | None, wrapper: dict | None) -> tuple[str, bool]:
    """Main text of a page, and whether the wrapper has decided its region."""
    if not source:
        return "", False
    root = parse(source)
    regions: list[Node] = []
    inside = False
    template: dict[str, set[str]] = {}
    if wrapper:
        template = known = _by_path(wrapper["template"] + wrapper.get("outside", []))
        if wrapper["region"]:
            regions = [x for x, path in _walk(root) if path == wrapper["region"]]
            inside = bool(_NAMED.search(wrapper["region"]))
            within = sum(_own_mass(x, known, []) for x in regions)
            # the page has to meet what made the region that of the host
            if not any(_mass(x) for x in regions) or not inside and _has(root, "article"):
                regions = []
            elif within <= (NAMED if inside else HEAVY) * (within + _own_mass(root, known, regions)) and _own_mass(root, known, []):
                regions = []
    decided = bool(regions)
    if not regions:
        regions, inside = own_region(root)
    return "\n\n".join(b for r in regions for b in blocks(r, inside, template)), decided


# -- Spark ---------------------------------------------------------------------------------------------------------


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select("page_id", "url", "html", host.alias("host"))


def wrappers(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """host, wrapper (JSON) of each host that has two pages or more."""
    pages = with_host(pages).withColumn("h", F.xxhash64("page_id", "url"))
    keys = pages.select("host", "h").withColumn("class", F.pmod("h", F.lit(sample)))
    # counts and least hashes are combined before the shuffle, so a large host costs no more than a small one
    chosen = keys.groupBy("host", "class").agg(F.min("h").alias("h"), F.count("*").alias("n")).select("host", "h", "n")
    many = chosen.groupBy("host").agg(F.sum("n").alias("n")).where("n > 1").select("host")
    chosen = stage(chosen.select("host", "h").join(many, "host"), "html-sample")
    if 40 * chosen.count() <= BROADCAST_BYTES:
        chosen = F.broadcast(chosen)
    # of rows that repeat an id and url one page is taken, so that a host has `sample` of them at most
    row = F.struct(F.xxhash64("html").alias("x"), F.coalesce("html", F.lit("")).alias("html"))
    one = pages.join(chosen, ["host", "h"], "left_semi").withColumn("class", F.pmod("h", F.lit(sample))).groupBy("host", "class").agg(F.min(row).alias("m"))
    grouped = one.groupBy("host").agg(F.sort_array(F.collect_set("m.html")).alias("htmls"))

    def run(parts):
        for batch in parts:
            made = [json.dumps(induce(x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["host", "wrapper"])

    return grouped.mapInArrow(run, "host string, wrapper string")


def _with_rules(pages: DataFrame, rules: DataFrame, how: str) -> DataFrame:
    size = rules.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("wrapper") + 32), F.lit(0))).first()[0]
    return with_host(pages).join(F.broadcast(rules) if size <= BROADCAST_BYTES else rules, "host", how)


def verified(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The wrappers without what is not the same on all pages of the host."""

    def look(parts):
        known: dict = {}
        for batch in parts:
            out = []
            for host, source, rule in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                if host not in known:
                    if len(known) > 5000:
                        known = {}
                    known[host] = json.loads(rule)
                w = known[host]
                # each is told once
                if w["template"] or w["outside"]:
                    for node in absent(source.as_py(), w):
                        out.append((host, *node))
                        for part in ("template", "outside"):
                            w[part] = [x for x in w[part] if tuple(x) != node]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in (zip(*out) if out else ((), (), ()))], names=["host", "path", "node"])

    def strike(parts):
        for batch in parts:
            made = []
            for rule, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                w, gone = json.loads(rule), {(x["path"], x["node"]) for x in gone or ()}
                made.append(json.dumps(w | {part: [x for x in w[part] if tuple(x) not in gone] for part in ("template", "outside")}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["host", "wrapper"])

    some = rules.where(~F.col("wrapper").endswith('"template": [], "outside": []}'))
    gone = _with_rules(pages, some, "inner").select("host", "html", "wrapper").mapInArrow(look, "host string, path string, node string")
    gone = stage(gone.groupBy("host").agg(F.collect_set(F.struct("path", "node")).alias("gone")), "html-varying")
    return rules.join(gone, "host", "left").select("host", "wrapper", "gone").mapInArrow(strike, "host string, wrapper string")


def extract_text(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text of every page, and by_wrapper: whether the region is that of the host's wrapper."""
    rules = stage(verified(pages, stage(wrappers(pages, sample), "html-wrappers")), "html-verified")
    joined = _with_rules(pages, rules, "left").select("page_id", "url", "html", "wrapper")

    def run(parts):
        known: dict = {None: None}
        for batch in parts:
            texts, decided = [], []
            for source, rule in zip(batch.column(2), batch.column(3).to_pylist()):
                if rule not in known:
                    if len(known) > 5000:
                        known = {None: None}
                    known[rule] = json.loads(rule)
                text, by = cut(source.as_py(), known[rule])
                texts.append(text)
                decided.append(by)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(decided, pa.bool_())], names=["page_id", "url", "text", "by_wrapper"])

    return joined.mapInArrow(run, "page_id long, url string, text string, by_wrapper boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "by_wrapper")
