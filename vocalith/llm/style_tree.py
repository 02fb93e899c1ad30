"""Main text of web pages by a site style tree.

All pages of a host are merged into one tree of style nodes: the path of block elements and their classes from the
body down.  A node's importance has two parts.  Content: the mean, over the texts below the node, of one minus the
entropy of the text's spread over the host's m distinct pages; a text on every page gives 0, one on a single page gives 1.
Presentation: the entropy of the node's child sequences over those pages.  Nodes of low importance are noise, and each
page loses its branches at them.

A host's tree says little if it has few pages: they are weighed against two more that find every node important.  A
page's own markup counts as well: navigation, footers, forms and
the like, by element, role or class, always go; and if a page has an article or main element with text, its text is in
there, and the tree decides on the nodes below that element.  A class or id is such a word if all parts of it are (cookie-notice, not has-sidebar); if
words around the article or main element, or its own, would leave nothing of it, they don't count.

Copies, pages with the same block texts, are one page of the host's tree, and where the tree would leave nothing of a
page it isn't applied.

Trees are built from counts: a batch of pages emits each (node, text) once, Spark adds them up, and only the noisy
nodes of each host return to the pages: by one broadcast set if their number is under a bound, else by a join.

Cases: null or empty html, and pages without text, give the empty string; html that is cut off or badly nested is
read to its end; repeated pages are extracted each on its own; a null url is a host of its own; an empty table gives an
empty result; extra columns pass through.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocalith.llm.common import stored

GAMMA = 0.9
THRESHOLD = 0.3
#: A host's pages are weighed against so many more that find every node important.
PRIOR_PAGES = 2
BROADCAST_ROWS = 1 << 17

#: Quotes mean something only where a value starts; a tag may be cut off by the end of the page.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^<>])*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
NAMED = re.compile(r"class|id|role", re.I)
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "select", "object", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption header footer nav aside form fieldset address details summary dialog hr center menu".split()
)
#: What an opening block ends, where its own end tag is optional.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
NOISE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "label", "fieldset", "head"}
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "note"}
NOISE_WORDS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager "
    "pagination popup promo promotion recommended related replies respond search share sharing sidebar signup social sponsor "
    "sponsored subscribe toolbar topbar widget".split()
)
MAIN = {"article", "main"}
LETTERS = re.compile(r"[a-z]+")
#: A tag that the end of the page cuts off.
STARTED = re.compile(r"<(?=[A-Za-z/!?])")
SPACE = re.compile(r"\s+")


def blocks(page: str):
    """(path, text, noise, main, own) of the text blocks, in page order; and the child sequence of each path.

    main is the depth of the article or main element around a block, or 0.  own is noise without the class words of
    that element and of those around it.
    """
    out, children = [], {}
    stack: list[tuple[str, bool, int, bool, str]] = [("", False, 0, False, "")]  # tag, noise, main, own, path
    text: list[str] = []

    def flush():
        if text:
            said = SPACE.sub(" ", html.unescape("".join(text))).strip()
            text.clear()
            if said:
                _, noise, main, own, path = stack[-1]
                out.append((path, said, noise, main, own))

    def close(names) -> None:
        """Ends the innermost of these blocks, and what is open inside it."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                flush()
                del stack[i:]
                return

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, ending = m[2].lower(), bool(m[1])
        if tag in RAW:
            if not ending and not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "br":
            text.append(" ")
            continue
        if ending:
            if tag in BLOCKS or tag in NOISE:
                close({tag})
            continue
        if tag in BLOCKS or tag in NOISE:
            flush()
            if stack[-1][0] == "p":
                stack.pop()
            if tag in ENDS and any(s[0] in ENDS[tag] for s in stack[-3:]):
                close(ENDS[tag])
            if tag in VOID:
                continue
            found = {a[0].lower(): a[1] or a[2] or a[3] for a in reversed(ATTRIBUTE.findall(m[3]))} if NAMED.search(m[3]) else {}
            _, noise, main, own, path = stack[-1]
            meant = tag in NOISE or tag == "header" and not main or found.get("role", "").lower() in NOISE_ROLES
            named = ("class" in found or "id" in found) and tag not in ("html", "body") and any(
                (parts := LETTERS.findall(name)) and NOISE_WORDS.issuperset(parts) for name in f"{found.get('class', '')} {found.get('id', '')}".lower().split()
            )
            own = own or meant or bool(main) and named
            noise = noise or meant or named
            main = main or (path.count("/") + 1 if tag in MAIN or found.get("role", "").lower() == "main" else 0)
            label = ".".join([tag, *sorted(set(found.get("class", "").lower().split()))])
            children.setdefault(path, []).append(label)
            if tag not in ("html", "body"):
                path = f"{path}/{label}"
            stack.append((tag, noise, main, own, path))
    if at < len(page):
        rest = page[at:]
        cut = STARTED.search(rest)
        text.append(rest[: cut.start()] if cut else rest)
    flush()
    return out, children


def main_text(page: str, noisy=frozenset(), host: str = "") -> str:
    found, _ = blocks(page)
    inside = any(main and not noise for _, _, noise, main, _ in found)
    if not inside and any(main and not own for _, _, _, main, own in found):
        inside, found = True, [(path, said, own, main, own) for path, said, _, main, own in found]
    kept, left = [], []
    for path, said, noise, main, _ in found:
        if noise or inside and not main:
            continue
        left.append(said)
        if noisy and any(node_key(host, p) in noisy for p in prefixes(path)[main:]):
            continue
        kept.append(said)
    return "\n".join(kept or left)


def page_key(found: list) -> int:
    """Stands for the texts of a page's blocks: copies have the same."""
    return key("\0".join(said for _, said, *_ in found))


def prefixes(path: str) -> list[str]:
    parts = path.split("/")
    return ["/".join(parts[:i]) for i in range(2, len(parts) + 1)]


def key(text: str) -> int:
    import xxhash

    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def node_key(host: str, path: str) -> int:
    return key(f"{host}\0{path}")


CONTENT, PRESENTATION, PAGE = range(3)
COUNTS = "host_key long, node long, kind int, feature long, n double"
COPIES = "host_key long, page long, n long"


def _counter(copies: dict | None):
    """Each batch's distinct (node, feature), with the number of its pages that have it; n copies count as 1/n each.

    copies: their numbers by (host_key, page), or None if they are in a column.
    """

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            seen: dict[tuple, float] = {}
            copied = batch.column("copied_").to_pylist() if copies is None else [None] * len(batch)
            for h, host, page, n in zip(*[batch.column(c).to_pylist() for c in ("host_key", "host_", "html")], copied, strict=True):
                own, (found, children) = set(), blocks(page or "")
                weight = 1 / ((copies.value.get((h, page_key(found))) if copies is not None else n) or 1)
                for path, said, *_ in found:
                    feature = key(said)
                    for p in prefixes(path):
                        node = node_key(host, p)
                        own |= {(node, CONTENT, feature), (node, PAGE, 0)}
                for path, labels in children.items():
                    if path:
                        own.add((node_key(host, path), PRESENTATION, key(" ".join(labels))))
                for x in own:
                    seen[h, *x] = seen.get((h, *x), 0) + weight
            columns = list(zip(*((*k, n) for k, n in seen.items()), strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in COUNTS.split(", ")])

    return count


def _page_keys(batches):
    """Each batch's distinct pages, with their number."""
    import pyarrow as pa

    for batch in batches:
        seen: dict[tuple, int] = {}
        for h, page in zip(batch.column("host_key").to_pylist(), batch.column("html").to_pylist(), strict=True):
            k = h, page_key(blocks(page or "")[0])
            seen[k] = seen.get(k, 0) + 1
        columns = list(zip(*((*k, n) for k, n in seen.items()), strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["host_key", "page", "n"])


def _keyed(batches):
    import pyarrow as pa

    for batch in batches:
        pages = pa.array([page_key(blocks(page or "")[0]) for page in batch.column("html").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, pages], [*batch.schema.names, "page"])


def importance(pages: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """host_key, node, pages, importance of every style node; copies are one page. pages: host_, html."""
    keyed = pages.select(F.xxhash64("host_").alias("host_key"), "host_", "html")
    sums = keyed.select("host_key", "html").mapInArrow(_page_keys, COPIES).groupBy("host_key", "page").agg(F.sum("n").alias("n"))
    copies = stored(sums.filter("n > 1"), "copies")
    if copies.count() <= broadcast_rows:
        sent = pages.sparkSession.sparkContext.broadcast({(r.host_key, r.page): r.n for r in copies.collect()})
        counts = keyed.mapInArrow(_counter(sent), COUNTS)
    else:
        marked = keyed.mapInArrow(_keyed, "host_key long, host_ string, html string, page long")
        copied = copies.select("host_key", "page", F.col("n").alias("copied_"))
        counts = marked.join(copied, ["host_key", "page"], "left").mapInArrow(_counter(None), COUNTS)
    features = counts.groupBy("host_key", "node", "kind", "feature").agg(F.round(F.sum("n")).alias("n"))
    m = F.max(F.when(F.col("kind") == PAGE, F.col("n"))).alias("pages")
    content, shape = F.col("kind") == CONTENT, F.col("kind") == PRESENTATION
    sums = features.groupBy("host_key", "node").agg(
        m,
        (F.sum(F.when(content, F.col("n") * F.ln("n"))) / F.sum(F.when(content, F.col("n")))).alias("spread"),
        F.sum(F.when(shape, F.col("n") * F.ln("n"))).alias("shape"),
        F.sum(F.when(shape, F.col("n"))).alias("shapes"),
    )
    size = F.ln("pages")
    # -sum(p ln p) = ln m - sum(n ln n) / m
    presented = F.coalesce((F.ln("shapes") - F.col("shape") / F.col("shapes")) / size, F.lit(0.0))
    both = (1 - GAMMA) * presented + GAMMA * (1 - F.col("spread") / size)
    return sums.filter("pages is not null").select(
        "host_key", "node", "pages", F.when(F.col("pages") > 1, both).otherwise(1.0).alias("importance")
    )


def host(url):
    u = F.coalesce(url, F.lit(""))
    return F.lower(F.regexp_extract(u, r"^[^:]*://([^/?#]*)", 1))


def extract(pages: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """pages with text in place of html. A pass over the pages counts copies, one makes the trees, one the texts."""
    own = [f for f in pages.schema.fields if f.name not in ("html", "text", "host_", "noisy_", "host_key")]
    placed = pages.select(*[f.name for f in own], "html", host(F.col("url")).alias("host_"))
    weighed = (F.col("pages") * F.col("importance") + PRIOR_PAGES) / (F.col("pages") + PRIOR_PAGES)
    noisy = stored(importance(placed, broadcast_rows).filter(weighed < THRESHOLD).select("host_key", "node"), "noise")
    keyed = placed.withColumn("host_key", F.xxhash64("host_"))
    if noisy.count() <= broadcast_rows:
        # the node's key holds its host, so one set serves all hosts
        sent = pages.sparkSession.sparkContext.broadcast(frozenset(r.node for r in noisy.collect()))
        joined = keyed.withColumn("noisy_", F.lit(None).cast("array<long>"))
    else:
        sent = None
        joined = keyed.join(noisy.groupBy("host_key").agg(F.collect_set("node").alias("noisy_")), "host_key", "left")

    def texts(batches):
        import pyarrow as pa

        for batch in batches:
            sets: dict[int, frozenset] = {}
            said = []
            for i, (page, key_, name) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("html", "host_key", "host_")], strict=True)):
                if sent is None and key_ not in sets:  # once for each host of the batch
                    sets[key_] = frozenset(batch.column("noisy_")[i].as_py() or ())
                said.append(main_text(page or "", sets[key_] if sent is None else sent.value, name))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in own), pa.array(said, pa.string())], [*(f.name for f in own), "text"])

    return joined.mapInArrow(texts, T.StructType([*own, T.StructField("text", T.StringType())]))
