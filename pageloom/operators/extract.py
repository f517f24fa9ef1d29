"""Extraction from HTML: one pass over the pages parses each page once for all that is asked of it.

``extract(pages, *parts)`` is a map over Arrow batches; parts are named in ``PARTS``.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from pageloom.operators import dom
from pageloom.operators.cleaning import clean_text, strip_html
from pageloom.operators.dom import Node
from pageloom.operators.markdown import convert
from pageloom.operators.slices import slices

_FORMS = "button,form,iframe,input,noscript,select,textarea"
_NOISE = "script,style,nav,header,footer,.ads,.advertisement,.comments,.menu,.modal,.navigation,.popup,.sidebar,.social-share"
_ROLES = '.cookie-banner,[role="banner"],[role="complementary"],[role="navigation"]'
FAST_REMOVED = f"{_NOISE},aside,{_FORMS},{_ROLES}"
PAGE_REMOVED = f"{_NOISE},aside,.newsletter-signup,{_ROLES}"
FAST_CONTENT = ("article", "main", '[role="main"]', ".article-content", ".blog-post__body", "#content", ".content", ".entry-content", "#main-content", ".main-content", ".markdown-body", ".page-content", ".post-content")
FALLBACK_CONTENT = (".blog-post__body", "article", ".article-content", ".post-content", ".entry-content", ".content", "main", "#content", ".story-body")
PAGE_CONTENT = ("main", '[role="main"]', "article") + tuple(f"{m}{n}" for n, ms in (("content", ".#"), ("main-content", ".#")) for m in ms) + tuple(f".{n}" for n in ("page-content", "post-content", "entry-content", "article-content", "documentation-content", "doc-content", "wiki-content", "markdown-body"))
DATA_BLOCKS = "script[type='application/ld+json']"
HEADINGS = "h1,h2,h3,h4,h5,h6"
PUBLISHED = ('[property="article:published_time"]', '[name="publish-date"]', '[name="date"]', "time[datetime]", ".publish-date", ".published", ".date")
ARTICLE_TYPES = frozenset(("article", "blogposting", "newsarticle", "scholarlyarticle", "techarticle"))


def _attr(root: Node, selector: str, name: str = "content") -> str:
    n = root.first(selector)
    return n.get(name) if n else ""


def _text(root: Node, selector: str) -> str:
    n = root.first(selector)
    return n.text().strip() if n else ""


def words(text: str) -> int:
    return len(text.split())


def minutes(n: int) -> int:
    return math.ceil(n / 200)


def title(root: Node) -> str:
    return _attr(root, 'meta[property="og:title"]') or _text(root, "h1") or _text(root, "title")


def page_title(root: Node, url: str) -> str:
    return title(root) or "Untitled Page"


def description(root: Node, url: str) -> str | None:
    return _attr(root, 'meta[name="description"]') or _attr(root, 'meta[property="og:description"]') or _attr(root, 'meta[name="twitter:description"]') or None


def language(root: Node, url: str) -> str | None:
    return _attr(root, "html", "lang") or _attr(root, 'meta[name="language"]') or _attr(root, 'meta[http-equiv="content-language"]') or None


def canonical(root: Node, url: str) -> str | None:
    return _attr(root, 'link[rel="canonical"]', "href") or None


def site_name(root: Node, url: str) -> str | None:
    return _attr(root, 'meta[property="og:site_name"]') or _attr(root, 'meta[name="application-name"]') or None


_DATED = re.compile(r"\d{4}-\d{2}-\d{2}|\d{1,2} \w{3,9} \d{4}|\w{3,9} \d{1,2}, \d{4}|\d{1,2}/\d{1,2}/\d{4}")


def published(root: Node, url: str) -> str | None:
    """The first of several places that holds a date."""
    for selector in PUBLISHED:
        n = root.first(selector)
        value = (n.get("content") or n.get("datetime") or n.text().strip()) if n else ""
        if _DATED.search(value):
            return value
    return None


def absolute(href: str, base: str) -> str | None:
    """A link resolved against the site's root, with at least the path "/"."""
    try:
        root = urlsplit(base)
        whole = urlsplit(urljoin(f"{root.scheme}://{root.netloc}/", href.strip()))
        return whole._replace(path=whole.path or "/", netloc=whole.netloc.lower()).geturl() if whole.netloc else whole.geturl()
    except ValueError:
        return None


def host(url: str) -> str:
    try:
        return urlsplit(url).hostname or ""
    except ValueError:
        return ""


def links(root: Node, url: str) -> list[dict]:
    seen: dict[str, dict] = {}
    for a in root.all("a[href]"):
        href, text = a.get("href"), a.text().strip()
        if href and text and not href.startswith(("#", "javascript:", "mailto:")) and (to := absolute(href, url)):
            seen.setdefault(to, {"url": to, "text": text, "is_external": host(to) != host(url)})
    return list(seen.values())


def _pixels(text: str) -> int | None:
    m = re.match(r"\s*(\d+)", text)
    return int(m[1]) or None if m else None


def images(root: Node, url: str) -> list[dict]:
    seen: dict[str, dict] = {}
    for i in root.all("img[src]"):
        src = i.get("src")
        if src and not src.startswith("data:") and (to := absolute(src, url)):
            seen.setdefault(to, {"src": to, "alt": i.get("alt") or None, "width": _pixels(i.get("width")), "height": _pixels(i.get("height"))})
    return list(seen.values())


def headings(root: Node, url: str) -> list[dict]:
    return [{"level": int(h.tag[1]), "text": t} for h in root.all(HEADINGS) if (t := h.text().strip())]


def tables(root: Node, url: str) -> list[dict]:
    """Head and rows; with a thead, its row is the first of the rows too."""
    out = []
    for t in root.all("table"):
        cells = lambda row: [c.text().strip() for c in row.all("td,th")]
        head, rows = t.first("thead"), t.all("tr")
        names = cells(head) if head else cells(rows[0]) if rows else []
        body = [r for r in (cells(tr) for tr in (rows if head or not names else rows[1:])) if r]
        if names or body:
            out.append({"headers": names, "rows": body})
    return out


def sections(root: Node, url: str) -> list[dict]:
    out = []
    for h in root.all(HEADINGS):
        level, heading = int(h.tag[1]), h.text().strip()
        if not heading:
            continue
        content, n = [], h.next()
        while n and not (re.fullmatch("h[1-6]", n.tag) and int(n.tag[1]) <= level):
            content.append(n.text().strip())
            n = n.next()
        out.append({"heading": heading, "level": level, "content": "\n".join(content).strip()})
    return out


def metadata(root: Node, url: str) -> dict:
    meta = lambda name, kind="name": _attr(root, f'meta[{kind}="{name}"]') or None
    icon = _attr(root, 'link[rel="icon"]', "href") or _attr(root, 'link[rel="shortcut icon"]', "href")
    return {
        "title": _text(root, "title") or None,
        "description": meta("description"),
        "keywords": [k for k in (k.strip() for k in (meta("keywords") or "").split(",")) if k],
        "canonical": canonical(root, url),
        "favicon": (absolute(icon, url) or icon) if icon else None,
        "og_image": meta("og:image", "property"),
        "og_type": meta("og:type", "property"),
        "language": _attr(root, "html", "lang") or meta("language"),
        "charset": _attr(root, "meta[charset]", "charset") or None,
        "viewport": meta("viewport"),
        "robots": meta("robots"),
        "generator": meta("generator"),
        "theme_color": meta("theme-color"),
    }


def json_ld(root: Node, url: str) -> list[str]:
    """Every JSON-LD block that can be read, as JSON."""
    out = []
    for s in root.all(DATA_BLOCKS):
        try:
            out.append(json.dumps(json.loads(s.text())))
        except ValueError:
            pass
    return out


def open_graph(root: Node, url: str) -> dict[str, str]:
    """By full property; the last of a name wins."""
    return {m.get("property"): m.get("content") for m in root.all('meta[property^="og:"]') if m.get("content")}


def twitter(root: Node, url: str) -> dict[str, str]:
    return {m.get("name"): m.get("content") for m in root.all('meta[name^="twitter:"]') if m.get("content")}


def _prefixed(root: Node, prefix: str) -> dict[str, str]:
    """By what follows the prefix of property or name; the first of a name wins."""
    out: dict[str, str] = {}
    for m in root.all("meta"):
        name = m.get("property") or m.get("name")
        if name.startswith(prefix) and name != prefix and m.get("content"):
            out.setdefault(name[len(prefix) :], m.get("content"))
    return out


def microdata(root: Node, url: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for n in root.all("[itemprop]"):
        value = n.get("content") or n.get("datetime") or n.get("href") or n.get("src") or n.text().strip()
        if value and n.get("itemprop"):
            out.setdefault(n.get("itemprop"), value)
    return out


def _named(x: object, key: str = "name") -> str | None:
    if isinstance(x, str):
        return x
    return x[key] if isinstance(x, dict) and isinstance(x.get(key), str) else None


def distilled(root: Node, url: str) -> dict:
    """Ten fields of an article, from JSON-LD, Open Graph, Twitter and microdata in that order."""
    found: dict = {}
    for block in map(json.loads, json_ld(root, url)):
        graph = block.get("@graph") if isinstance(block, dict) else None
        for x in graph if isinstance(graph, list) else [block]:
            if not found and isinstance(x, dict) and str(x.get("@type", "")).lower() in ARTICLE_TYPES:
                found = x
    image = found.get("image")
    image = image[0] if isinstance(image, list) and image and isinstance(image[0], str) else _named(image, "url")
    ld = {k: found[k] if isinstance(found.get(k), str) else None for k in ("headline", "description", "datePublished", "dateModified", "url")}
    og, tw, md = _prefixed(root, "og:"), _prefixed(root, "twitter:"), microdata(root, url)
    pick = lambda *values: next((v for v in values if v), None)
    return {
        "title": pick(ld["headline"], og.get("title"), tw.get("title"), md.get("headline"), md.get("name")),
        "description": pick(ld["description"], og.get("description"), tw.get("description"), md.get("description")),
        "author": pick(_named(found.get("author")), _attr(root, 'meta[name="author"]'), md.get("author")),
        "published_time": pick(ld["datePublished"], _attr(root, 'meta[property="article:published_time"]'), md.get("datePublished")),
        "modified_time": pick(ld["dateModified"], _attr(root, 'meta[property="article:modified_time"]'), md.get("dateModified")),
        "canonical_url": pick(canonical(root, url), og.get("url"), ld["url"]),
        "image": pick(og.get("image"), tw.get("image"), image, md.get("image")),
        "site_name": pick(og.get("site_name"), _named(found.get("publisher"))),
        "lang": _attr(root, "html", "lang") or None,
        "type": pick(str(found.get("@type", "")).lower(), og.get("type")),
    }


_TYPED = (("documentation", r"/(?:api|docs?|documentation|guide|manual|reference)\b"), ("wiki", r"/(?:w|wiki)/"), ("product", r"/(?:item|product|shop|store)/"), ("article", r"/(?:article|blog|news|post)/"))


def page_type(root: Node, url: str) -> str:
    try:
        path = urlsplit(url).path.lower()
    except ValueError:
        path = ""
    first = root.first(DATA_BLOCKS)
    try:
        block = json.loads(first.text()) if first else None
        kind = str(block.get("@type", "")).lower() if isinstance(block, dict) else ""
    except ValueError:
        kind = ""
    if kind in ("article", "blogposting", "newsarticle"):
        return "article"
    if kind in ("offer", "product"):
        return "product"
    for name, pattern in _TYPED:
        if re.search(pattern, path):
            return name
    if root.first("article,.post-content"):
        return "article"
    if root.first('[itemtype*="Product"],.product-detail,.product-page'):
        return "product"
    return "landing" if path in ("", "/") else "generic"


def fast(root: Node, url: str, least: int = 50) -> dict | None:
    """The longest of the usual content elements; changes the tree."""
    root.remove(FAST_REMOVED)
    found = [e.inner_html() for s in FAST_CONTENT if (e := root.first(s))]
    html = max(found, key=len, default="")
    if len(html) < least:
        body = root.first("body")
        html = body.inner_html() if body else ""
    if len(html) < least:
        return None
    text = clean_text(strip_html(html))
    n = words(text)
    return {"title": title(root), "html": html, "markdown": convert(html), "text": text, "excerpt": text[:200] + ("..." if len(text) > 200 else ""), "word_count": n, "reading_time": minutes(n)}


_UNLIKELY = re.compile(r"ad-|agegate|banner|breadcrumb|combx|comment|community|cover-wrap|disqus|extra|footer|gdpr|header|legends|menu|pager|pagination|popup|related|remark|replies|rss|shoutbox|sidebar|skyscraper|social|sponsor|supplemental|yom-remote", re.I)
_MAYBE = re.compile(r"and|article|body|column|content|main|shadow", re.I)
_POSITIVE = re.compile(r"article|blog|body|content|entry|hentry|h-entry|main|page|post|story|text", re.I)
_NEGATIVE = re.compile(r"hidden|banner|combx|comment|com-|contact|footer|gdpr|masthead|media|meta|outbrain|promo|related|scroll|share|shoutbox|sidebar|skyscraper|sponsor|shopping|tags|widget", re.I)


def _weight(n: Node) -> int:
    return sum(25 * bool(_POSITIVE.search(n.get(a))) - 25 * bool(_NEGATIVE.search(n.get(a))) for a in ("class", "id") if n.get(a))


def _link_density(n: Node) -> float:
    total = len(dom.flat(n.text()))
    return sum(len(dom.flat(a.text())) for a in n.all("a")) / total if total else 0.0


def readable(root: Node, url: str, least: int = 200) -> dict | None:
    """The element whose paragraphs score highest, with its siblings that score well: the published
    readability algorithm in small.  Changes the tree."""
    root.remove("script,style,noscript,iframe,form,button,input,select,textarea")
    for n in list(root.walk()):
        about = f"{n.get('class')} {n.get('id')}"
        if n.parent and n.tag not in ("html", "body", "article", "a") and _UNLIKELY.search(about) and not _MAYBE.search(about):
            n.parent.children = [c for c in n.parent.children if c is not n]
    root.remove("nav,footer,aside")
    scores: dict[int, list] = {}
    for p in root.all("p,td,pre,section,h2,h3,h4,h5,h6"):
        text = dom.flat("".join(c if isinstance(c, str) else c.text() for c in p.children))
        if len(text) < 25:
            continue
        points = 1 + text.count(",") + min(len(text) // 100, 3)
        above = p.parent
        for level in range(5):
            if not above or above.tag == "#document":
                break
            if id(above) not in scores:
                base = {"div": 5, "article": 5, "pre": 3, "td": 3, "blockquote": 3}.get(above.tag, -5 if above.tag in ("th", "h1", "h2", "h3", "h4", "h5", "h6") else -3 if above.tag in ("ul", "ol", "dl", "form", "address") else 0)
                scores[id(above)] = [base + _weight(above), above]
            scores[id(above)][0] += points / (1 if level == 0 else 2 if level == 1 else level * 3)
            above = above.parent
    ranked = sorted(((s * (1 - _link_density(n)), n) for s, n in scores.values()), key=lambda x: -x[0])
    best, top = ranked[0] if ranked else (0.0, root.first("body"))
    if top is None:
        return None
    chosen = [top]
    if top.parent and top.tag != "body":
        final = {id(n): s for s, n in ranked}
        chosen = []
        for s in (c for c in top.parent.children if isinstance(c, Node)):
            text = dom.flat(s.text())
            prose = s.tag == "p" and ((len(text) > 80 and _link_density(s) < 0.25) or (0 < len(text) <= 80 and not s.first("a") and re.search(r"\.( |$)", text)))
            if s is top or final.get(id(s), -1) >= max(10, best * 0.2) or prose:
                chosen.append(s)
    html = "".join(c.inner_html() for c in chosen)
    text = "".join(c.text() for c in chosen).strip()
    if len(text) < least:
        return None
    n = words(text)
    return {"title": _text(root, "h1") or _text(root, "title"), "html": html, "text": text, "word_count": n, "reading_time": minutes(n), "confidence": 0.9, "method": "readability"}


def fallback(root: Node, url: str, least: int = 200) -> dict | None:
    """The first usual content element of over ``least`` characters, else the body; changes the tree."""
    root.remove(_NOISE)
    html = ""
    for s in FALLBACK_CONTENT:
        if e := root.first(s):
            html = e.inner_html()
            if len(html) > least:
                break
    if len(html) <= least:
        body = root.first("body")
        html = body.inner_html() if body else ""
    if len(html) < least:
        return None
    text = dom.parse(html).text().strip()
    n = words(text)
    head = _text(root, "h1") or _text(root, "title") or _attr(root, 'meta[property="og:title"]')
    return {"title": head, "html": html, "text": text, "word_count": n, "reading_time": minutes(n), "confidence": 0.6, "method": "fallback"}


def page_content(root: Node, url: str) -> dict:
    """Main content of any page: the first of the usual elements of over 100 characters, else the bare body."""
    html, confidence = next(((h, 0.7) for s in PAGE_CONTENT if (e := root.first(s)) and len(h := e.inner_html()) > 100), ("", 0.4))
    if not html:
        root.remove(PAGE_REMOVED)
        body = root.first("body")
        html = body.inner_html() if body else ""
    text = clean_text(strip_html(html))
    n = words(text)
    return {"title": page_title(root, url), "html": html, "text": text, "word_count": n, "reading_time": minutes(n), "confidence": confidence, "method": "selectors" if confidence > 0.5 else "body"}


_CONTENT = "struct<title:string,html:string,text:string,word_count:bigint,reading_time:bigint,confidence:double,method:string>"
_ARTICLE = "struct<title:string,description:string,author:string,published_time:string,modified_time:string,canonical_url:string,image:string,site_name:string,lang:string,type:string>"
_META = "struct<title:string,description:string,keywords:array<string>,canonical:string,favicon:string,og_image:string,og_type:string,language:string,charset:string,viewport:string,robots:string,generator:string,theme_color:string>"
#: What can be asked for, with its type; those that change the tree have their own, and of several the first that gives any counts.
PARTS: dict[str, tuple[str, Callable]] = {
    "title": ("string", page_title),
    "description": ("string", description),
    "language": ("string", language),
    "canonical": ("string", canonical),
    "site_name": ("string", site_name),
    "published": ("string", published),
    "links": ("array<struct<url:string,text:string,is_external:boolean>>", links),
    "images": ("array<struct<src:string,alt:string,width:int,height:int>>", images),
    "headings": ("array<struct<level:int,text:string>>", headings),
    "tables": ("array<struct<headers:array<string>,rows:array<array<string>>>>", tables),
    "sections": ("array<struct<heading:string,level:int,content:string>>", sections),
    "metadata": (_META, metadata),
    "json_ld": ("array<string>", json_ld),
    "open_graph": ("map<string,string>", open_graph),
    "twitter": ("map<string,string>", twitter),
    "microdata": ("map<string,string>", microdata),
    "article": (_ARTICLE, distilled),
    "page_type": ("string", page_type),
}
OWN_TREE: dict[str, tuple[str, Callable | tuple[Callable, ...]]] = {
    "fast": ("struct<title:string,html:string,markdown:string,text:string,excerpt:string,word_count:bigint,reading_time:bigint>", fast),
    "readable": (_CONTENT, readable),
    "fallback": (_CONTENT, fallback),
    "content": (_CONTENT, page_content),
    "main": (_CONTENT, (readable, fallback)),
}


def extract(pages: DataFrame, *parts: str, html: str = "html", url: str = "url") -> DataFrame:
    """``pages`` without its HTML, with a column for each part.  Null and empty HTML gives nulls."""
    known = PARTS | OWN_TREE
    kept = [f for f in pages.schema if f.name != html]
    made = StructType([StructField(p, _parse_datatype_string(known[p][0])) for p in parts])
    schema = StructType([*kept, *made])
    arrow = to_arrow_schema(made)
    names = [f.name for f in kept]
    own = {p: f if isinstance(f, tuple) else (f,) for p, (_, f) in OWN_TREE.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, html):
                columns: dict[str, list] = {p: [] for p in parts}
                for text, address in zip(part.column(html).to_pylist(), part.column(url).to_pylist()):
                    tree = dom.parse(text) if text else None
                    for p in parts:
                        made_by = (known[p][1],) if p in PARTS else own[p]
                        found = (f(tree if p in PARTS else tree.copy(), address or "") for f in made_by) if tree else ()
                        value = next((v for v in found if v is not None), None)
                        columns[p].append(list(value.items()) if isinstance(value, dict) and known[p][0].startswith("map") else value)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *(pa.array(columns[f.name], f.type) for f in arrow)], [*names, *parts])

    return pages.mapInArrow(run, schema)
