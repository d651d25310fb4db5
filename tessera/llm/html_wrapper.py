"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

A page's markup is a nested token stream. Elements with one key (tag, with class, id and
role; digits count as one) that follow each other are folded into a repeated group, as are
runs of several keys that come again. Two streams of a host are aligned level by level on the longest common
subsequence of their keys: what both have is aligned in turn, what only one has becomes an
optional group, and texts become slots. The result is a union-free expression again, and is
aligned with the next. A slot counts its pages and characters, how many of these are links,
and whether its text varies from page to page.

Pages of one structure are summed before anything is aligned, and structures are aligned
in the order of their form, so the wrapper doesn't depend on how pages lie in partitions.
A host's structures are dealt over groups, whose wrappers are aligned in the end: a host
with a third of all pages moves no more than its different structures a task.

The wrapper decides which slots are the article's (``main_slots``); pages are then read
against their host's slots.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, materialize, scaled_parts

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=[/a-zA-Z!?])[^<]*\Z|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: A start tag that ends an open element of these kinds.
_ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_ENDS |= {t: {"p"} for t in "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()}
#: Elements that an implied end doesn't reach beyond.
_WALLS = set("article aside body div footer form header html main nav ol section table ul dl".split())
#: Elements that aren't an article's by what HTML says of them.
_ASIDE_TAGS = set("head nav footer aside form script style noscript template button select menu dialog iframe svg title textarea".split())
#: Names that tell of what is beside an article, and names that may. They settle what the wrapper leaves open, never more.
_ASIDE_NAMES = "ads? advert\\w* banner sponsor\\w* promo\\w* cookies? consent sidebar comments? commentlist respond replies disqus menu nav\\w* breadcrumbs? sharing footer masthead newsletter subscribe signup login popup modal overlay widget navigation contentinfo complementary toolbar pagination pager"
_OPEN_NAMES = "notices? side reply discussion share social related recommended header search alert dialog skip"
_NAMED, _PERHAPS = (re.compile(rf"(?:^|[\s_\-])(?:{names.replace(' ', '|')})(?:$|[\s_\-])", re.I) for names in (_ASIDE_NAMES, _OPEN_NAMES))
_HEADING = re.compile("h[1-6]")
_MAIN = re.compile(r"(?:^|[\s_\-])(?:main|article|content|post|entry|story)(?:$|[\s_\-])", re.I)
#: A slot is links if these have so much of its text; a part is small below this share of the text.
LINKS, SMALL_PART = 0.6, 0.12
#: The element that holds so much of the text is the article's; pages that must agree before a text counts as the host's.
MOST_TEXT, LEAST_PAGES = 0.7, 3
#: Keys of a run that is folded where it comes again; levels that a stream tells apart.
RUN, DEEPEST = 4, 150
#: Up to so many pairs of children the common subsequence is the longest; beyond, the one that takes each key where it comes next.
PAIRS = 1_000_000
#: Wrappers up to these many bytes together go to all tasks; more are joined by host.
SMALL = 16 << 20


def _key(tag: str, attributes: str) -> str:
    if "=" not in attributes:
        return tag
    named = {m[1].lower(): (m[2] or m[3] or m[4] or "").strip() for m in _ATTRIBUTE.finditer(attributes)}
    return tag + "".join(f"{mark}{re.sub(r'\d+', '0', named[name].lower())}" for name, mark in (("class", "."), ("id", "#"), ("role", "@")) if named.get(name))


Found = tuple[tuple[str, ...], str, int]


def blocks(page: str) -> Iterator[Found]:
    """Text blocks in page order, each with the keys of the elements around it and how many of its characters are links.

    An unclosed element ends where its parent does or where a start tag implies its end;
    a tag or comment that the page's end cuts off is no text. Elements below DEEPEST levels
    are part of the one above them.
    """
    stack: list[str] = []  # keys
    tags: list[str] = []
    held: list[str] = []
    link, linked = False, 0
    at, size = 0, len(page)

    def flush() -> Iterator[Found]:
        nonlocal linked
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                yield tuple(stack[:DEEPEST]), text, min(linked, len(text))
        linked = 0

    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if page[m.start()] != "<" or m.end() == m.start() + 1:
                held.append(m[0])
                if link:
                    linked += len(m[0])
            continue
        tag = tag.lower()
        if tag in _INLINE:
            if tag == "a":
                link = not m[1] and "href" in m[3].lower()
            elif tag in ("br", "img", "wbr"):
                held.append(" " if tag != "wbr" else "")
            continue
        if m[1]:
            if tag in tags:
                yield from flush()
                k = len(tags) - 1 - tags[::-1].index(tag)
                del tags[k:], stack[k:]
            continue
        yield from flush()
        link = False
        ends = _ENDS.get(tag)
        if ends:
            k = len(tags) - 1
            cut = None
            while k >= 0 and (tags[k] not in _WALLS or tags[k] in ends):
                if tags[k] in ends:
                    cut = k
                k -= 1
            if cut is not None:
                del tags[cut:], stack[cut:]
        if tag in _VOID or m[3].endswith("/"):
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if tag in ("title", "textarea"):
                text = " ".join(entities.unescape(page[at : end.start() if end else size]).split())
                if text:
                    yield (*stack[:DEEPEST], tag), text, 0
            at = end.end() if end else size
            continue
        tags.append(tag)
        stack.append(_key(tag, m[3]))
    yield from flush()


# A wrapper node is [key, flags, pages, characters, links, least hash, largest hash, children].
# Flags: 1 optional, 2 repeated. Hashes are of a page's whole text in the slot; they differ if it varies.
KEY, FLAGS, PAGES, CHARS, LINKED, LEAST, MOST, KIDS = range(8)
OPTIONAL, REPEATED = 1, 2
_BITS = 0x7FFFFFFFFFFF


def _node(key: str) -> list:
    return [key, 0, 0, 0, 0, 0, 0, []]


def stream(found: list[Found]) -> list:
    """The nested stream of a page's blocks, folded."""
    root = _node("")
    for path, text, linked in found:
        node = root
        for key in path:
            kids = node[KIDS]
            if not kids or kids[-1][KEY] != key:
                kids.append(_node(key))
            node = kids[-1]
        if node[CHARS]:
            node[FLAGS] |= REPEATED
        node[CHARS] += len(text)
        node[LINKED] += linked
        node[PAGES] = 1
        node[LEAST] = node[MOST] = (node[LEAST] * 1_000_003 + hash_of(text)) & _BITS
    root[PAGES] = 1
    return _folded(root, True)


def hash_of(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()) & _BITS


def _united(a: list, b: list, one_page: bool) -> list:
    """Slots of one key put together: those of one page add up to one text, those of two pages are compared."""
    if not a[PAGES] or not b[PAGES]:
        x = a if a[PAGES] else b
        return [a[KEY], a[FLAGS] | b[FLAGS], *x[PAGES:KIDS], []]
    if one_page:
        text = (a[LEAST] * 1_000_003 + b[LEAST]) & _BITS
        return [a[KEY], a[FLAGS] | b[FLAGS], 1, a[CHARS] + b[CHARS], a[LINKED] + b[LINKED], text, text, []]
    return [a[KEY], a[FLAGS] | b[FLAGS], a[PAGES] + b[PAGES], a[CHARS] + b[CHARS], a[LINKED] + b[LINKED], min(a[LEAST], b[LEAST]), max(a[MOST], b[MOST]), []]


def _folded(node: list, one_page: bool) -> list:
    """Runs of up to RUN keys that come again right away are one repeated group, at all levels."""
    kids: list[list] = []
    for kid in node[KIDS]:
        kids.append(_folded(kid, one_page))
        for n in range(1, RUN + 1):
            if len(kids) >= 2 * n and [k[KEY] for k in kids[-n:]] == [k[KEY] for k in kids[-2 * n : -n]]:
                again = kids[-n:]
                del kids[-n:]
                for i, k in enumerate(again):
                    kids[i - n] = align(kids[i - n], k, one_page)
                    kids[i - n][FLAGS] |= REPEATED
                break
    return [*node[:KIDS], kids]


def align(a: list, b: list, one_page: bool = False) -> list:
    """The union-free expression that both of two nodes with one key match."""
    out = _united(a, b, one_page)
    x, y = a[KIDS], b[KIDS]
    keys_x, keys_y = [n[KEY] for n in x], [n[KEY] for n in y]
    if keys_x == keys_y:
        out[KIDS] = [align(p, q, one_page) for p, q in zip(x, y, strict=True)]
        return out
    merged, i, j = out[KIDS], 0, 0
    for p, q in [*_common(keys_x, keys_y), (len(x), len(y))]:
        merged += [[n[KEY], n[FLAGS] | OPTIONAL, *n[PAGES:]] for n in (*x[i:p], *y[j:q])]
        if p < len(x):
            merged.append(align(x[p], y[q], one_page))
        i, j = p + 1, q + 1
    return _folded(out, one_page)


def _common(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of a common subsequence of two lists of keys."""
    out = []
    if len(x) * len(y) > PAIRS:
        places: dict[str, list[int]] = {}
        for j, key in enumerate(y):
            places.setdefault(key, []).append(j)
        j = 0
        for i, key in enumerate(x):
            own = places.get(key, ())
            k = bisect_left(own, j)
            if k < len(own) and own[k] - j < 64:
                out.append((i, own[k]))
                j = own[k] + 1
        return out
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def form(node: list) -> str:
    """The expression alone, without what its slots count."""
    mark = "*" if node[FLAGS] & REPEATED else ""
    return f"{node[KEY]}{mark}{'#' if node[PAGES] else ''}({','.join([form(k) for k in node[KIDS]])})"


def summed(a: list, b: list) -> list:
    """Two wrappers of one form as one; the order doesn't matter."""
    return [*_united(a, b, False)[:KIDS], [summed(x, y) for x, y in zip(a[KIDS], b[KIDS], strict=True)]]


@dataclass
class Part:
    """An element of the wrapper with what lies below it."""

    path: tuple[str, ...]
    flags: int
    chars: int
    linked: int
    pages: int
    varies: bool
    kids: list[Part]

    def slots(self) -> Iterator[Part]:
        yield self
        for k in self.kids:
            yield from k.slots()


def _part(node: list, path: tuple[str, ...], whole: int) -> Part:
    """Elements of one path are one; ``whole`` pages make the wrapper."""
    grouped: dict[str, list[list]] = {}
    for k in node[KIDS]:
        grouped.setdefault(k[KEY], []).append(k)
    kids = []
    for key, nodes in grouped.items():
        one = nodes[0]
        for other in nodes[1:]:
            flags = one[FLAGS] | other[FLAGS]
            one = [*_united(one, other, False)[:KIDS], [*one[KIDS], *other[KIDS]]]
            one[FLAGS] = flags
        kids.append(_part(one, (*path, key), whole))
    chars, linked = node[CHARS] + sum(k.chars for k in kids), node[LINKED] + sum(k.linked for k in kids)
    pages = max([node[PAGES], *(k.pages for k in kids)])
    varies = node[LEAST] != node[MOST] or any(k.varies for k in kids)
    return Part(path, node[FLAGS], chars, linked, pages, varies, kids)


def _tag(key: str) -> str:
    return re.split(r"[.#@]", key, maxsplit=1)[0]


def _called(key: str, names: re.Pattern) -> bool:
    tag = _tag(key)
    return len(key) > len(tag) and bool(names.search(re.sub(r"[.#@]", " ", key[len(tag) :])))


def _records(part: Part) -> bool:
    """Whether it is, or holds, a list of like elements that hold elements: comments, teasers. Runs of paragraphs aren't."""
    return any(p.flags & REPEATED and any(k.chars for k in p.kids) and _tag(p.path[-1]) not in ("ul", "ol", "table", "tr", "tbody", "dl", "p", "blockquote") for p in part.slots() if p.path)


def beside(part: Part, total: int, whole: int, inside: bool) -> bool:
    """Whether a part of the wrapper is beside the article.

    It is if HTML says so, if its text is mostly links, or if the text is the host's (many pages have it and it never
    varies; headings may, and blocks of an article). Otherwise a name can settle what its form leaves open: parts that are small, or lists of records, or of a
    host with too few pages to tell.
    """
    key = part.path[-1]
    tag = _tag(key)
    if tag in _ASIDE_TAGS or tag == "header" and not inside:
        return True
    if not part.chars or tag in ("html", "body", "main", "article"):
        return False
    if part.linked >= LINKS * part.chars:
        return True
    if part.pages >= max(LEAST_PAGES, whole / 4) and not part.varies and not (inside and _prose(part)) and not _HEADING.fullmatch(tag):
        return True
    name = 1.0 if _called(key, _NAMED) else 0.5 if _called(key, _PERHAPS) else 0.0
    return name > 0 and name + 1.5 * _records(part) + (part.chars < SMALL_PART * total or whole < LEAST_PAGES) >= 2


def _kept(part: Part, total: int, whole: int, inside: bool = False) -> list[Part]:
    """The parts below that aren't beside the article, without those inside parts that are."""
    out = []
    for kid in part.kids:
        here = inside or _tag(kid.path[-1]) in ("article", "main")
        if not beside(kid, total, whole, here):
            below = _kept(kid, total, whole, here)
            own = kid.chars - sum(k.chars for k in kid.kids)
            out.append(Part(kid.path, kid.flags, max(own, 0) + sum(k.chars for k in below), kid.linked, kid.pages, kid.varies, below))
    return out


def main_slots(wrapper: list) -> list[tuple[str, ...]]:
    """Paths of the slots that hold the article.

    What lies beside an article goes first. The article is in the deepest element that has MOST_TEXT of the text that
    is left. Where no element has so much, elements that HTML or their names call the article's break the tie.
    """
    whole = wrapper[PAGES]
    root = _part(wrapper, (), whole)
    total = root.chars
    left = _kept(root, total, whole)
    best = Part((), root.flags, sum(p.chars for p in left) + wrapper[CHARS], 0, whole, root.varies, left)
    text = best.chars
    while True:
        top = min(best.kids, key=lambda k: (-k.chars, k.path), default=None)
        if top and top.chars >= MOST_TEXT * text and not _prose(top) and not any(_tag(k) == "article" for k in best.path) and not _titled(best, top):
            best = top
            continue
        called = [p for p in best.slots() if p is not best and p.chars and (_tag(p.path[-1]) in ("article", "main") or _called(p.path[-1], _MAIN))]
        if called and not any(_tag(k) in ("article", "main") for k in best.path):
            best = min(called, key=lambda p: (_tag(p.path[-1]) != "article", _tag(p.path[-1]) != "main", -p.chars, p.path))
            continue
        return sorted({p.path for p in best.slots() if p.chars} | ({()} if not best.path and wrapper[CHARS] else set()))


def _titled(parent: Part, kid: Part) -> bool:
    """Whether what comes before an element has the first heading, and the element has none."""
    before = parent.kids[: parent.kids.index(kid)]
    has = lambda p: any(x.path and _tag(x.path[-1]) == "h1" and x.chars for x in p.slots())
    return any(has(p) for p in before) and not has(kid)


def _prose(part: Part) -> bool:
    """Whether it is a block of running text, whose neighbours belong to it."""
    return _tag(part.path[-1]) in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "blockquote", "pre", "table", "dl", "dt", "dd", "figure", "tbody", "tr", "td", "th")


def extract(found: list[Found], slots: set[tuple[str, ...]]) -> str:
    """A page's blocks in its host's main slots; a page of another form, that has less than a tenth of its own article there, is its own wrapper."""
    text = [t for p, t, _ in found if p in slots]
    if 2 * sum(map(len, text)) < sum(len(t) for p, t, _ in found if not any(_tag(k) in _ASIDE_TAGS for k in p)):
        own = set(main_slots(stream(found)))
        if 10 * sum(map(len, text)) < sum(len(t) for p, t, _ in found if p in own):
            text = [t for p, t, _ in found if p in own]
    return "\n".join(text)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


#: Wrappers that a task holds before it sends them on.
HELD = 4_000


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, form, w): pages of one host and form summed, in each task."""
    held: dict[tuple[str, str], list] = {}

    def sent() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.string()), pa.array([json.dumps(w) for w in held.values()], pa.string())], ["host", "form", "w"])
        held.clear()
        return out

    for batch in batches:
        for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            new = stream(list(blocks(page or "")))
            key = host_of(url), hashlib.blake2b(form(new).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
            held[key] = summed(held[key], new) if key in held else new
            if len(held) >= HELD:
                yield sent()
    yield sent()


def _sum(key: tuple, table: pa.Table) -> pa.Table:
    """Wrappers of one form as one."""
    out: dict[str, list] = {}
    for name, text in zip(table.column("form").to_pylist(), table.column("w").to_pylist(), strict=True):
        new = json.loads(text)
        out[name] = summed(out[name], new) if name in out else new
    return pa.table({"host": pa.array([key[0].as_py()] * len(out), pa.string()), "form": pa.array(list(out), pa.string()), "w": pa.array([json.dumps(w) for w in out.values()], pa.string())})


def _merge(key: tuple, table: pa.Table) -> pa.Table:
    """Wrappers aligned in the order of their forms."""
    out: list | None = None
    for _, text in sorted(zip(table.column("form").to_pylist(), table.column("w").to_pylist(), strict=True)):
        new = json.loads(text)
        out = new if out is None else align(out, new)
    return pa.table({"host": pa.array([key[0].as_py()]), "form": pa.array([f"{key[1].as_py():08d}" if len(key) > 1 else ""]), "w": pa.array([json.dumps(out)])})


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(``host``, ``w``): the wrapper of each host as JSON. Urls that are null or have no host share the host ''.

    Each page is read once; its form is summed in its task, then over tasks, and forms are aligned in groups of a
    host, groups of groups, and for the host.
    """
    kind = "host string, form string, w string"
    parts = pages.select(F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html")).mapInArrow(_infer, kind)
    n = scaled_parts(pages)
    summed_up = parts.groupBy("host", F.pmod(F.xxhash64("form"), F.lit(n)).cast("int").alias("group")).applyInArrow(_sum, kind)
    salt = F.pmod(F.xxhash64("form"), F.lit(n)).cast("int")
    first = summed_up.groupBy("host", salt.alias("group")).applyInArrow(_merge, kind)
    second = first.groupBy("host", F.pmod(F.col("form").cast("int"), F.lit(max(1, round(n**0.5)))).alias("group")).applyInArrow(_merge, kind)
    return second.groupBy("host").applyInArrow(_merge, kind).select("host", "w")


def _host_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots = [json.dumps(main_slots(json.loads(w))) for w in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(slots, pa.string())], ["host", "slots"])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, set[tuple[str, ...]]] = {}
    for batch in batches:
        texts = []
        for page, slots in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if slots is not None and slots not in known:
                if len(known) > 1000:
                    known.clear()
                known[slots] = {tuple(p) for p in json.loads(slots)}
            texts.append(extract(list(blocks(page or "")), known.get(slots, set())))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: ``page_id``, ``url``, ``text`` (blocks joined by line feeds), ``n_chars``.

    Pages that are null, empty or without an article's text give an empty text. Rows with
    equal ids and null ids stay apart; a null url belongs to the host ''. Extra columns are left out.
    """
    bound_batches(pages.sparkSession)
    slots = materialize(wrappers(pages, url_col, html_col).mapInArrow(_host_slots, "host string, slots string"))
    size = slots.agg(F.sum(F.length("host") + F.length("slots"))).first()[0] or 0
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))

    def with_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = pa.array([host_of(u) for u in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, hosts], [*batch.schema.names, "host"])

    hosted = rows.mapInArrow(with_host, rows.withColumn("host", F.lit("")).schema)
    joined = hosted.join(F.broadcast(slots) if size <= SMALL else slots, "host", "left").select("page_id", "url", "html", "slots")
    return joined.mapInArrow(_apply, rows.select("page_id", "url").withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema)
