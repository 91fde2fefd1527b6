"""Main text of web pages by wrappers, union-free regular expressions inferred for each host.

A page is a stream of tags and texts. Repeats in it are folded: a leaf element, or a run of items that
follows itself, becomes one repeated group, and a text becomes a slot. What is left is the page's shape.
The shapes of one host are aligned one after the other into a wrapper: items that agree stay, and items that
only one side has become optional. So a wrapper is a regular expression over items with groups that repeat,
items that are optional and slots of text, and every page of the host matches it.

A slot is an item of the wrapper with the elements around the text. The wrapper says which slots hold the main text (``Chosen``): those inside the article or main
element, if the host's wrapper has one; otherwise all but for groups that repeat nothing but links. Of these,
stale slots go, whose texts return on other pages more often than those of the slots with most text, as notices
and rotating adverts do. Headings, and slots of an article, go only where most of their texts return, headings of an
article not at all. Of groups that repeat inside the article, those go whose parts are a line and a text without a
heading, which are the readers' comments, as are articles inside it. Slots inside the
elements or landmark roles of menus, headers, footers, sidebars, forms, dialogs, scripts and styles hold
none; class names say nothing. A page is read by matching its items against its host's wrapper and taking the
texts of the slots chosen there.

Shapes and slots are aggregated with map-side combine (host, shape, slot), so no page of a popular host
meets another one. A host's shapes are aligned ``FAN`` at a time, then the wrappers of those, until one is
left, so no task aligns more than that for a host. Pages meet their host's wrapper in a join whose popular
hosts are dealt over pieces in proportion to their share; the list of those has ``POPULAR`` hosts at most,
since each has more than 1/POPULAR of all pages.

A null or empty html has the empty text. A null url, or one without a host, belongs to host ''. A page
whose html has no tags is its text. Where nothing varies (one page, or copies of one), all slots outside the
elements named above are text. Repeated rows are extracted alike. Columns other than page_id, url and html
are not read. An empty table gives no rows.
"""

from __future__ import annotations

import difflib
import html as entities
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .workers import lean

POPULAR = 500
#: Wrappers of one host that a task aligns into one.
FAN = 64
#: Bytes of all hosts' wrappers that every worker may hold, so that pages stay where they are; more are joined.
SENT_BYTES = 4_000_000
#: Pages' item lists whose places in wrappers a worker keeps, over all hosts.
PLACES = 20_000
#: Bytes of html in a partition of the join of pages and wrappers.
PARTITION_BYTES = 64_000_000
#: Texts of a stale slot at least, by how much more of them are on another page than of the largest slots', and by how
#: much more of a heading's or of a slot inside an article.
STALE_TEXTS, STALE_MORE, STALE_MOST = 3, 0.05, 0.5
#: Longest repeated run of items that is folded.
RUN = 8

# HTML element names by their part in a page.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noembed noframes".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
_DROP = frozenset("head nav footer aside form script style noscript template iframe svg button select textarea dialog menu title object canvas input".split())
_INLINE = "a abbr b bdi bdo cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split()
_IN_LINE = f"(/({'|'.join(_INLINE)})([.!][^/]*)?)+$"
#: Landmark roles and the elements that have them by themselves.
_ROLES = {"navigation": "nav", "banner": "header", "contentinfo": "footer", "complementary": "aside", "search": "form", "form": "form", "dialog": "dialog", "alertdialog": "dialog", "main": "main", "article": "article"}
_CLOSES_P = _BLOCK - frozenset("body head html title td th tr tbody thead tfoot".split())
_SELF_CLOSING = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?:^|\s)(class|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): kind is open, close or text; rest is the element's label, or the text."""
    at = 0
    while at < len(page):
        found = _TOKEN.search(page, at)
        if not found:
            break
        if found.start() > at:
            yield "text", "", page[at : found.start()]
        at = found.end()
        if not found[2]:
            continue
        name = found[2].lower()
        if found[1]:
            yield "close", name, ""
            continue
        yield "open", name, _label(name, found[3]) if found[3] else name
        if name in _RAW:
            end = re.compile(f"</{re.escape(name)}", re.I).search(page, at)
            stop = end.start() if end else len(page)
            if stop > at:
                yield "text", "", page[at:stop]
            at = stop
    if at < len(page):
        yield "text", "", page[at:]


def _label(name: str, attributes: str) -> str:
    """name!element.words: the element that a landmark role makes of it, and the words of its class."""
    role, words = "", set()
    for key, value in _NAMED.findall(attributes):
        own = value.lower().strip("\"'").split()
        if key.lower() == "role":
            role = next((_ROLES[x] for x in own if x in _ROLES), "")
        else:
            words.update(w for w in (re.sub(r"[^a-z_-]+", "", x) for x in own) if w)
    return name + (f"!{role}" if role else "") + "".join(f".{w}" for w in sorted(words))


def _element(part: str) -> str:
    """The element of a part of a path, by its landmark role if it has one."""
    return part.split(".", 1)[0].rsplit("!", 1)[-1]


class Walk:
    """A page's events with the open elements kept as a browser would."""

    def __init__(self):
        #: (name, label)
        self.stack: list[tuple[str, str]] = []

    def opened(self, name: str, label: str) -> None:
        names = [n for n, _ in self.stack]
        if name in _CLOSES_P and "p" in names:
            self._close("p", ("td", "th", "button", "object"))
        if name in _SELF_CLOSING:
            own, barrier = _SELF_CLOSING[name]
            for other in own.split():
                self._close(other, barrier)
        if name not in _VOID:
            self.stack.append((name, label))

    def closed(self, name: str) -> None:
        self._close(name, ())

    def _close(self, name: str, barrier: tuple) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == name:
                del self.stack[k:]
                return
            if self.stack[k][0] in barrier:
                return

    def path(self) -> str:
        return "/".join([label for _, label in self.stack])


def parse(page: str) -> tuple[list[str], list[tuple[int, str, str, bool]]]:
    """Items of a page, and (item, path, text, whether a block begins before it) of its texts."""
    walk = Walk()
    items: list[str] = []
    texts: list[tuple[int, str, str, bool]] = []
    block = True
    for kind, name, rest in tokens(page):
        if kind == "text":
            text = entities.unescape(rest)
            if text.strip():
                items.append("#")
            texts.append((max(0, len(items) - 1), walk.path(), text, block))
            block = False
        elif kind == "open":
            walk.opened(name, rest)
            items.append(f"<{rest}>")
            block |= name in _BLOCK
            if name == "br":
                texts.append((len(items) - 1, walk.path(), " ", block))
                block = False
        else:
            walk.closed(name)
            items.append(f"</{name}>")
            block |= name in _BLOCK
    return items, texts


def shape(page: str) -> tuple[list[str], list[tuple[int, str, int, int]]]:
    """The folded items of a page, and (item, path, hash, characters) of its slots."""
    items, texts = parse(page)
    folded, place = fold(items)
    slots: dict[tuple[int, str], list] = {}
    for item, path, text, _ in texts:
        if text := " ".join(text.split()):
            own = slots.setdefault((place[item], path), [xxhash.xxh64(), 0])
            own[0].update(text.encode("utf-8", "surrogatepass") + b"\0")
            own[1] += len(text)
    return folded, [(*key, h.intdigest() - (1 << 64 if h.intdigest() >> 63 else 0), n) for key, (h, n) in sorted(slots.items())]


def fold(items: list[str]) -> tuple[list[str], list[int]]:
    """Leaf elements and runs that follow themselves as repeated groups; and the folded item that each item is in."""
    out: list[str] = []
    held: list[int] = []  # items in each folded one

    def join(n: int, group: str) -> None:
        out[-n:] = [group]
        held[-n:] = [sum(held[-n:])]

    for item in items:
        out.append(item)
        held.append(1)
        if len(out) >= 3 and out[-2] == "#" and item.startswith("</") and re.match(rf"<{re.escape(item[2:-1])}[.!>]", out[-3]):
            join(3, f"({out[-3]} # {item})+")
        changed = True
        while changed:
            changed = False
            for size in range(1, min(RUN, len(out) // 2) + 1):
                if out[-1] == out[-1 - size] and out[-size:] == out[-2 * size : -size]:
                    run = out[-size:]
                    join(2 * size, run[0] if size == 1 and run[0].endswith(")+") else f"({' '.join(run)})+")
                    changed = True
                    break
            # a group takes in another run of its own
            for size in range(1, min(RUN, len(out) - 1) + 1):
                if out[-size - 1].endswith(")+") and out[-size - 1] == f"({' '.join(out[-size:])})+":
                    join(size + 1, out[-size - 1])
                    changed = True
                    break
    return out, [k for k, n in enumerate(held) for _ in range(n)] or [0]


# A wrapper is a list of [item, optional, {path: characters}].


def align(wrapper: list[list], other: list[list]) -> list[list]:
    """One wrapper for both, where items of one side only become optional; both are subsequences of it."""
    if not wrapper or not other:
        return [[i, True, slots] for i, _, slots in wrapper or other]
    out: list[list] = []
    for tag, a, b, c, d in difflib.SequenceMatcher(None, [x[0] for x in wrapper], [x[0] for x in other], autojunk=False).get_opcodes():
        left, right = wrapper[a:b], other[c:d]
        if tag == "equal":
            out += [[i, o or p, _summed(x, y)] for (i, o, x), (_, p, y) in zip(left, right, strict=True)]
        else:
            out += [[i, True, slots] for i, _, slots in left + right]
    return out


def _summed(left: dict, right: dict) -> dict:
    out = dict(left)
    for path, chars in right.items():
        out[path] = out.get(path, 0) + chars
    return out


def expression(wrapper: list[list]) -> str:
    """The wrapper as a regular expression over items."""
    return " ".join(f"({x[0]})?" if x[1] else x[0] for x in wrapper)


def match(items: list[str], wrapper: list[list]) -> list[int]:
    """For each folded item of a page the item of the wrapper that it matches, -1 if none.

    An item matches the first equal one after the last that was matched; a page whose shape went into the wrapper
    is a subsequence of it, so all its items find one.
    """
    places: dict[str, list[int]] = {}
    for k, (item, *_) in enumerate(wrapper):
        places.setdefault(item, []).append(k)
    out, at = [], 0
    for item in items:
        own = places.get(item, [])
        k = bisect_left(own, at)
        out.append(own[k] if k < len(own) else -1)
        at = out[-1] + 1 if out[-1] >= 0 else at
    return out


def dropped(path: str, form: str = "") -> bool:
    """Whether an element on the path marks something other than main text; form is the path of one that wraps the page.

    A form around the article or main element, or around most of the page, does not; nor does a header inside those.
    """
    parts = path.split("/")
    names = [_element(x) for x in parts]
    main = next((k for k, x in enumerate(names) if x in ("article", "main")), len(names))
    for k, name in enumerate(names):
        if name == "form" and (k < main < len(names) or "/".join(parts[: k + 1]) == form):
            continue
        if name in _DROP or name == "header" and k < main:
            return True
    return names.count("article") > 1


def wrapping_form(sizes: dict[str, int]) -> str:
    """Path of the outermost form with most of the characters of {path: characters}, or ''."""
    held: dict[str, int] = {}
    total = 0
    for path, n in sizes.items():
        parts = path.split("/")
        names = [_element(x) for x in parts]
        if _DROP.isdisjoint(set(names) - {"form"}):
            total += n
            if "form" in names:
                key = "/".join(parts[: names.index("form") + 1])
                held[key] = held.get(key, 0) + n
    return next((p for p, n in held.items() if 2 * n > total), "")


class Chosen:
    """Which slots of a wrapper hold main text."""

    def __init__(self, wrapper: list[list], stale: dict[str, float] | None = None):
        self.wrapper = wrapper
        sizes: dict[str, int] = {}
        for _, _, slots in wrapper:
            sizes = _summed(sizes, slots)
        self.form = wrapping_form(sizes)
        open_ = {(k, path): n for k, (_, _, slots) in enumerate(wrapper) for path, n in slots.items() if not dropped(path, self.form)}
        self.region = next((x for x in ("article", "main") if any(x in map(_element, path.split("/")) for _, path in open_)), "")
        self.slots: dict[tuple[int, str], bool] = {}
        chars = {True: 0, False: 0}
        for (k, path), n in open_.items():
            item, more = wrapper[k][0], (stale or {}).get(re.sub(_IN_LINE, "", path), 0.0)
            menu = item.endswith(")+") and all("a" in map(_element, x.split("/")) for x in wrapper[k][2])
            heading = _HEADING.search(path)
            old = more > (STALE_MOST if self.region or heading else STALE_MORE) and not (self.region and heading)
            self.slots[k, path] = not old and (self.inside(path) and not comments(item) if self.region else not menu)
            chars[old] += n if self.inside(path) else 0
        if self.region and chars[True] >= chars[False]:  # copies of one article, it seems
            self.slots = {(k, path): self.inside(path) and not comments(wrapper[k][0]) for k, path in open_}
        if not any(self.slots.values()):  # nothing varies that could be the text instead
            self.slots = dict.fromkeys(open_, True)
        #: Paths with some slot of main text, for items that no page before had.
        self.paths = {path for (_, path), yes in self.slots.items() if yes}
        self.known: dict = {}

    def inside(self, path: str) -> bool:
        return self.region in map(_element, path.split("/"))

    def places(self, items: list[str]) -> list[int]:
        key = tuple(items)
        if key not in self.known:
            if len(self.known) >= 1_000:
                self.known.clear()
            self.known[key] = match(items, self.wrapper)
        return self.known[key]

    def holds(self, item: int, path: str) -> bool:
        yes = self.slots.get((item, path))
        return (path in self.paths or bool(self.region) and self.inside(path) and not dropped(path, self.form)) if yes is None else yes


_HEADING = re.compile(r"/h[1-6]\b")
_INNER = re.compile(r"<([a-z0-9]+)[^<>]*> # </\1>")
_HEADED = re.compile(r"<h[1-6][^a-z]|<t[rdh][^a-z]|<d[td][^a-z]|<figure")


def comments(item: str) -> bool:
    """Whether a repeated group is one of readers' comments: boxes of a line and a text, without heading or table."""
    return item.endswith(")+") and len(_INNER.findall(item)) > 1 and len(set(_INNER.findall(item))) > 1 and item.startswith(("(<div", "(<li", "(<section", "(<article")) and not _HEADED.search(item)


def extract(page: str | None, chosen: Chosen | None = None) -> str:
    """Main text of a page by its host's wrapper; by the page's own if it is null."""
    if not page:
        return ""
    items, texts = parse(page)
    folded, place = fold(items)
    if chosen is None:
        chosen = Chosen(_opened(folded, [(k, path, n) for k, path, _, n in shape(page)[1]]))
    at = chosen.places(folded)
    kept = [chosen.holds(at[place[item]], path) for item, path, _, _ in texts]
    if not any(k for k, x in zip(kept, texts, strict=True) if x[2].strip()) and chosen.region:
        # this page lacks the region that its host has elsewhere
        return extract(page)
    blocks: list[str] = []
    held: list[str] = []
    for (_, _, text, begins), keep in zip(texts, kept, strict=True):
        if begins:
            blocks.append("".join(held))
            held.clear()
        if keep or text == " " and held:
            held.append(text)
    blocks.append("".join(held))
    return "\n\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def _opened(items: list[str], slots: list[tuple]) -> list[list]:
    """The wrapper of one shape, from (item, path, characters)."""
    out = [[x, False, {}] for x in items]
    for k, path, chars in slots:
        out[k][2][path] = chars
    return out


_SLOTS = "host string, shape_id long, shape string, item int, path string, h long, chars long, page long"


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("host", pa.string()), ("shape_id", pa.int64()), ("shape", pa.string()), ("item", pa.int32()), ("path", pa.string()), ("h", pa.int64()), ("chars", pa.int64()), ("page", pa.int64())])
    for batch in batches:
        out: dict = {k: [] for k in schema.names}
        for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            items, slots = shape(page or "")
            own = json.dumps(items, ensure_ascii=False)
            whole = xxhash.xxh64_intdigest((page or "").encode("utf-8", "surrogatepass")) >> 1
            key = (host(url), xxhash.xxh64_intdigest(own.encode("utf-8", "surrogatepass")) >> 1)
            # the shape itself goes with the first row alone
            for row in [(*key, own, -1, "", 0, 0, whole), *[(*key, None, item, path, h, n, whole) for item, path, h, n in slots]]:
                for k, v in zip(schema.names, row, strict=True):
                    out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[k], schema.field(k).type) for k in schema.names], schema=schema)


def _open_shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, shape_id, shape, slots) -> (host, place, wrapper)."""
    for batch in batches:
        out = []
        for items, slots in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            own = [(x["item"], x["path"], x["chars"]) for x in slots if x["item"] >= 0]
            out.append(json.dumps(_opened(json.loads(items), own), ensure_ascii=False))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["host", "place", "wrapper"])


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by host and bucket, each with a wrapper -> one aligned row a host and bucket."""
    held: list | None = None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([held[0]], pa.string()), pa.array([held[1]], pa.int64()), pa.array([json.dumps(held[2], ensure_ascii=False)], pa.string())], names=["host", "place", "wrapper"])

    for batch in batches:
        for name, bucket, wrapper in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if held and held[:2] == [name, bucket]:
                held[2] = align(held[2], json.loads(wrapper))
            else:
                if held:
                    yield row()
                held = [name, bucket, json.loads(wrapper)]
    if held:
        yield row()


_ROW = "host string, place long, wrapper string"


def returning(slots: DataFrame) -> DataFrame:
    """host and stale, {path of a block: by how much more of its texts return on other pages than of the paths with most text}."""
    every = slots.where("item >= 0").groupBy("host", "path", "h", "page").agg(F.max("chars").alias("chars"))  # copies of a page count once
    # what a page has in one kind of block is one text
    texts = every.groupBy("host", F.regexp_replace("path", _IN_LINE, "").alias("path"), "page").agg(F.bit_xor(F.xxhash64("h")).alias("h"), F.sum("chars").alias("chars"))
    by_text = texts.groupBy("host", "path", "h").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    paths = by_text.groupBy("host", "path").agg(F.sum("n").alias("n"), (1 - F.count("*") / F.sum("n")).alias("returns"), F.sum("chars").alias("chars"))
    most = paths.groupBy("host").agg(F.max("chars").alias("most"))
    usual = paths.join(most, "host").where("2 * chars >= most").groupBy("host").agg(F.min("returns").alias("usual"))
    more = F.col("returns") - F.col("usual")
    return paths.join(usual, "host").where((F.col("n") >= STALE_TEXTS) & (more > STALE_MORE)).groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("path", more.alias("more")))).alias("stale"))


def infer(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """host, wrapper (JSON) and stale paths of every host."""
    slots = scratch.cut(pages.select("url", "html").mapInArrow(lean(_shapes), _SLOTS), "slots")
    summed = slots.groupBy("host", "shape_id", "item", "path").agg(F.max("shape").alias("shape"), F.sum("chars").alias("chars"))
    shapes = summed.groupBy("host", "shape_id").agg(F.max("shape").alias("shape"), F.collect_list(F.struct("item", "path", "chars")).alias("slots"))
    rows = scratch.cut(shapes.mapInArrow(_open_shapes, _ROW), "wrappers-0")
    level = 0
    while True:
        counts = rows.groupBy("host").agg(F.count("*").alias("n"))
        most = counts.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return rows.select("host", "wrapper").join(scratch.cut(returning(slots), "stale-paths"), "host", "left")
        # equal buckets by rank would need a sort of a host's rows; hashed ones differ little
        dealt = rows.join(counts, "host").withColumn("bucket", F.pmod(F.xxhash64("place", F.lit(level)), F.ceil(F.col("n") / FAN)))
        learnt = dealt.repartition("host", "bucket").sortWithinPartitions("host", "bucket", "place").select("host", "bucket", "wrapper").mapInArrow(_learn, _ROW)
        level += 1
        rows = scratch.cut(learnt, f"wrappers-{level}")
        scratch.drop(f"wrappers-{level - 1}")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by host and piece, the wrapper before its pages, which alone carries it."""
    place, chosen = None, None
    for batch in batches:
        out: dict = {"page_id": [], "url": [], "text": []}
        for name, piece, wrapper, stale, page_id, url, page in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            if (name, piece) != place:
                place, chosen = (name, piece), None
            if wrapper is not None:
                chosen = Chosen(json.loads(wrapper), dict(stale or ()))
                continue
            for k, v in zip(out, (page_id, url, extract(page, chosen)), strict=True):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out["page_id"], pa.int64()), pa.array(out["url"], pa.string()), pa.array(out["text"], pa.string()), pa.array(map(len, out["text"]), pa.int64())], names=["page_id", "url", "text", "n_chars"])


class Sent:
    """Wrappers of all hosts in a worker, opened when a page first needs them."""

    def __init__(self, rows: list[tuple]):
        self.rows = {name: (wrapper, stale) for name, wrapper, stale in rows}
        self.opened: dict[str, Chosen] = {}

    def of(self, name: str) -> Chosen | None:
        if name not in self.opened and name in self.rows:
            wrapper, stale = self.rows[name]
            self.opened[name] = Chosen(json.loads(wrapper), stale)
        return self.opened.get(name)

    def trim(self) -> None:
        if sum(len(x.known) for x in self.opened.values()) > PLACES:
            for x in self.opened.values():
                x.known.clear()


def _extract_where(sent):
    """page_id, url, html -> main text, by wrappers that the worker holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page, sent.value.of(host(url))) for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            sent.value.trim()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    wrappers = scratch.cut(infer(own, scratch), "host-wrappers")
    stale_bytes = F.octet_length(F.coalesce(F.to_json("stale"), F.lit("")))
    if (wrappers.agg(F.sum(F.octet_length("wrapper") + stale_bytes)).first()[0] or 0) <= SENT_BYTES:
        sent = own.sparkSession.sparkContext.broadcast(Sent([(r["host"], r["wrapper"], dict(r["stale"] or ())) for r in wrappers.collect()]))
        return own.mapInArrow(lean(_extract_where(sent)), "page_id long, url string, text string, n_chars long")
    name = F.lower(F.coalesce(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    counts = scratch.cut(own.groupBy(name.alias("host")).agg(F.count("*").alias("n"), F.sum(F.octet_length("html")).alias("size")), "host-counts")
    total, size = counts.agg(F.sum("n"), F.sum("size")).first()
    step = max(1, (total or 0) // POPULAR)
    # fewer than POPULAR hosts can have more than total / POPULAR pages each
    popular = counts.where(F.col("n") > step).select("host", F.ceil(F.col("n") / step).cast("int").alias("pieces"))
    dealt = own.withColumn("host", name).join(F.broadcast(popular), "host", "left").withColumn("piece", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("pieces", F.lit(1))).cast("int"))
    copies = wrappers.join(F.broadcast(popular), "host", "left").withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)))
    parts = max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // PARTITION_BYTES))
    none = F.lit(None)
    rows = copies.select("host", "piece", "wrapper", "stale", none.cast("long").alias("page_id"), none.cast("string").alias("url"), none.cast("string").alias("html"))
    rows = rows.unionByName(dealt.select("host", "piece", none.cast("string").alias("wrapper"), none.cast("map<string, double>").alias("stale"), "page_id", "url", "html"))
    together = rows.repartition(parts, "host", "piece").sortWithinPartitions("host", "piece", F.col("wrapper").isNull())
    return together.mapInArrow(lean(_extract), "page_id long, url string, text string, n_chars long")
