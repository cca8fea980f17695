"""Markup as node tables: XML, and HTML with its implied ends, parsed in one pass with a stack."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructField, StructType

#: A node in document order.  id: place in that order; parent; last: the last node inside it;
#: root: number of its tree, -1 for what belongs to none; depth: 0 for a root; place: among its
#: parent's children; name: local name, or #text, #comment, #stray, and #end for what follows the
#: last node; path: names from the root, null below PATH_DEPTH; text: of a text node, references as
#: they are; raw: the tag as written; lead: end tags between the node before and this; error: what
#: is wrong, null if nothing.
_INT, _STRING = IntegerType(), StringType()
NODE = StructType([StructField(n, _INT) for n in ("id", "parent", "last", "root", "depth", "place")] + [StructField("name", _STRING), StructField("path", _STRING), StructField("attributes", MapType(_STRING, _STRING))] + [StructField(n, _STRING) for n in ("text", "raw", "lead", "error")])
NODES = ArrayType(NODE)
PATH_DEPTH = 64

_ATTRIBUTE = re.compile(r"""([a-zA-Z0-9_:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
TAG_NAME = re.compile(r"[^\s/>]+")

# Elements of HTML without content, with raw content, and those that end others.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title"))
BLOCKS = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)} | dict.fromkeys(BLOCKS, ("p",))
#: Implied ends do not reach beyond these.
BOUNDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
NO_ELEMENT = frozenset(("html", "body"))
#: Inline elements that are left out when they hold no text, and what counts as content.
WRAPPERS = frozenset("span font b i u strong em sup sub".split())
CONTENT = frozenset(("img", "table", "iframe"))


class _Tree:
    """Nodes so far, the open elements, and the depths of each name's, so that each tag costs
    what it closes."""

    def __init__(self, tidy: bool = False) -> None:
        self.tidy, self.empty = tidy, 0
        self.nodes: list[dict] = []
        self.open: list[dict] = []
        self.names: dict[str, list[int]] = {}
        self.roots = 0
        self.lead: list[str] = []

    def add(self, name: str, element: bool = False, **more) -> dict:
        up = self.open[-1] if self.open else None
        depth = len(self.open)
        path = None if depth >= PATH_DEPTH else name if up is None else f"{up['path']}/{name}"
        root, place = (up["root"], up["children"]) if up else (self.roots, self.roots)
        node = {"id": len(self.nodes), "parent": up and up["id"], "last": len(self.nodes), "root": root, "depth": depth, "place": place, "name": name, "path": path, "attributes": None, "text": None, "raw": None, "lead": "".join(self.lead) if self.lead else "", "error": None, "children": 0, "blank": True}
        node.update(more)
        self.lead = []
        self.nodes.append(node)
        if up and (name in CONTENT or (node["text"] or "").strip()):
            up["blank"] = False
        if up:
            up["children"] += 1
        else:
            self.roots += 1
        return node

    def enter(self, node: dict) -> None:
        self.names.setdefault(node["name"].lower(), []).append(len(self.open))
        self.open.append(node)

    def leave(self, error: str | None = None, written: str | None = None) -> None:
        node = self.open.pop()
        self.names[node["name"].lower()].pop()
        node["last"] = len(self.nodes) - 1
        node["error"] = node["error"] or error
        up = self.open[-1] if self.open else None
        if up and not node["blank"]:
            up["blank"] = False
        if self.tidy and node["blank"] and node["name"].lower() in WRAPPERS:
            del self.nodes[node["id"] :]
            self.lead = [node["lead"]]
            self.empty += 1
            if up:
                up["children"] -= 1
            else:
                self.roots -= 1
            return
        self.lead.append(written or f"</{node['tag']}>")

    def stray(self, raw: str, error: str) -> None:
        self.add("#stray", raw=raw, error=error, root=-1)

    def holds(self, name: str, bounds: tuple[str, ...]) -> bool:
        """Whether `name` is open, above any of `bounds`."""
        deepest = lambda n: (self.names.get(n) or [-1])[-1]
        return deepest(name) > max(map(deepest, bounds))


def attributes_of(tag: str, html: bool = False) -> dict[str, str]:
    """Attributes by local name, of HTML in lower case; the last of equal names counts."""
    out: dict[str, str] = {}
    if "=" not in tag:
        return out
    for name, a, b, c in _ATTRIBUTE.findall(tag):
        local = name.rpartition(":")[2]
        out[local.lower() if html else local] = a or b or c
    return out


#: Tags up to so many characters are read once for many.
TAG = 200


@lru_cache(4096)
def _tag(raw: str, html: bool) -> tuple[str, str, dict[str, str]]:
    """A tag's name as written, its name, and the attributes of a start tag."""
    end = raw[1] == "/"
    named = TAG_NAME.match(raw, 2 if end else 1)
    tag = named[0] if named else ""
    return tag, tag.lower() if html else tag.rpartition(":")[2], {} if end else attributes_of(raw[1 + len(tag) : -1], html)


class _Marks:
    """Places of `<` and `>` and of what ends a comment, each looked for once."""

    def __init__(self, text: str):
        self.text, self.none = text, set()

    def find(self, what: str, at: int) -> int:
        if what in self.none:
            return -1
        found = self.text.find(what, at)
        if found < 0:
            self.none.add(what)
        return found


def parsed(text: str | None, html: bool = False, implied: bool = True, tree: _Tree | None = None) -> list[dict] | None:
    """Nodes of XML, or of HTML.  A null text has none.

    XML: names and attributes lose their prefixes, comments and declarations go, white space
    before a text goes, text outside of elements too; an end tag ends the innermost element,
    with an error if its name is another.  HTML: comments are nodes, all text is kept; an end tag
    without its element is a stray; with `implied`, `html` and `body` are no elements, and
    paragraphs, items, rows and cells end where the next begins.  Elements still open at the end
    are marked `unclosed`, those open where an outer one ends `crossed`, other implied ends `implied`.
    """
    if text is None:
        return None
    tree, marks, at, n = tree or _Tree(), _Marks(text), 0, len(text)
    while at < n:
        start = marks.find("<", at)
        start = n if start < 0 else start
        if start > at:
            said = text[at:start] if html else text[at:start].lstrip()
            if said and (html or tree.open):
                tree.add("#text", text=said)
            at = start
            continue
        opens = {"<!--": "-->", "<?": "?>", "<!": ">"}
        skip = next((k for k in opens if text.startswith(k, at)), None)
        end = marks.find(opens[skip], at + len(skip)) if skip else -1
        if skip and end >= 0:
            end += len(opens[skip])
            if html:
                tree.add("#comment", raw=text[at:end])
            at = end
            continue
        end = marks.find(">", at)
        if end < 0 or (html and not re.match(r"</?[a-zA-Z]", text[at : at + 3])):
            if html:  # a sign, not a tag
                stop = marks.find("<", at + 1) if end >= 0 or marks.find("<", at + 1) >= 0 else -1
                stop = n if stop < 0 else stop
                tree.add("#text", text=text[at:stop])
                at = stop
            else:
                tree.stray(text[at:], "tag without end")
                at = n
            continue
        raw = text[at : end + 1]
        at = end + 1
        tag, name, attributes = _tag(raw, html) if len(raw) < TAG else _tag.__wrapped__(raw, html)
        if raw[1] == "/":
            if html and implied and name in NO_ELEMENT:
                continue
            if not tree.open or html and not tree.names.get(name):
                tree.stray(raw, "end without start")
            elif html:
                while tree.open[-1]["name"] != name:
                    tree.leave("crossed")
                tree.leave(written=raw)
            else:
                tree.leave(None if tree.open[-1]["tag"] == tag else f"ended by {raw}", written=raw)
            continue
        if html and implied:
            if name in NO_ELEMENT:
                continue
            for other in ENDS.get(name, ()):
                bounds = BOUNDS.get(name, ("td", "th", "table", "button"))
                if tree.holds(other, bounds):
                    while tree.open[-1]["name"] != other:
                        tree.leave("crossed")
                    tree.leave("implied")
        node = tree.add(name, attributes=attributes, raw=raw, tag=tag)
        if raw.endswith("/>") or html and name in VOID:
            continue
        tree.enter(node)
        if html and name in RAW:
            close = re.compile(rf"</{name}\b", re.I).search(text, at) if f"</{name}" not in marks.none else None
            if not close:
                marks.none.add(f"</{name}")
            stop = close.start() if close else n
            if stop > at:
                tree.add("#text", text=text[at:stop])
            at = stop
    while tree.open:
        tree.leave("unclosed")
    if tree.lead:
        tree.add("#end", root=-1)
    return tree.nodes


def xml_nodes(text: str | None) -> list[dict] | None:
    return parsed(text)


def html_nodes(text: str | None) -> list[dict] | None:
    return parsed(text, html=True)


def tag_nodes(text: str | None) -> list[dict] | None:
    """Nodes of HTML as its tags say, without implied ends."""
    return parsed(text, html=True, implied=False)


REPAIRED = StructType([StructField("html", _STRING)] + [StructField(n, _INT) for n in ("unclosed", "crossed", "stray", "empty")])


@F.udf(returnType=REPAIRED, useArrow=True)
def repaired(text):
    """HTML whose every element ends once, in order, and how many repairs of each kind it took:
    ends added at the end of the page and where an outer element ends, end tags without an
    element that go, inline elements without text or image that go.  What needs none of these is
    unchanged.  Null stays null."""
    return mended(text)


def mended(text: str | None) -> dict | None:
    if text is None:
        return None
    tree = _Tree(tidy=True)
    nodes = parsed(text, html=True, implied=False, tree=tree)
    errors = [n["error"] for n in nodes if n["error"]]
    kept = "".join(n["lead"] + (n["text"] or ("" if n["name"] == "#stray" else n["raw"] or "")) for n in nodes)
    return {"html": kept, "unclosed": errors.count("unclosed"), "crossed": errors.count("crossed"), "stray": errors.count("end without start"), "empty": tree.empty}


_OPEN = re.compile(r"<(?:m:)?(oMathPara|oMath)\b|<(math)\b", re.I)
_CLOSE = {"omathpara": re.compile(r"</(?:m:)?oMathPara\s*>", re.I), "omath": re.compile(r"</(?:m:)?oMath\s*>", re.I), "math": re.compile(r"</math\s*>", re.I)}


def formula_spans(text: str) -> list[tuple[int, int]]:
    """Where formulas stand in a page: elements oMathPara, oMath or math up to the next end of that
    name; those without one are none.  A name whose ends are all behind is not looked for again."""
    out, at, none = [], 0, set()
    while m := _OPEN.search(text, at):
        name, at = (m[1] or m[2]).lower(), m.end()
        end = None if name in none else _CLOSE[name].search(text, at)
        if end:
            at = end.end()
            out.append((m.start(), at))
        else:
            none.add(name)
    return out


#: A task gives its nodes in batches of about so many, however many pages they are of.
NODES_AT_ONCE = 20_000
_FIELDS = {f.name: f for f in NODE}


def _columns(pages: list[list[dict] | None], fields: tuple[str, ...]) -> pa.Array:
    """Node arrays of pages, column by column."""
    nodes = [n for p in pages for n in p or ()]
    offsets = list(accumulate((len(p or ()) for p in pages), initial=0))
    arrays = []
    for f in fields:
        values = [n[f] for n in nodes]
        if f == "attributes":
            starts = list(accumulate((len(v or ()) for v in values), initial=0))
            keys = pa.array([k for v in values if v for k in v], pa.string())
            items = pa.array([x for v in values if v for x in v.values()], pa.string())
            none = pa.array([v is None for v in values] + [False]).to_numpy(zero_copy_only=False)
            arrays.append(pa.MapArray.from_arrays(pa.array(starts, pa.int32(), mask=none), keys, items))
        else:
            arrays.append(pa.array(values, pa.int32() if _FIELDS[f].dataType == _INT else pa.string()))
    struct = pa.StructArray.from_arrays(arrays, list(fields))
    return pa.ListArray.from_arrays(pa.array([None if i < len(pages) and pages[i] is None else o for i, o in enumerate(offsets)], pa.int32()), struct)


def with_nodes(df: DataFrame, parse, column: str, *keys: str, fields: tuple[str, ...] = tuple(_FIELDS)) -> DataFrame:
    """The keys of documents and their `nodes` by one of the parsers above, with these fields.
    They are made in batches of NODES_AT_ONCE, so that a task holds few pages' nodes, and once."""
    docs = df.select(*keys, F.col(column).alias("__text"))
    names = [*docs.columns[:-1], "nodes"]

    def run(batches):
        for batch in batches:
            held, n, start = [], 0, 0
            for i, text in enumerate(batch.column(batch.num_columns - 1)):
                nodes = parse(text.as_py())
                held.append(nodes)
                n += len(nodes or ())
                if n >= NODES_AT_ONCE or i == batch.num_rows - 1:
                    at = [c.slice(start, len(held)) for c in batch.columns[:-1]]
                    yield pa.RecordBatch.from_arrays([*at, _columns(held, fields)], names)
                    held, n, start = [], 0, i + 1

    return docs.mapInArrow(run, StructType([*docs.schema.fields[:-1], StructField("nodes", ArrayType(StructType([_FIELDS[f] for f in fields])))]))


def node_table(df: DataFrame, parse, column: str, *keys: str, fields: tuple[str, ...] = tuple(_FIELDS)) -> DataFrame:
    """A row for each node of the documents, with their keys."""
    return with_nodes(df, parse, column, *keys, fields=fields).select(*keys, F.inline("nodes"))


def written(nodes: Column, tag=lambda n: n["raw"]) -> Column:
    """The document of a node array, with `tag` for start tags: as it was, but that every element
    that was open has its end.  One pass."""
    return F.array_join(F.transform(nodes, lambda n: F.concat(n["lead"], F.coalesce(n["text"], tag(n), F.lit("")))), "")


def within(nodes: Column, of: Column) -> Column:
    """Nodes inside a node."""
    return F.slice(nodes, of["id"] + 2, of["last"] - of["id"])


def has_end(n: Column) -> Column:
    return ~n["name"].startswith("#") & ~n["raw"].endswith("/>") & ~F.lower(n["name"]).isin(*VOID)
