"""Main text of web pages by wrapper induction.

The DOM trees of all different pages of a host are aligned with a model page by simple tree matching
(``dom.match``): a host has one model for each of its layouts (the set of its container tags and classes)
of at least ``LAYOUT_PAGES`` pages, and the model of its largest layout serves the rest. What corresponds
to one node of the model is one slot of the wrapper. A text that stands in its slot on most pages is
constant and so template. Where texts vary there is content, but menus, adverts and footers vary too; so
slots are weighed by the characters that vary in them over all pages of the model, links not counted:

* the content region is found from the root down, always into the part that holds ``DOMINANT`` of the varying
  text; an ``article`` or ``main`` is the region at once if it holds half of it;
* slots outside the region are left out, but for headings beside the way down to it; so are slots whose
  varying text stands mostly in links, outside an ``article`` or ``main``;
* what HTML itself marks (``nav``, ``footer``, ``aside``, ``form``, ``hidden``, roles, ...) weighs nothing and is left out,
  headings in a ``header`` too;
* class and id are no proof. A region that they name as advert, comments and the like is left out, unless the text
  beside all such regions is less than a third of its own, headings not counted, and no ``article`` or ``main`` stands there: then the
  name is that of the article. A region with a doubtful name (notice, banner, related, ...) is left out unless it holds most of
  the text.

A text of a page without partner in the model belongs to the slot of its next ancestor that has one.

Nothing is sampled: each page sends the shape of its tree and the hashes of its texts, copies of a page are
dropped, and texts are counted by model and slot with partial aggregation. Models and wrappers (a few
hundred bytes each) are broadcast if their table is small, and joined otherwise; a host with many pages is
dealt out by salt then, so it is no hot key.

Defined results: null or empty html gives the empty text; so does a page without main text. A page without
a host, or the only different page of its host, is its own model: it has no constant texts, and its region
is found from its own text. With two pages, texts of both are template, inside an ``article`` or ``main`` from
three pages on. Repeated rows give equal rows; copies of a page count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from graphloom.llm import dom
from graphloom.llm.common import materialise, table

#: A text is template if it stands in its slot on at least this share of the other pages of the model, and on at
#: least 2 of them (on the other one, if there are 2 pages).
CONSTANT = 0.6
#: Layouts of fewer different pages are aligned with the model of their host.
LAYOUT_PAGES = 3
#: The content region is sought further in a part that holds this share of the varying text.
DOMINANT = 0.6
#: A slot with more of its varying characters in links than this is a menu.
LINK_SHARE = 0.5
#: A region named as no part of the article stays if the text beside such regions is at most this share of its own.
BESIDE = 1 / 3
#: Tables of models or wrappers of at most so many bytes are broadcast.
BROADCAST_BYTES = 8_000_000
#: Beyond it, a layout of more pages than this is dealt out by salt.
SALT_PAGES = 100_000

_CONTAINER = (
    r"(?i)<(?:article|aside|div|dl|fieldset|footer|form|header|main|nav|ol|section|table|ul)"
    r"(?=[\s/>])(?:[^>]*?\sclass\s*=\s*(?:\"[^\"]*\"|'[^']*'))?"
)


class Wrapper:
    """A model with the slots that hold content, and the template texts by slot."""

    def __init__(self, model: dom.Tree, keep: list[bool], constant: frozenset[tuple[int, int]] | set[tuple[int, int]] = frozenset()):
        self.model, self.keep, self.constant = model, keep, constant


def misnamed(model: dom.Tree, unlinked: dict[int, int]) -> list[bool]:
    """The named regions that are left out: those beside which the article stands. ``unlinked``: slot -> varying characters
    outside links. In a region that stays, the regions within are judged in the same way."""
    n = len(model.parent)
    total, inner, scope, main = [0] * n, [0] * n, [0] * n, [False] * n
    in_heading = [False] * n
    for i in range(1, n):
        up = model.parent[i]
        in_heading[i] = in_heading[up] or bool(model.mark[i] & dom.HEADING)
        scope[i] = up if model.mark[up] & dom.NAMED else scope[up]
    for i, k in unlinked.items():
        total[i] = 0 if in_heading[i] else k
    for i in range(n - 1, 0, -1):
        total[model.parent[i]] += total[i]
    named: dict[int, list[int]] = {}
    for i in range(1, n):
        if model.mark[i] & dom.NAMED:
            named.setdefault(scope[i], []).append(i)
            inner[scope[i]] += total[i]
        elif model.mark[i] & dom.MAIN and not model.mark[i] & dom.OUT and total[i]:
            main[scope[i]] = True
    out, todo = [False] * n, [0]
    while todo:
        at = todo.pop()
        beside, most = total[at] - inner[at], max((total[i] for i in named.get(at, ())), default=0)
        for i in named.get(at, ()):
            if main[at] or not total[i] or beside > BESIDE * total[i] or 2 * total[i] < most:
                out[i] = True
            else:
                todo.append(i)
    return out


def decide(model: dom.Tree, varying: dict[int, tuple[int, int]]) -> list[bool]:
    """For each node of the model whether its texts are content; ``varying``: slot -> characters that vary, and those in links."""
    n = len(model.parent)
    total, unlinked, linked = [0] * n, [0] * n, [False] * n
    for slot, (chars, links) in varying.items():
        linked[slot] = links > LINK_SHARE * chars
        total[slot] = 0 if linked[slot] or model.mark[slot] & dom.OUT else chars - links
    out = misnamed(model, dict(enumerate(total)))
    out = [o or bool(m & dom.OUT) for o, m in zip(out, model.mark)]
    for i in range(1, n):
        out[i] |= out[model.parent[i]]
        total[i] = 0 if out[i] else total[i]
    for i in range(n - 1, 0, -1):
        total[model.parent[i]] += total[i]
    for i in range(1, n):  # doubtful names hold only for the lesser part of the text
        up = model.parent[i]
        out[i] |= out[up]
        if model.mark[i] & dom.DOUBTFUL and not model.mark[up] & dom.DOUBTFUL and not out[i] and 2 * total[i] <= total[0]:
            out[i] = True
    for slot in varying:
        unlinked[slot] = 0 if out[slot] or linked[slot] else varying[slot][0] - varying[slot][1]
    kids: list[list[int]] = [[] for _ in range(n)]
    for i in range(n - 1, 0, -1):
        unlinked[model.parent[i]] += unlinked[i]
        kids[model.parent[i]].append(i)
    tops = [i for i in range(1, n) if model.mark[i] & dom.MAIN and not model.mark[model.parent[i]] & dom.MAIN and not out[i]]
    if tops and 2 * sum(unlinked[i] for i in tops) >= unlinked[0]:
        regions = tops
        above = {model.parent[i] for i in tops}
    else:
        at, above = 0, set()
        while True:
            best = max(kids[at], key=lambda i: unlinked[i], default=None)
            holder = best is not None and kids[best] and not model.mark[best] & (dom.REPEATS | dom.HEADING)
            if not holder or not unlinked[best] or unlinked[best] < DOMINANT * unlinked[at]:
                break
            above.add(at)
            at = best
        regions = [at]
    keep = [False] * n
    for i in regions:
        keep[i] = True
    for i in range(1, n):
        keep[i] = keep[i] or keep[model.parent[i]] or bool(model.mark[i] & dom.HEADING and model.parent[i] in above)
    return [k and not out[i] and (not linked[i] or bool(model.mark[i] & dom.MAIN)) for i, k in enumerate(keep)]


def texts_of(page: dom.Tree) -> list[int]:
    """The text nodes that are not marked as left out."""
    return [i for i, k in enumerate(page.label) if not k and not page.mark[i] & dom.OUT]


def slot_of(partner: int) -> int:
    return partner if partner >= 0 else -1 - partner


def alone(page: dom.Tree) -> Wrapper:
    """The wrapper of a page that has no other to align with."""
    varying = {i: (page.chars[i], page.linked[i]) for i in texts_of(page)}
    return Wrapper(page, decide(page, varying))


def main_text(page: str | None, wrapper: Wrapper | None = None, shapes: dom.Shapes | None = None) -> str:
    """The text of a page by a wrapper; without one, by the page itself."""
    if not page:
        return ""
    tree = dom.parse(page)
    if wrapper is None:
        wrapper = alone(tree)
        partners = list(range(len(tree.parent)))
    else:
        partners = dom.match(tree, wrapper.model, shapes)
    out = []
    for i in texts_of(tree):
        slot = slot_of(partners[i])
        if not wrapper.keep[slot] or (slot, tree.key[i]) in wrapper.constant:
            continue
        if partners[i] < 0:  # no node of the model vouches for it: its own marks and links decide
            if tree.mark[i] & ~wrapper.model.mark[slot] & (dom.DOUBTFUL | dom.WITHIN):
                continue
            if tree.linked[i] > LINK_SHARE * tree.chars[i] and not tree.mark[i] & dom.MAIN:
                continue
        out.append(tree.text[i])
    return "\n\n".join(out)


def host_of(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def layout_of(html: str) -> Column:
    """A key of the set of container tags of a page, with their classes; digits count as equal."""
    tags = F.transform(F.regexp_extract_all(html, F.lit(_CONTAINER), F.lit(0)), lambda x: F.regexp_replace(F.lower(x), r"\d+", "0"))
    return F.xxhash64(F.array_join(F.array_sort(F.array_distinct(tags)), "\n"))


class _Cache:
    """What was read last, by key; emptied when it has grown."""

    def __init__(self, read, limit: int = 512):
        self.read, self.limit, self.known, self.shapes = read, limit, {}, dom.Shapes()

    def get(self, key, *values):
        if key not in self.known:
            if len(self.known) >= self.limit or len(self.shapes.known) + len(self.shapes.weights) > 500_000:
                self.known, self.shapes = {}, dom.Shapes()
            self.known[key] = self.read(*values)
        return self.known[key]


def _meet(rows: DataFrame, models: DataFrame, size: Column, row_hash: Column) -> DataFrame:
    """``rows`` (host, layout) with their model: broadcast if the table of models is small, else joined, large layouts by salt."""
    on = ["host", "layout"]
    used = models.agg(F.coalesce(F.sum(size + F.length("host") + 64), F.lit(0)).alias("n")).first()["n"]
    if used <= BROADCAST_BYTES:
        return rows.join(F.broadcast(models), on, "left")
    hot = models.where(F.col("rows") > SALT_PAGES).select(*on, F.ceil(F.col("rows") / SALT_PAGES).cast("int").alias("salts"))
    rows = rows.join(F.broadcast(hot), on, "left")  # at most a row for each SALT_PAGES pages
    rows = rows.withColumn("salt", F.pmod(row_hash, F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    last = F.ceil(F.col("rows") / SALT_PAGES).cast("int") - 1
    return rows.join(models.withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(last, F.lit(0))))), [*on, "salt"], "left").drop("salt")


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(host, layout, rows, model, keep, slots, keys)``: the wrapper that each layout of each host uses."""

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = pa.array([dom.parse(p).pack() for p in b.column("html").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("layout"), b.column("h"), packed], names=["host", "layout", "h", "tree"])

    keyed = pages.select(host_of(url).alias("host"), layout_of(html).alias("layout"), F.xxhash64(html).alias("h"), F.col(html).alias("html"))
    each = keyed.where("html <> '' AND host <> ''").mapInArrow(trees, "host string, layout bigint, h bigint, tree binary")
    each = each.groupBy("host", "layout", "h").agg(F.first("tree").alias("tree"), F.count(F.lit(1)).alias("copies"))
    each = materialise(each, "html-trees", "zstd")
    layouts = each.groupBy("host", "layout").agg(F.count(F.lit(1)).alias("pages"), F.sum("copies").alias("rows"), F.min("h").alias("h"))
    largest = layouts.groupBy("host").agg(F.max(F.struct("pages", "layout", "h")).alias("top"))
    own = F.col("pages") >= LAYOUT_PAGES
    plan = layouts.join(largest, "host").select(
        "host", "layout", "rows", "pages", F.when(own, F.col("layout")).otherwise(F.col("top.layout")).alias("of"),
        F.when(own, F.col("h")).otherwise(F.col("top.h")).alias("of_h"),
    )
    plan = materialise(plan, "html-layouts")
    used = plan.groupBy("host", "of", "of_h").agg(F.sum("pages").alias("aligned"))
    models = each.select("host", F.col("layout").alias("of"), F.col("h").alias("of_h"), "tree").join(used, ["host", "of", "of_h"])
    models = materialise(models.select("host", "of", "aligned", F.col("tree").alias("model")), "html-models", "zstd")
    by_layout = plan.join(models, ["host", "of"])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Cache(dom.Tree.unpack)
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for host, of, aligned, tree, model in zip(*(b.column(c).to_pylist() for c in ("host", "of", "aligned", "tree", "model"))):
                m, t = cache.get((host, of), model), dom.Tree.unpack(tree)
                partners, seen = dom.match(t, m, cache.shapes), {}
                for i in texts_of(t):
                    at = slot_of(partners[i]), t.key[i]
                    chars, linked = seen.get(at, (0, 0))
                    seen[at] = chars + t.chars[i], linked + t.linked[i]
                for (slot, key), (chars, linked) in seen.items():
                    for c, v in zip(cols, (host, of, aligned, slot, key, chars, linked)):
                        c.append(v)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["host", "of", "aligned", "slot", "key", "chars", "linked"])

    rows = _meet(each.select("host", "layout", "h", "tree"), by_layout, F.length("model"), F.col("h"))
    texts = rows.select("host", "of", "aligned", "tree", "model").mapInArrow(
        align, "host string, of bigint, aligned bigint, slot int, key bigint, chars bigint, linked bigint"
    )
    # copies of a text within its slot are counted first, so a slot of a hot host is spread over the hashes of its texts
    counted = texts.groupBy("host", "of", "aligned", "slot", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    others = F.col("aligned") - 1
    constant = (F.col("n") > 1) & (F.col("n") - 1 >= F.greatest(F.least(F.lit(2), others).cast("double"), CONSTANT * others))
    slots = counted.groupBy("host", "of", "slot").agg(
        F.sum(F.when(constant, 0).otherwise(F.col("chars"))).alias("chars"), F.sum(F.when(constant, 0).otherwise(F.col("linked"))).alias("linked"),
        F.collect_set(F.when(constant, F.col("key"))).alias("keys"), F.sum(F.when(constant, F.col("chars")).otherwise(0)).alias("fixed"),
    )
    # as many slots as a model has nodes; as many constant texts as a page has texts, by 1 / CONSTANT at most
    facts = slots.groupBy("host", "of").agg(F.collect_list(F.struct("slot", "chars", "linked", "keys", "fixed")).alias("facts"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, at, keys = [], [], []
            for model, aligned, found in zip(*(b.column(c).to_pylist() for c in ("model", "aligned", "facts"))):
                tree, varying, fixed = dom.Tree.unpack(model), {}, []
                for f in found or []:
                    if aligned < 3 and tree.mark[f["slot"]] & dom.MAIN:  # two pages that share an article
                        varying[f["slot"]] = f["chars"] + f["fixed"], f["linked"]
                    else:
                        varying[f["slot"]] = f["chars"], f["linked"]
                        fixed += [(f["slot"], k) for k in f["keys"]]
                keep.append(np.array(decide(tree, varying), np.uint8).tobytes())
                at.append([s for s, _ in fixed])
                keys.append([k for _, k in fixed])
            yield pa.RecordBatch.from_arrays(
                [b.column("host"), b.column("of"), pa.array(keep, pa.binary()), pa.array(at, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.int64()))],
                names=["host", "of", "keep", "slots", "keys"],
            )

    settled = models.join(facts, ["host", "of"], "left").mapInArrow(settle, "host string, of bigint, keep binary, slots array<int>, keys array<bigint>")
    return by_layout.join(settled, ["host", "of"]).select("host", "layout", "of", "rows", "model", "keep", "slots", "keys")


def _read(model: bytes, keep: bytes, slots: list[int], keys: list[int]) -> Wrapper:
    return Wrapper(dom.Tree.unpack(model), [bool(x) for x in keep], frozenset(zip(slots, keys)))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)``, a row for each row of ``pages``."""
    found = materialise(wrappers(pages, url, html), "html-wrappers", "zstd")
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(url).alias("host"), layout_of(html).alias("layout")
    )
    rows = _meet(rows, found, F.length("model") + F.length("keep") + F.size("slots") * 12, F.xxhash64("html", "page_id"))
    kind = pages.schema[page_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Cache(_read)
        names = ("html", "host", "of", "model", "keep")
        for b in batches:
            texts = []
            for i, (page, host, of, model, keep) in enumerate(zip(*(b.column(c).to_pylist() for c in names))):
                if model is None:
                    texts.append(main_text(page))
                    continue
                key = host, of
                w = cache.known.get(key) or cache.get(key, model, keep, b.column("slots")[i].as_py(), b.column("keys")[i].as_py())
                texts.append(main_text(page, w, cache.shapes))
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = rows.select("page_id", "url", "html", "host", "of", "model", "keep", "slots", "keys")
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")


def op10_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
