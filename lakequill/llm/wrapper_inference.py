"""Main text of pages by wrappers: union-free regular expressions inferred from pages of one host.

A page becomes a stream of block-level tags with text slots. Streams of one host are aligned one after the other with the wrapper so
far; where they differ, the difference is resolved without unions:

* the same group of tokens once or more often in a row becomes a repeated group ``(...)+``,
* tokens that only one side has become an optional group ``(...)?``,
* different texts at one place become a slot, equal ones stay constant text.

Pages of a host are dealt into PARTS by their hash and aligned in its order, then the wrappers of the parts are aligned in turn, so
a wrapper does not depend on how the table is split. Copies of a page count once.

The wrapper says where a host's main text is: from the root it goes down, to the element that holds most of the text in slots
(characters outside links and outside parts that are no main text by themselves), and stops where no child holds most of
it. Semantic elements only weigh more there. The main text of a page is what stands in that element, without constants of the
wrapper at their places and without menus, forms, adverts, notices or comments. A page that lacks the element is its own wrapper.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .html_tree import INLINE, INVISIBLE, VOID, Blocks, Token, tokens

#: Pages of different texts that a constant text must stand in to count as part of a host's template.
TEMPLATE_PAGES = 3
#: Tokens of a repeated group, at most.
GROUP_TOKENS = 12

#: Parts that the pages of a host are dealt into.
PARTS = 64
#: What a child must hold of its parent's text for the main text to be looked for inside it.
MOST = 0.6
#: How much more characters count in elements that are marked as main text.
MARKED_WEIGHT = 1000

# Elements, roles and class words of parts that are no main text.
BOILERPLATE = frozenset("nav footer aside form button select input textarea dialog menu fieldset datalist".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Words that say so wherever they stand in a class or id.
STRONG_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr newsletter subscribe subscription signup"
    " navbar navigation breadcrumb breadcrumbs pagination pager sidebar sidenav footer masthead comment comments commentlist respond reply replies disqus"
    " outbrain taboola".split()
)
#: Words that say so as a whole class or id; as a part of one only if the element is constant or mostly links.
WEAK_WORDS = frozenset("promo promotion banner notice notices popup modal overlay login nav navi menu widget widgets toolbar share sharing social related recommended recommendations header aside".split())
CONTAINERS = frozenset("html body main article section div table tbody tr td ul ol dl center form fieldset details".split())
HEADINGS = frozenset(f"h{n}" for n in range(1, 7))


def _words(attrs: dict) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()) if w]


def is_main(name: str, attrs: dict) -> bool:
    return name in ("article", "main") or attrs.get("role", "").lower() == "main"


def is_boilerplate(name: str, attrs: dict, in_main: bool, linked: float = 0.0) -> bool:
    """Is an element no main text by itself; ``linked`` is the share of its characters in links."""
    if name in INVISIBLE or name in BOILERPLATE or attrs.get("role", "").lower() in BOILERPLATE_ROLES:
        return True
    if name in ("html", "body", "main") or name in HEADINGS:
        return False
    if name == "header" and not in_main:
        return True
    if not attrs:
        return False
    words = _words(attrs)
    if not STRONG_WORDS.isdisjoint(words):
        return True
    if WEAK_WORDS.isdisjoint(words):
        return False
    whole = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split()
    return linked > 0.5 or not WEAK_WORDS.isdisjoint(whole)


# --- streams and wrappers ------------------------------------------------------------------------------------------


def _mark(token: Token) -> str:
    """An element as streams and paths name it."""
    words = ".".join(sorted(_words(token.value))) if token.value else ""
    role = token.value.get("role", "").lower() if token.value else ""
    return f"<{token.name}{'.' + words if words else ''}{'@' + role if role else ''}>"


def stream(page: list[Token]) -> list:
    """Block-level tags and text slots of a page: "<name.class@role>", "</name>" or ["#", hash of the text, characters, those in links]."""
    out: list = []
    text: list[str] = []
    hidden = anchors = linked = 0

    def slot() -> None:
        nonlocal linked
        if text:
            whole = " ".join(text)
            out.append(["#", xxhash.xxh3_64_hexdigest(whole), len(whole), min(linked, len(whole))])
            text.clear()
            linked = 0

    for token in page:
        if token.kind == "text":
            if not hidden and (words := token.value.split()):
                text.extend(words)
                if anchors:
                    linked += sum(map(len, words)) + len(words)
        elif token.name in INVISIBLE:
            hidden += 1 if token.kind == "open" else -1
        elif token.name == "a":
            anchors += 1 if token.kind == "open" else -1
        elif token.name not in INLINE and not hidden:
            slot()
            if token.kind == "open":
                out.append(_mark(token))
            elif token.name not in VOID:
                out.append(f"</{token.name}>")
    slot()
    return _fold_leaves(out)


def _fold_leaves(items: list) -> list:
    """The commonest repeats first, in one pass: elements that hold nothing but a text."""
    out: list = []
    i = 0
    while i < len(items):
        leaf = items[i : i + 3]
        if len(leaf) == 3 and leaf[0][0] == "<" and leaf[1][0] == "#" and leaf[2][:2] == "</":
            group = out[-1] if out and out[-1][0] == "+" else None
            if group and group[1][0] == leaf[0]:
                group[1][1] = _join(group[1][1], leaf[1])
            elif out[-3:] and len(out) >= 3 and out[-3] == leaf[0] and out[-2][0] == "#" and out[-1] == leaf[2]:
                out[-3:] = [["+", [leaf[0], _join(out[-2], leaf[1]), leaf[2]]]]
            else:
                out += leaf
            i += 3
        else:
            out.append(items[i])
            i += 1
    return out


def _key(item) -> object:
    """What must agree for two items to be aligned: tags by name, slots all alike, groups by their inside."""
    if isinstance(item, str):
        return item
    if item[0] == "#":
        return "#"
    return (item[0], tuple(_key(x) for x in item[1]))


def fold_repeats(items: list) -> list:
    """Tandem repeats of balanced groups become ["+", group]; shorter groups first."""
    changed = True
    for size in range(1, GROUP_TOKENS + 1):
        out, i = [], 0
        if size == 1 or changed:
            keys = [_key(x) for x in items]
        changed = any(x == y for x, y in zip(keys, keys[size:], strict=False))
        if not changed:
            continue
        while i < len(items):
            group = keys[i : i + size]
            j = i + size
            while len(group) == size and keys[j : j + size] == group:
                j += size
            head = keys[i]
            whole = isinstance(head, tuple) and size == 1 and head[0] in "+?" or isinstance(head, str) and head.startswith("<") and not head.startswith("</") and group[-1] == "</" + re.match(r"<([^.@>]+)", head)[1] + ">"
            if j > i + size and whole:
                parts = [items[k : k + size] for k in range(i, j, size)]
                merged = parts[0]
                for part in parts[1:]:
                    merged = [_join(x, y) for x, y in zip(merged, part, strict=True)]
                out.append(merged[0] if size == 1 and isinstance(merged[0], list) else ["+", merged])
                i = j
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def _join(x, y):
    """Two items that are aligned, as one."""
    if isinstance(x, str):
        return x
    if x[0] == "#":
        return ["#", x[1] if x[1] == y[1] else None, x[2] + y[2], x[3] + y[3]]
    return [x[0], [_join(a, b) for a, b in zip(x[1], y[1], strict=True)]]


def _inner(item):
    """What a repeated or optional form of one item stands for; other items stand for themselves."""
    return item[1][0] if isinstance(item, list) and item[0] in "+?" and len(item[1]) == 1 else item


def align(wrapper: list, page: list) -> list:
    """The least general wrapper found that covers both."""
    keys = [[_key(x) for x in side] for side in (wrapper, page)]
    if keys[0] == keys[1]:
        return [_join(x, y) for x, y in zip(wrapper, page, strict=True)]
    # Equal ends first, then the longest common subsequence of what is left.
    head = 0
    while head < min(len(wrapper), len(page)) and keys[0][head] == keys[1][head]:
        head += 1
    tail = 0
    while tail < min(len(wrapper), len(page)) - head and keys[0][-1 - tail] == keys[1][-1 - tail]:
        tail += 1
    a, b = wrapper[head : len(wrapper) - tail], page[head : len(page) - tail]
    ka, kb = [_key(_inner(x)) for x in a], [_key(_inner(x)) for x in b]
    out = [_join(x, y) for x, y in zip(wrapper[:head], page[:head], strict=True)]
    only: list = []

    def optional() -> None:
        run: list = []
        for item in [*only, None]:
            if item is None or (isinstance(item, list) and item[0] == "?"):  # optional already
                if run:
                    out.append(["?", run])
                    run = []
                if item is not None:
                    out.append(item)
            else:
                run.append(item)
        only.clear()

    i = j = 0
    for x, y in _steps(ka, kb):
        if x and y:
            optional()
            out.append(_merge(a[i], b[j]))
        else:
            only.append(a[i] if x else b[j])
        i, j = i + x, j + y
    optional()
    out += [_join(x, y) for x, y in zip(wrapper[len(wrapper) - tail :], page[len(page) - tail :], strict=True)]
    return fold_repeats(out)


def _steps(a: list, b: list) -> Iterator[tuple[int, int]]:
    """How to go through both by their longest common subsequence: (1, 1) where keys are aligned, (1, 0) and (0, 1) past one side's own.

    Bit-parallel: bit ``m - 1 - j`` of row ``i`` is 0 where the subsequence of ``a[i:]`` and ``b[j:]`` is longer than that of ``a[i:]``
    and ``b[j + 1:]``. Every so many rows are kept, the others made again where they are needed, so that long sides need neither
    time nor memory by the product of their lengths.
    """
    n, m = len(a), len(b)
    places: dict[object, list[int]] = {key: [] for key in a}
    for j, key in enumerate(b):
        if key in places:
            places[key].append(m - 1 - j)
    masks = {}
    for key, at in places.items():
        bits = bytearray(m // 8 + 1)
        for p in at:
            bits[p >> 3] |= 1 << (p & 7)
        masks[key] = int.from_bytes(bits, "little")
    full, every = (1 << m) - 1, isqrt(n) + 1

    def rows(last: int, low: int, row: int) -> Iterator[tuple[int, int]]:
        """Numbers and rows from ``last`` - 1 down to ``low``, given row ``last``."""
        for i in range(last - 1, low - 1, -1):
            met = row & masks[a[i]]
            row = ((row + met) | (row - met)) & full
            yield i, row

    kept = {n: full} | {i: row for i, row in rows(n, 0, full) if i % every == 0}
    block: dict[int, int] = {}

    def row(i: int) -> tuple[int, bytes]:
        if i not in kept and i not in block:
            low = i - i % every
            last = min(n, low + every)
            block.clear()
            block.update(rows(last, low, kept[last]))
        whole = kept[i] if i in kept else block[i]
        return whole, whole.to_bytes(m // 8 + 1, "little")

    i = j = 0
    here, below = row(0), row(min(1, n))
    best = m - here[0].bit_count()  # of a[i:] and b[j:]
    under = m - below[0].bit_count()  # of a[i + 1:] and b[j:]
    while i < n or j < m:
        if i == n or j == m:
            yield from [(1, 0)] * (n - i) + [(0, 1)] * (m - j)
            return
        p = m - 1 - j
        right = best - (~here[1][p >> 3] >> (p & 7) & 1)
        across = under - (~below[1][p >> 3] >> (p & 7) & 1)
        aligned = a[i] == b[j] and best == across + 1
        if aligned or under >= right:
            i, here = i + 1, below
            best, below = across if aligned else under, row(min(i + 1, n))
            j += aligned
            under = m - j - (below[0] & ((1 << (m - j)) - 1)).bit_count()
            yield 1, int(aligned)
        else:
            j, best, under = j + 1, right, across
            yield 0, 1


def _merge(x, y):
    if _key(x) == _key(y):
        return _join(x, y)
    kinds = {v[0] for v in (x, y) if v is not _inner(v)}
    return ["?" if "?" in kinds else "+", [_join(_inner(x), _inner(y))]]


def infer(wrapper: list | None, pages: int, page: list) -> tuple[list, int]:
    """Fold one folded page (or a wrapper) into a wrapper that ``pages`` pages have made."""
    if wrapper is None:
        return page, pages + 1
    return align(wrapper, page), pages + 1


def _walk(wrapper: list):
    """(path of elements, slot, whether it is in every page) of each slot of a wrapper."""
    path: list[str] = []

    def walk(items: list, fixed: bool):
        for item in items:
            if isinstance(item, list):
                if item[0] == "#":
                    yield tuple(path), item, fixed
                else:
                    yield from walk(item[1], False)
            elif item.startswith("</"):
                name = item[2:-1]
                at = next((k for k in range(len(path) - 1, -1, -1) if re.match(r"<([^.@>]+)", path[k])[1] == name), None)
                if at is not None:
                    del path[at:]
            elif re.match(r"<([^.@>]+)", item)[1] not in VOID:
                path.append(item)

    yield from walk(wrapper, True)


def constants(wrapper: list) -> set[tuple[tuple[str, ...], str]]:
    """(path, hash) of texts that are constant at their place in every page."""
    return {(path, slot[1]) for path, slot, fixed in _walk(wrapper) if fixed and slot[1] is not None}


def _element(mark: str) -> tuple[str, dict]:
    """Name and attributes of an element, as far as its mark tells."""
    name, words, role = re.fullmatch(r"<([^.@>]+)(?:\.([^@>]*))?(?:@([^>]*))?>", mark).groups()
    return name, {**({"class": " ".join(words.split("."))} if words else {}), **({"role": role} if role else {})}


def _no_text(mark: str, in_main: bool) -> bool:
    """Is an element of a wrapper no main text by itself. Marks hold single words, so only strong ones tell."""
    name, attrs = _element(mark)
    if name in INVISIBLE or name in BOILERPLATE or attrs.get("role", "") in BOILERPLATE_ROLES or (name == "header" and not in_main):
        return True
    words = attrs.get("class", "").split()
    return name not in HEADINGS and name not in ("html", "body", "main") and (not STRONG_WORDS.isdisjoint(words) or (len(words) == 1 and words[0] in WEAK_WORDS))


def region(wrapper: list, template: set) -> tuple[str, ...]:
    """Path of the element that holds the main text."""
    held: dict[tuple[str, ...], float] = {}
    headings: set[tuple[str, ...]] = set()  # paths with a heading right inside
    for path, slot, _ in _walk(wrapper):
        if (path, slot[1]) in template:
            continue
        marks = [is_main(*_element(m)) for m in path]
        if any(_no_text(m, any(marks[:k])) for k, m in enumerate(path)):
            continue
        for k in range(len(path) + 1):
            # Inside a marked element characters weigh more, for it and all that it stands in.
            held[path[:k]] = held.get(path[:k], 0) + (slot[2] - slot[3] + 0.1 * slot[3]) * (MARKED_WEIGHT if any(marks) else 1)
        if path and _element(path[-1])[0] in HEADINGS:
            headings.add(path[:-1])
    at: tuple[str, ...] = ()
    while True:
        below = [(n, p) for p, n in held.items() if len(p) == len(at) + 1 and p[: len(at)] == at and _element(p[-1])[0] in CONTAINERS]
        best = max(below, default=None)
        if best is None or best[0] < MOST * held[at]:
            return at
        if at in headings and not is_main(*_element(best[1][-1])):
            return at
        at = best[1]


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, region, template, seen): where a host's main text is, its constants as path and hash, and how many different pages it has (TEMPLATE_PAGES at most)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = last = state = None
        seen: list[int] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.string()), pa.array([json.dumps(state)]), pa.array([seen], pa.list_(pa.int64()))], ["host", "wrapper", "seen"])

        for batch in batches:
            for host, part, digest, html in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if (host, part) != at:
                    if at is not None:
                        yield out()
                    at, last, state, seen = (host, part), None, None, []
                if digest == last:
                    continue  # a copy
                last = digest
                state, _ = infer(state, 0, fold_repeats(stream(tokens(html or ""))))
                if len(seen) < TEMPLATE_PAGES:
                    seen.append(digest)
        if at is not None:
            yield out()

    def whole(group: pa.Table) -> pa.Table:
        state: list | None = None
        for text in sorted(group.column("wrapper").to_pylist()):
            state, _ = infer(state, 0, json.loads(text))
        seen = {h for hashes in group.column("seen").to_pylist() for h in hashes}
        fixed = constants(state) if len(seen) >= TEMPLATE_PAGES else set()
        columns = {"host": group.column("host").slice(0, 1), "region": pa.array([list(region(state, fixed))], pa.list_(pa.string()))}
        return pa.table({**columns, "template": pa.array([sorted(" ".join((*path, text)) for path, text in fixed)], pa.list_(pa.string())), "seen": pa.array([min(len(seen), TEMPLATE_PAGES)], pa.int64())})

    digest = F.xxhash64("html")
    dealt = pages.select("host", F.pmod(digest, F.lit(PARTS)).cast("int").alias("part"), digest.alias("digest"), "html")
    parts = dealt.repartition("host", "part").sortWithinPartitions("host", "part", "digest").mapInArrow(partial, "host string, wrapper string, seen array<long>")
    return parts.groupBy("host").applyInArrow(whole, "host string, region array<string>, template array<string>, seen long")


def _linked_shares(flow: list[Token]) -> dict[int, float]:
    """Place of each element's opening -> share of its characters in links."""
    out: dict[int, float] = {}
    open_: list[list] = []
    anchors = 0
    for at, token in enumerate(flow):
        if token.kind == "open":
            if token.name not in VOID:
                open_.append([at, 0, 0])
                anchors += token.name == "a"
        elif token.kind == "close":
            start, chars, linked = open_.pop()
            anchors -= token.name == "a"
            out[start] = linked / chars if chars else 0.0
            if open_:
                open_[-1][1] += chars
                open_[-1][2] += linked
        elif open_:
            n = len(token.value.strip())
            open_[-1][1] += n
            open_[-1][2] += n if anchors else 0
    return out


def _read(flow: list[Token], where: tuple[str, ...], template: set[tuple[tuple[str, ...], str]]) -> str | None:
    """Text of the elements at path ``where``; None if there is none."""
    shares = _linked_shares(flow)
    blocks, path, skip, inside, met = Blocks(), [], 0, int(not where), not where
    stack: list[tuple[str | None, bool, bool, bool]] = []
    marked = 0

    def end() -> None:
        before = len(blocks.done)
        blocks.cut()
        if template and len(blocks.done) > before and (tuple(path), xxhash.xxh3_64_hexdigest(blocks.done[-1])) in template:
            blocks.done.pop()

    for at, token in enumerate(flow):
        if token.kind == "text":
            if not skip and inside:
                blocks.add(token.value)
            continue
        block = token.name not in INLINE
        if block:
            end()
        elif token.name == "br":
            blocks.add(" ")
        if token.kind == "close":
            mark, drops, starts, mains = stack.pop()
            skip -= drops
            inside -= starts
            marked -= mains
            if mark is not None:
                path.pop()
        elif token.name not in VOID:
            mark = _mark(token) if block and token.name not in INVISIBLE else None
            if mark is not None:
                path.append(mark)
            starts = bool(where) and mark is not None and len(path) == len(where) and tuple(path) == where
            met |= starts
            starts = starts and shares.get(at, 0.0) <= 0.5  # one of several at this path may be a list of links
            mains = is_main(token.name, token.value)
            # The element that the wrapper names is main text whatever its class says.
            drops = not starts and is_boilerplate(token.name, token.value, bool(marked or inside and where), shares.get(at, 0.0))
            stack.append((mark, drops, starts, mains))
            skip += drops
            inside += starts
            marked += mains
    end()
    return blocks.text() if met else None


def main_text(page: str | None, where: tuple[str, ...] | None = None, template: set[tuple[tuple[str, ...], str]] = frozenset()) -> str:
    """Main text of a page, given its host's region and constants; without them, or if it lacks the region, by itself."""
    flow = tokens(page or "")
    found = _read(flow, where, template) if where is not None else None
    if found is None:
        found = _read(flow, region(fold_repeats(stream(flow)), template), template)
    return found or ""


def extract_main_text(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null and empty pages have the empty text. Pages of null urls share one host of their own; repeated rows are
    pages of their own, each with its text. Blocks are trimmed, stand in page order and are joined by one line feed. Texts are
    taken for a template's from TEMPLATE_PAGES different pages of a host on, as fewer are no evidence.
    """
    scratch = Scratch(spark, "wrappers")
    pages = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))
    pages = pages.withColumn("host", host)
    known = scratch.write(wrappers(pages.select("host", "html")), "wrappers")
    scratch.release()
    both = pages.join(known.select("host", "region", "template"), "host", "left").select("page_id", "url", "html", "region", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read: dict[tuple, set] = {}
            texts = []
            for page, where, fixed in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                key = tuple(fixed or ())
                if key not in read:
                    read[key] = {(tuple(t.split(" ")[:-1]), t.split(" ")[-1]) for t in key}
                texts.append(main_text(page, None if where is None else tuple(where), read[key]))
            arrays = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    id_type = pages.schema["page_id"].dataType.simpleString()
    return both.mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long")
