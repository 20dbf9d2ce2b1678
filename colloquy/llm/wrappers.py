"""Main-text extraction by wrappers: union-free regular expressions inferred for each host.

A page is a stream of tags and texts.  Neighbouring equal runs fold into repeated groups.
Streams of one host are aligned with the wrapper so far; what only one side has becomes
optional, what one side repeats becomes repeated, and a text that is the same on every page
stays template text while one that differs becomes a slot.  The host's pages are read by
their place in the wrapper: in a marked main box where the wrapper has one, else in the box
that holds most of the text that varies from page to page, without its template texts.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import stage, table

#: Longest run of items that is looked for as a repeated group.
LONGEST_GROUP = 16
_TWICE = [re.compile(rf"(.{{{n}}})\1", re.S) for n in range(LONGEST_GROUP + 1)]
#: Atoms of a page up to which its items have a character each.
MOST_LETTERS = 500_000
#: Groups of a page up to which each is looked for, before a pass over all items is cheaper.
MOST_RUNS = 64
#: Parts a host's streams are dealt to, level by level, before they are merged.
SALTS = (4096, 64, 1)
#: Cells of an alignment table beyond which it is filled a row at once, and of how many cells of
#: those rows the steps are held at a time.
MOST_CELLS, HELD_CELLS = 250_000, 32 << 20
#: Items of a wrapper from which on streams that have little in common with it get a further
#: wrapper of their host; no stream stays out.
MOST_ITEMS = 2000
#: Pages that must agree on a text before it counts as the template's.
LEAST_PAGES = 3
#: Share of a box's varying text that an inner box must hold to be the main one.
DOMINANT = 0.6

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z|(?=<))|<[a-zA-Z/][^>]*\Z", re.S)
_CLASS = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_RAW = {"script", "style", "noscript", "template", "textarea", "svg", "iframe"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "track"}
#: Tags that do not break a line of text.
_INLINE = set("a abbr b bdi bdo cite code data dfn em font i kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that a slot's path always names; others only where they have marks.
_BOX = set("html head body title nav header footer aside article main section div form fieldset ul ol dl table figure blockquote button select".split())
#: Boxes that may hold a whole article.
_HOLDERS = {"html", "body", "article", "main", "section", "div", "table"}
_SIDE_TAGS = {"head", "title", "nav", "header", "footer", "aside", "form", "button", "select", "fieldset"}
_SIDE_WORDS = re.compile(
    r"(?:^|[-_ ])(ads?|advert\w*|sponsor\w*|promo\w*|banner|menu|nav\w*|side\w*|footer|header|masthead|breadcrumbs?|cookies?|consent|notices?|popup|modal|"
    r"comments?|disqus|respon[ds]\w*|related|recommend\w*|share|sharing|social|subscribe|newsletter|login|search|widget|pagination|pager|tags?)(?:$|[-_ ])",
    re.I,
)
_MAIN_WORDS = re.compile(r"(?:^|[-_ ])(article|main|content|post|entry|story)(?:$|[-_ ]|body|text)", re.I)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, value): ``open``/``close`` tags with their marks, and ``text`` decoded."""
    at, until = 0, None
    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if until:
            if not (m[2] and m[1] and m[2].lower() == until):
                continue
            until = None
        elif m.start() > at:
            yield "text", "", html.unescape(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            yield "close", name, ""
        else:
            marks = " ".join(v.strip("\"'") for _, v in _CLASS.findall(m[3]))
            yield "open", name, marks
            if name in _RAW and not m[3].endswith("/"):
                until = name
                close = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.start() if close else len(page)
    if at < len(page) and not until:
        yield "text", "", html.unescape(page[at:])


def stream(page: str) -> tuple[list[str], list[str]]:
    """Atoms of a page and its texts by atom: boxes as ``<path>``, other tags as ``<name>``,
    texts as ``#path``.

    A text is a line with the white space inside made single blanks; inline tags are part of
    their line.
    """
    atoms: list[str] = []
    texts: list[str] = []
    line: list[str] = []
    boxes: list[tuple[str, str]] = []  # names and paths

    def end_line():
        said = " ".join("".join(line).split())
        line.clear()
        if said:
            atoms.append("#" + (boxes[-1][1] if boxes else ""))
            texts.append(said)

    for kind, name, value in tokens(page):
        if kind == "text":
            line.append(value)
            continue
        if name in _INLINE:
            continue
        end_line()
        if name in _VOID or name in _RAW:
            continue
        label = name + ("." + ".".join(value.split()).lower().replace("/", "") if value else "")
        if kind == "open":
            # a block ends an open paragraph, an item or cell the one before it
            if boxes and (boxes[-1][0] == "p" or (boxes[-1][0] == name and name not in _BOX)):
                boxes.pop()
            if name in _BOX or value:
                label = f"{boxes[-1][1]}/{label}" if boxes else label
                boxes.append((name, label))
            atoms.append(f"<{label}>")
        else:
            atoms.append(f"</{name}>")
            for k in range(len(boxes) - 1, -1, -1):
                if boxes[k][0] == name:
                    del boxes[k:]
                    break
        texts.append("")
    end_line()
    return atoms, texts


def fold(atoms: list[str]) -> tuple[list, list[list[int]]]:
    """Fold neighbouring equal runs into ``("+", run)`` items until none is left.

    Gives the items and, for each text slot in them, the places of its texts among the atoms.
    """
    items: list = list(atoms)
    ids: dict = {}
    number = lambda x: ids.setdefault(x, len(ids))
    # a character for each item, so that runs are compared and looked for as strings
    as_text = len(atoms) <= MOST_LETTERS
    said = "".join(chr(number(x)) for x in items) if as_text else [number(x) for x in items]
    runs: dict = {}  # of groups, by their own character
    slots: list[tuple] = [([k],) if a[0] == "#" else () for k, a in enumerate(atoms)]

    def joined(parts: list[tuple]) -> tuple:
        return tuple(x for p in parts for x in p)

    def both(one: tuple, two: tuple) -> tuple:
        return tuple(x + y for x, y in zip(one, two, strict=True))

    def folds(size: int) -> bool:
        """Whether a run of this size is repeated, or follows its own group."""
        if not as_text or len(runs) > MOST_RUNS or _TWICE[size].search(said):
            return True
        return any(len(run) == size and c + run in said for c, run in runs.items())

    changed = True
    while changed:
        changed = False
        for size in range(1, LONGEST_GROUP + 1):
            if not folds(size):
                continue
            out, where, k = [], [], 0
            while k < len(items):
                run = said[k : k + size]
                plain = not (size == 1 and isinstance(items[k], tuple)) and len(run) == size
                reps = 1
                while plain and said[k + reps * size : k + (reps + 1) * size] == run:
                    reps += 1
                if reps > 1:
                    held = joined(slots[k : k + size])
                    for r in range(1, reps):
                        held = both(held, joined(slots[k + r * size : k + (r + 1) * size]))
                    out.append(("+", tuple(items[k : k + size])))
                    if as_text:
                        runs[chr(number(out[-1]))] = run
                    where.append(held)
                    k += reps * size
                    changed = True
                elif plain and out and isinstance(out[-1], tuple) and len(out[-1][1]) == size and out[-1][1] == tuple(items[k : k + size]):
                    where[-1] = both(where[-1], joined(slots[k : k + size]))
                    k += size
                    changed = True
                else:
                    out.append(items[k])
                    where.append(slots[k])
                    k += 1
            items, slots = out, where
            said = "".join(chr(number(x)) for x in items) if as_text else [number(x) for x in items]
    return items, [list(x) for s in slots for x in s]


def _table(left: list, right: list) -> list[tuple[int, int]]:
    """Best alignment of two short lists as steps (items of the left, items of the right)."""
    n, m = len(left), len(right)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    move = [[(0, 1)] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        w = left[i]
        below, row, how = best[i + 1], best[i], move[i]
        how[m] = (1, 0)
        for j in range(m - 1, -1, -1):
            p = right[j]
            top, step = below[j], (1, 0)
            if row[j + 1] > top:
                top, step = row[j + 1], (0, 1)
            if w == p:
                if below[j + 1] + 2 >= top:
                    top, step = below[j + 1] + 2, (1, 1)
            else:
                # a repeated group matches one run of it, on either side
                if isinstance(w, tuple) and right[j : j + len(w[1])] == list(w[1]):
                    if (s := best[i + 1][j + len(w[1])] + 2 * len(w[1])) >= top:
                        top, step = s, (1, len(w[1]))
                if isinstance(p, tuple) and left[i : i + len(p[1])] == list(p[1]):
                    if (s := best[i + len(p[1])][j + 1] + 2 * len(p[1])) >= top:
                        top, step = s, (len(p[1]), 1)
            row[j], how[j] = top, step
    out, i, j = [], 0, 0
    while i < n or j < m:
        a, b = move[i][j]
        out.append((a, b))
        i, j = i + a, j + b
    return out


def _row_table(left: list, right: list, held: int) -> list[tuple[int, int]]:
    """The same alignment as ``_table``, a row of the table at once.

    Steps of ``held`` cells at most are kept; the other rows are filled again from scores kept
    between such blocks of rows, when the way through them is read.
    """
    n, m = len(left), len(right)
    ids: dict = {}
    number = lambda x: ids.setdefault(x, len(ids))
    own, other = [number(x) for x in left], np.array([number(x) for x in right])
    runs = {k: [number(x) for x in w[1]] for k, w in enumerate(left) if isinstance(w, tuple)}
    places: dict = {}
    for j, p in enumerate(right):
        if isinstance(p, tuple):
            places.setdefault(p, []).append(j)
    places = {p: np.array(js) for p, js in places.items()}
    far = max([1, *map(len, runs.values()), *(len(p[1]) for p in places)])

    def row(i: int, rows: dict) -> tuple[np.ndarray, np.ndarray]:
        below = rows[i + 1]
        equal = other == own[i]
        best, how = np.full(m, -1), np.zeros(m, np.int8)
        best[equal], how[equal] = below[1:][equal] + 2, 2
        # a repeated group matches one run of it, on either side
        if (run := runs.get(i)) and len(run) <= m:
            k, hit = len(run), ~equal[: m - len(run) + 1]
            for x, g in enumerate(run):
                hit &= other[x : m - k + 1 + x] == g
            at = np.flatnonzero(hit)
            best[at], how[at] = below[at + k] + 2 * k, 2 + k
        for p, js in places.items():
            k = len(p[1])
            if left[i] != p and left[i : i + k] == list(p[1]):
                s = rows[i + k][js + 1] + 2 * k
                js = js[s >= best[js]]
                best[js], how[js] = rows[i + k][js + 1] + 2 * k, -k
        score = np.zeros(m + 1, np.int64)
        score[:m] = np.maximum.accumulate(np.maximum(below[:m], best)[::-1])[::-1]
        return score, np.where(best == score[:m], how, np.where(score[1:] > below[:m], 1, 0)).astype(np.int8)

    block = max(1, held // max(m, 1))
    rows, kept = {n + k: np.zeros(m + 1, np.int64) for k in range(far)}, {}
    for i in range(n - 1, -1, -1):
        if (i + 1) % block == 0 or i == n - 1:
            kept[i // block] = dict(rows)
        rows[i], _ = row(i, rows)
        rows.pop(i + far, None)
    out, i, j, at, steps = [], 0, 0, -1, []
    while i < n and j < m:
        if i // block != at:
            at = i // block
            rows, steps = kept.pop(at), {}
            for k in range(min(n, (at + 1) * block) - 1, i - 1, -1):
                rows[k], steps[k] = row(k, rows)
                rows.pop(k + far, None)
        way = int(steps[i][j])
        a, b = {0: (1, 0), 1: (0, 1), 2: (1, 1)}.get(way) or ((1, way - 2) if way > 0 else (-way, 1))
        out.append((a, b))
        i, j = i + a, j + b
    return out + [(1, 0)] * (n - i) + [(0, 1)] * (m - j)


def align(left: list, right: list) -> list[tuple[int, int, int, int]]:
    """Alignment as pieces (left from, to, right from, to), either side possibly empty.

    Equal ends are taken off first.
    """
    n, m, head = len(left), len(right), 0
    while head < min(n, m) and left[head] == right[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and left[n - 1 - tail] == right[m - 1 - tail]:
        tail += 1
    steps = [(1, 1)] * head
    a, b = left[head : n - tail], right[head : m - tail]
    steps += _table(a, b) if len(a) * len(b) <= MOST_CELLS else _row_table(a, b, HELD_CELLS)
    steps += [(1, 1)] * tail
    out, i, j = [], 0, 0
    for p, q in steps:
        out.append((i, i + p, j, j + q))
        i, j = i + p, j + q
    return out


def slot_paths(items) -> Iterator[str]:
    for x in items:
        if isinstance(x, tuple):
            yield from slot_paths(x[1])
        elif x[0] == "#":
            yield x[1:]


def _counts(items: list) -> list[int]:
    """Text slots in each item."""
    return [sum(1 for _ in slot_paths([x])) for x in items]


class Wrapper:
    """Items (atoms and repeated groups) with a flag each, and what its text slots held.

    A flag of 0 is required, else an optional part.  A slot has the text that all pages agree
    on (a hash; None where they differ), the pages that have it and its characters in all.
    """

    def __init__(self, items: list, optional: list[int], held: list[list]):
        self.items, self.optional, self.held = items, optional, held

    @staticmethod
    def of_page(items: list, slots: list[list[int]], texts: list[str]) -> Wrapper:
        held = []
        for places in slots:
            said = {texts[k] for k in places}
            literal = xxhash.xxh64_intdigest(next(iter(said)).encode("utf-8", "replace")) >> 1 if len(said) == 1 else None
            held.append([literal, 1, sum(len(texts[k]) for k in places)])
        return Wrapper(items, [0] * len(items), held)

    def merged(self, other: Wrapper) -> Wrapper:
        """Resolve mismatches: repeats win over single runs, one-sided parts become optional,
        and texts that differ become slots."""
        both = lambda x, y: [x[0] if x[0] == y[0] else None, x[1] + y[1], x[2] + y[2]]
        if self.items == other.items:
            flags = [x or y for x, y in zip(self.optional, other.optional, strict=True)]
            return Wrapper(self.items, flags, [both(x, y) for x, y in zip(self.held, other.held, strict=True)])
        items, optional, held, part = [], [], [], 0
        last = (0, 0)
        ends = [list(accumulate(_counts(w.items), initial=0)) for w in (self, other)]
        for a, b, c, d in align(self.items, other.items):
            one, two = self.held[ends[0][a] : ends[0][b]], other.held[ends[1][c] : ends[1][d]]
            if b > a and d > c:
                pick = self.items[a:b] if b - a == 1 and isinstance(self.items[a], tuple) else other.items[c:d]
                flag = 0 if not any(self.optional[a:b]) and not any(other.optional[c:d]) else 1
                held += [both(x, y) for x, y in zip(one, two, strict=True)]
            else:
                pick, flag = (self.items[a:b], 1) if b > a else (other.items[c:d], 1)
                held += one or two
            if flag:
                side = (1, b > a)
                if last != side or not optional or not optional[-1]:
                    part += 1
                last = side
            else:
                last = (0, 0)
            items += pick
            optional += [part if flag else 0] * len(pick)
        return Wrapper(items, optional, held)

    def places(self, items: list) -> list[int]:
        """For each text slot of a page's items, its slot in this wrapper; -1 without one."""
        ends = [list(accumulate(_counts(x), initial=0)) for x in (self.items, items)]
        out = [-1] * ends[1][-1]
        for a, b, c, d in align(self.items, items):
            if b > a and d > c:
                for k in range(ends[1][d] - ends[1][c]):
                    out[ends[1][c] + k] = ends[0][a] + k
        return out

    def regex(self) -> str:
        """The expression as text: ``( )?`` optional, ``( )+`` repeated, template texts in quotes."""
        slot = iter(self.held)

        def say(x) -> str:
            if isinstance(x, tuple):
                return "( " + " ".join(map(say, x[1])) + " )+"
            if x[0] != "#":
                return x
            literal, pages, _ = next(slot)
            return f'"{x[1:]}"' if literal is not None and pages > 1 else x

        out, k = [], 0
        while k < len(self.items):
            e = k + 1
            while e < len(self.items) and self.optional[e] == self.optional[k] != 0:
                e += 1
            body = " ".join(map(say, self.items[k:e]))
            out.append(f"( {body} )?" if self.optional[k] else body)
            k = e
        return " ".join(out)

    def to_json(self) -> str:
        return json.dumps([self.items, self.optional, self.held])

    @staticmethod
    def from_json(text: str) -> Wrapper:
        items, optional, held = json.loads(text)
        return Wrapper([_tuples(x) for x in items], optional, held)


def _tuples(x):
    return x if isinstance(x, str) else (x[0], tuple(_tuples(y) for y in x[1]))


def is_side(path: str) -> bool:
    """Whether a slot's path goes through a menu, header, advert, form, comment or the like."""
    for box in path.split("/"):
        name, _, marks = box.partition(".")
        if name in _SIDE_TAGS or (marks and name not in ("html", "body") and _SIDE_WORDS.search(marks.replace(".", " "))):
            return True
    return False


def _marked(paths: set[str]) -> set[str]:
    """Paths through an article or main element, else through a box of such a class."""
    inside = {p for p in paths if any(b.split(".")[0] in ("article", "main") for b in p.split("/"))}
    return inside or {p for p in paths if any("." in b and b.split(".")[0] not in ("html", "body") and _MAIN_WORDS.search(b.partition(".")[2].replace(".", " ")) for b in p.split("/"))}


def _boxes(items: list) -> list[list[tuple[str, int]]]:
    """For each text slot the boxes around it, each as its path and which opening of it this is."""
    opened: Counter = Counter()
    out = []

    def walk(items):
        for x in items:
            if isinstance(x, tuple):
                walk(x[1])
            elif x[0] == "<" and x[1] != "/":
                opened[x[1:-1]] += 1
            elif x[0] == "#":
                parts = x[1:].split("/") if len(x) > 1 else []
                out.append([(p := "/".join(parts[: k + 1]), opened[p]) for k in range(len(parts))])

    walk(items)
    return out


def main_slots(wrapper: Wrapper) -> set[int]:
    """Slots of the host's main text; none where the wrapper can't tell.

    In a marked main box where there is one.  Else, from the page down, into the box that
    holds ``DOMINANT`` of the varying text; of what is in it, texts that ``LEAST_PAGES`` pages
    or more and all that have them agree on are the template's.
    """
    paths = list(slot_paths(wrapper.items))
    open_to = [k for k, p in enumerate(paths) if not is_side(p)]
    if marked := _marked({paths[k] for k in open_to}):
        return {k for k in open_to if paths[k] in marked}
    around = _boxes(wrapper.items)
    varying = {k: wrapper.held[k][2] / wrapper.held[k][1] for k in open_to if wrapper.held[k][0] is None and wrapper.held[k][1] > 1}
    if not varying:
        return set()
    inside, depth = open_to, 0
    while True:
        total, by_box = sum(varying.get(k, 0) for k in inside), Counter()
        for k in inside:
            if len(around[k]) > depth:
                by_box[around[k][depth]] += varying.get(k, 0)
        top = max(sorted(by_box), key=by_box.get, default=None)
        if top is None or by_box[top] < DOMINANT * total or top[0].rpartition("/")[2].partition(".")[0] not in _HOLDERS:
            break
        inside = [k for k in inside if len(around[k]) > depth and around[k][depth] == top]
        depth += 1
    return {k for k in inside if wrapper.held[k][0] is None or wrapper.held[k][1] < LEAST_PAGES}


def own_paths(chars: dict[str, int]) -> set[str]:
    """Main slots of one page that has none of its host's: in a main box of its own, else
    beside or below the slot with most text."""
    open_to = {p for p in chars if not is_side(p)}
    if inside := _marked(open_to):
        return inside
    if not open_to:
        return set()
    top = max(sorted(open_to), key=chars.get)
    around = top.rpartition("/")[0]
    return {p for p in open_to if p == top or p == around or not around or p.startswith(around + "/")}


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def _name(items: list) -> int:
    """A stream's name: a hash of its items."""
    return xxhash.xxh64_intdigest(json.dumps(items)) >> 1


_WRAPPER = "host string, salt long, wrapper string"


def streams(pages: DataFrame) -> DataFrame:
    """``(host, salt, wrapper)``: the folded streams of pages, equal ones of a task merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, Wrapper] = {}

        def flush():
            rows = [(h, n, w.to_json()) for (h, n), w in seen.items()]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["host", "salt", "wrapper"])

        for b in batches:
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                atoms, texts = stream(page or "")
                items, slots = fold(atoms)
                if not slots:
                    continue
                new, key = Wrapper.of_page(items, slots, texts), (host, _name(items))
                seen[key] = seen[key].merged(new) if key in seen else new
                if len(seen) >= 4096:
                    yield flush()
        if seen:
            yield flush()

    return pages.where("host <> ''").select("host", "html").mapInArrow(run, _WRAPPER)


def _merged(rows: DataFrame, tasks: int) -> DataFrame:
    """Wrappers of all rows with the same host and salt: one, or as many as it takes for each to
    stay short or be of streams that have much in common.  Every stream is part of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for (host, salt), own in groupby(every, key=lambda r: r[:2]):
            same: dict[tuple, Wrapper] = {}
            for _, _, text in own:
                w = Wrapper.from_json(text)
                key = (tuple(w.items), tuple(w.optional))
                same[key] = same[key].merged(w) if key in same else w
            # the commonest first, so that the rest is aligned with what most pages have
            rest = sorted(same.values(), key=lambda w: (-max((h[1] for h in w.held), default=0), w.to_json()))
            found: list[Wrapper] = []
            for w in rest:
                for k, whole in enumerate(found):
                    more = whole.merged(w)
                    if len(more.items) <= max(MOST_ITEMS, 2 * min(len(whole.items), len(w.items))):
                        found[k] = more
                        break
                else:
                    found.append(w)
            n = len(found)
            yield pa.RecordBatch.from_arrays([pa.array([host] * n), pa.array([salt] * n, pa.int64()), pa.array([w.to_json() for w in found])], ["host", "salt", "wrapper"])

    return rows.repartition(tasks, "host", "salt").sortWithinPartitions("host", "salt", "wrapper").mapInArrow(run, _WRAPPER)


def infer(seen: DataFrame) -> DataFrame:
    """``(host, wrapper)`` from all streams: level by level, in parts that get fewer.  A host whose
    streams have little in common and are long has several."""
    tasks = int(seen.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for n in SALTS:
        seen = _merged(seen.withColumn("salt", F.pmod("salt", F.lit(n))), tasks)
    return seen.select("host", "wrapper")


def labels(seen: DataFrame, wrappers: DataFrame) -> DataFrame:
    """``(host, stream, main)``: by stream of a host, which of its text slots are main text.

    Of several wrappers the one decides that has places for most of the stream's slots.  A slot without a place in the wrapper is main where all the wrapper's slots of its path are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Wrapper, set[int], set[str]]] = {}
        for b in batches:
            out, placed = [], []
            for own, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if text not in held:
                    held.clear()
                    main = main_slots(w := Wrapper.from_json(text))
                    paths = list(slot_paths(w.items))
                    held[text] = w, main, {paths[k] for k in main} - {p for k, p in enumerate(paths) if k not in main}
                w, main, all_main = held[text]
                items = Wrapper.from_json(own).items
                places = w.places(items)
                placed.append(sum(k >= 0 for k in places))
                out.append([k in main if k >= 0 else p in all_main for k, p in zip(places, slot_paths(items), strict=True)])
            yield pa.RecordBatch.from_arrays([*b.columns[:2], b.column(4), pa.array(placed, pa.int64()), pa.array(out, pa.list_(pa.bool_()))], ["host", "stream", "name", "placed", "main"])

    one = seen.groupBy("host", "salt").agg(F.min("wrapper").alias("own"))
    both = one.join(wrappers, "host").select("host", "salt", "own", "wrapper", F.xxhash64("wrapper").alias("name"))
    said = both.mapInArrow(run, "host string, stream long, name long, placed long, main array<boolean>")
    return said.groupBy("host", "stream").agg(F.max_by("main", F.struct("placed", "name")).alias("main"))


_READ = "page_id {}, url {}, host string, stream long, texts array<string>, slots array<int>, own array<boolean>"


def read(pages: DataFrame) -> DataFrame:
    """Pages as streams: name, texts, the slot of each text, and whether it is main text by
    the page alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, said, place, alone = [], [], [], []
            for page in b.column(3).to_pylist():
                atoms, texts = stream(page or "")
                items, slots = fold(atoms)
                slot = {k: n for n, places in enumerate(slots) for k in places}
                at = sorted(slot)
                chars: dict[str, int] = {}
                for k in at:
                    chars[atoms[k][1:]] = chars.get(atoms[k][1:], 0) + len(texts[k])
                own = own_paths(chars)
                names.append(_name(items))
                said.append([texts[k] for k in at])
                place.append([slot[k] for k in at])
                alone.append([atoms[k][1:] in own for k in at])
            lists = [pa.array(x, pa.list_(t)) for x, t in ((said, pa.string()), (place, pa.int32()), (alone, pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(names, pa.int64()), *lists], ["page_id", "url", "host", "stream", "texts", "slots", "own"])

    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return pages.select("page_id", "url", "host", "html").mapInArrow(run, _READ.format(*kinds))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row.

    Null html: empty text.  Pages with a null or odd url have no host and are read each by
    itself, as are those without text in any main slot of their host's wrapper: the texts of
    their own marked box, else those beside or below the one with most text.  Repeated rows
    stay repeated; of texts of equal length the first path in order decides.  A page cut off
    in the middle is read as far as it goes, and long pages whole; other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    seen = stage(streams(rows), "page-streams")
    known = stage(labels(seen, stage(infer(seen), "wrappers")), "page-labels")
    both = read(rows).join(known, ["host", "stream"], "left")
    wrapped = F.filter("texts", lambda t, k: F.get("main", F.get("slots", k)))
    alone = F.filter("texts", lambda t, k: F.get("own", k))
    text = F.array_join(F.when(F.size(wrapped) > 0, wrapped).otherwise(alone), " ")
    return both.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op5_wrappers(spark, sf_dir: str) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page; see ``main_text`` for odd rows."""
    return main_text(table(spark, sf_dir, "pages"))
