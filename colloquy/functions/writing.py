"""Written forms: spoken numbers as digits, titles, scorer tokens, likeness of texts."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.text import folded

# Numerals, their units, and sayings whose numerals stay as they are.
NUMERALS = "零一二三四五六七八九"
UNITS = (("億", 100_000_000), ("萬", 10_000), ("千", 1000), ("百", 100), ("十", 10))
SAYINGS = (
    "千萬 萬一 萬分 萬能 萬歲 萬全 萬事 萬象 一二 三三兩兩 五花八門 七上八下 九牛一毛 五湖四海 十全十美 亂七八糟 "
    "十之八九 一心一意 三心二意 四面八方 百分之百 一五一十 三言兩語 百年 千年 萬年 一一 十字 百般 千方百計 成千上萬 億萬"
).split()
RUN = "[零一二三四五六七八九十百千萬億兩]+"
SHARE = "百分之([零一二三四五六七八九十百千點兩0-9]+)"

# The kind of a meeting, words before it, topic cues in order, what ends a topic.
KIND = "([一-鿿]{2,5}?會議)"
BEFORE_KIND = "^(?:今天的|這次的?|本次的?|的)"
TOPICS = (
    r"agenda\s*是\s*([^，。？\n]+?)(?:。|，|$)",
    r"主要要\s*align\s*([^，。？\n]+?)(?:，|還|。)",
    r"主要是\s*review\s*([^，。？\n]+?)(?:，|。)",
    r"今天主要要\s*([^，。？\n]+?)(?:，|。)",
    r"議題是\s*([^，。？\n]+?)(?:。|，|$)",
)
AFTER_TOPIC = "時間控制|，還|還有確認|，先請"
PUNCTUATION = r"[，。、！？；：,.!?;:\s]"
QUOTES = r"[，。、！？；：,.!?;:\s《》「」（）()]"


def number_of(said: str) -> int | None:
    """The whole number a numeral says; None for one that is not written out in full.

    Digits alone are read one by one.  Else the largest unit splits the numeral in how many
    of it and the rest, which must be less; a rest that leaves out a unit needs the zero.
    """
    said = said.replace("兩", "二")
    if not said:
        return None
    if all(c in NUMERALS or c.isdigit() for c in said):
        return int("".join(str(NUMERALS.index(c)) if c in NUMERALS else c for c in said))
    name, unit = next((u for u in UNITS if u[0] in said), ("", 0))
    if not unit:
        return None
    head, _, rest = said.partition(name)
    many = 1 if not head and name == "十" else number_of(head.removeprefix("零"))
    if not many:
        return None
    if not rest:
        return many * unit
    more = number_of(rest.removeprefix("零"))
    if more is None or more >= unit or (not rest.startswith("零") and more * 10 < unit):
        return None
    return many * unit + more


def _decimal(said: str) -> str | None:
    whole, dot, part = said.partition("點")
    n = number_of(whole)
    if n is None or not dot:
        return None if n is None else str(n)
    digits = "".join(str(NUMERALS.index(c)) if c in NUMERALS else c for c in part.replace("兩", "二"))
    return f"{n}.{digits}" if digits.isdigit() else None


def in_digits(text: str) -> str:
    """Shares and numerals of two or more characters in digits, but for those inside sayings."""

    def run(m: re.Match) -> str:
        said, near = m[0], m.string[max(m.start() - 3, 0) : m.end() + 3]
        if len(said) == 1 or any(said in s and s in near for s in SAYINGS):
            return said
        n = number_of(said)
        return said if n is None else str(n)

    text = re.sub(SHARE, lambda m: m[0] if (d := _decimal(m[1])) is None else d + "%", text)
    return re.sub(RUN, run, text)


def numbers_written(text: Column) -> Column:
    """Spoken numbers as digits; only texts with a numeral cross to Python."""

    @F.pandas_udf("string")
    def batch(s):
        return s.map(lambda t: None if t is None else in_digits(t))

    return F.coalesce(batch(F.when(F.regexp_like(text, F.lit(RUN)), text)), text)


def spelled(n: Column) -> Column:
    """A number from 0 to 9999 in numerals."""
    digit = lambda k: F.substring(F.lit(NUMERALS), (F.floor(n / k) % 10 + 1).cast("int"), F.lit(1))
    at = lambda k: F.floor(n / k) % 10
    none = F.lit("")
    return F.when(n == 0, "零").otherwise(F.concat(
        F.when(at(1000) > 0, F.concat(digit(1000), F.lit("千"))).otherwise(none),
        F.when(at(100) > 0, F.concat(digit(100), F.lit("百"))).when((n > 1000) & (n % 100 > 0), "零").otherwise(none),
        F.when(at(10) > 0, F.concat(digit(10), F.lit("十"))).when((at(100) > 0) & (at(1) > 0), "零").otherwise(none),
        F.when(at(1) > 0, digit(1)).otherwise(none),
    ))


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, "(?iU)" + pattern, 1), F.lit(""))


def topic_of(said: Column) -> Column:
    """A topic up to what is known to follow it, 24 characters at most; null if nothing is left."""
    return F.nullif(F.substring(F.trim(F.get(F.split(F.trim(said), AFTER_TOPIC), F.lit(0))), 1, 24), F.lit(""))


def title(text: Column, opening: int = 120) -> Column:
    """``kind：topic`` of a meeting from its opening; the kind may be named later."""
    text = F.coalesce(text, F.lit(""))
    head = F.substring(text, 1, opening)
    kind = F.nullif(F.regexp_replace(F.coalesce(_found(head, KIND), _found(text, KIND), F.lit("")), BEFORE_KIND, ""), F.lit(""))
    topic = F.coalesce(*(topic_of(_found(head, cue)) for cue in TOPICS))
    named = F.concat_ws("：", F.coalesce(kind, F.when(topic.isNotNull(), "會議")), topic)
    return F.when(named == "", "會議").otherwise(named)


def scorer_tokens(text: Column) -> Column:
    """Lower-cased folded words without marks; a word with an ideograph goes character by character."""
    plain = F.trim(F.regexp_replace(F.lower(folded(F.coalesce(text, F.lit("")))), r"[^\p{L}\p{N}_]+", " "))
    parts = F.transform(F.split(plain, " "), lambda c: F.when(F.regexp_like(c, F.lit("[一-鿿]")), F.split(c, "")).otherwise(F.array(c)))
    return F.filter(F.flatten(parts), lambda c: c != "")


def without_marks(text: Column, punctuation: bool = True) -> Column:
    """A transcript without its time and speaker marks, and without punctuation and blanks."""
    plain = F.regexp_replace(text, r"\[\d+(?:\.\d+)?\]|\[S\d+\]", "")
    return F.regexp_replace(plain, "(?U)" + PUNCTUATION, "") if punctuation else plain


def marked_segments(text: Column) -> Column:
    """How many segments two time marks each make."""
    return F.floor(F.regexp_count(text, F.lit(r"\[\d+(?:\.\d+)?\]")) / 2).cast("long")


#: Pairs of characters whose runs are held at once; longer texts are compared without such a table.
MOST_CELLS = 1 << 24


def matched(x: str, y: str, common_out: bool = False) -> int:
    """Characters in the matching blocks of two texts, as ``difflib.SequenceMatcher`` finds them.

    The longest block (of equal ones the first in ``x``, then in ``y``), then those before and
    after it.  With ``common_out`` a character that makes up over a hundredth of a ``y`` of 200
    or more begins no block but may lengthen one.  The lengths of all equal runs are worked out
    once, and a part of the texts reads them up to its own edges.
    """
    a, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in (x, y))
    n, m = len(a), len(b)
    if not n or not m:
        return 0
    if n * m > MOST_CELLS or max(n, m) >= 1 << 15:
        return sum(k.size for k in SequenceMatcher(None, x, y, autojunk=common_out).get_matching_blocks())
    begins = np.ones(m, bool)
    if common_out and m >= 200:
        _, kind, counts = np.unique(b, return_inverse=True, return_counts=True)
        begins = (counts <= m // 100 + 1)[kind]
    runs = (a[:, None] == b[None, :]) & begins
    runs = runs.astype(np.int16)
    for k in range(1, n):
        np.multiply(runs[k, 1:], runs[k - 1, :-1] + 1, out=runs[k, 1:])
    edge = np.minimum(np.arange(1, n + 1, dtype=np.int16)[:, None], np.arange(1, m + 1, dtype=np.int16)[None, :])
    total, todo = 0, [(0, n, 0, m)]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        own = np.minimum(runs[i0:i1, j0:j1], edge[: i1 - i0, : j1 - j0])
        at = int(own.argmax())
        row, col = divmod(at, j1 - j0)
        size = int(own[row, col])
        i, j = (i0 + row - size + 1, j0 + col - size + 1) if size else (i0, j0)
        if common_out:
            while i > i0 and j > j0 and x[i - 1] == y[j - 1]:
                i, j, size = i - 1, j - 1, size + 1
            while i + size < i1 and j + size < j1 and x[i + size] == y[j + size]:
                size += 1
        if size:
            total += size
            if i0 < i and j0 < j:
                todo.append((i0, i, j0, j))
            if i + size < i1 and j + size < j1:
                todo.append((i + size, i1, j + size, j1))
    return total


def agreement(a: Column, b: Column, of_longer: bool = True) -> Column:
    """Characters in matching blocks of two texts: per cent of the longer one, or, with
    ``of_longer`` off, twice over both lengths.  Null counts as empty."""

    @F.arrow_udf("double")
    def batch(a: pa.Array, b: pa.Array) -> pa.Array:
        def one(x: str, y: str) -> float:
            if not of_longer:
                return 2.0 * matched(x, y, True) / (len(x) + len(y)) if x or y else 1.0
            return 100.0 * matched(x, y) / max(len(x), len(y), 1)

        return pa.array([one(x.as_py() or "", y.as_py() or "") for x, y in zip(a, b, strict=True)], pa.float64())

    return batch(a, b)


def likeness(a: Column, b: Column) -> Column:
    """Ratio of matching blocks of two texts without punctuation, quotes and blanks."""
    plain = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), "(?U)" + QUOTES, "")
    return agreement(plain(a), plain(b), of_longer=False)


def shard_of(name: Column, shards: int) -> Column:
    """The shard a name falls in by its CRC, whatever other names there are."""
    return F.pmod(F.crc32(name.cast("binary")), F.lit(shards))
