"""Segments from the text a model wrote: JSON, perhaps cut off, or bracket markers."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Spellings of a segment's keys, those that count first before others; the chat
# wrapper; the kinds of markers.
SPELLINGS = {
    "start": ("Start", "Start time", "start", "start_time"),
    "end": ("End", "End time", "end", "end_time"),
    "speaker": ("Speaker", "Speaker ID", "speaker", "speaker_id"),
    "text": ("Content", "content", "Text", "text"),
}
WRAPPER = r"<\|im_start\|>\s*assistant\s*|<\|im_end\|>|<\|endoftext\|>"
CLOSED = r"\[(\d{1,7}(?:\.\d{1,3})?)\](?:\[(S\d{1,3})\])?([^\[\]]+?)\[(\d{1,7}(?:\.\d{1,3})?)\]"
OPEN = r"\[(\d+(?:\.\d+)?)(?:-(\d+(?:\.\d+)?))?\]\s*(?:\[(S\d+)\])?\s*([^\[]*)"
TIMED = r"\[(\d+(?:\.\d+)?)\]\s*(\[S\d+\])?\s*([^\[]*)\[(\d+(?:\.\d+)?)\]"
FIRST_SPEAKER = "S01"

SEGMENTS = "array<struct<start:double,end:double,speaker:string,text:string>>"

#: What JSON is made of, by name; anything else is a break.
_PIECES = re.compile(
    r"""[ \t\n\r]*(?:(?P<mark>[\[\]{},:])
    |(?P<scalar>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|true|false|null|NaN|-?Infinity|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)
    |(?P<end>$)|(?P<other>.))""",
    re.VERBOSE | re.DOTALL,
)
_OPENS = re.compile(r"[\[{]")
_FIELD = {name: (field, rank) for field, names in SPELLINGS.items() for rank, name in enumerate(names)}


class _Open:
    """A list or object whose end is still to come, and the whole objects seen in it."""

    __slots__ = ("found", "key", "value", "wants")

    def __init__(self, mark: str):
        self.value, self.found, self.key = ({} if mark == "{" else []), [], None
        self.wants = "key or }" if mark == "{" else "value or ]"

    def put(self, value) -> None:
        if isinstance(self.value, dict):
            self.value[self.key] = value
            self.wants = ", or }"
        else:
            self.value.append(value)
            self.wants = ", or ]"


def whole_objects(text: str) -> list[dict]:
    """Objects of a text in order: those that stand alone or in a list, whatever is around them.

    One pass with a stack.  Where the text breaks off or goes wrong, what is open falls away
    and the whole objects inside of it count by themselves; the next bracket is a new start.
    Brackets inside of a string that was read are not looked for again.
    """
    out: list[dict] = []
    stack: list[_Open] = []

    def broken() -> None:
        for o in stack:
            out.extend(o.found)
        stack.clear()

    def close() -> None:
        done = stack.pop()
        if stack:
            own = [done.value] if isinstance(done.value, dict) else done.found
            stack[-1].put(done.value)
            stack[-1].found += own
        else:
            out.extend([done.value] if isinstance(done.value, dict) else [x for x in done.value if isinstance(x, dict)])

    def fits(mark: str | None, token: str) -> bool:
        """Take a piece if it may stand here."""
        top = stack[-1] if stack else None
        if mark in ("[", "{"):
            if top and not top.wants.startswith("value"):
                return False
            stack.append(_Open(mark))
        elif mark in ("]", "}"):
            if not top or not top.wants.endswith(mark):
                return False
            close()
        elif mark == ",":
            if not top or not top.wants.startswith(","):
                return False
            top.wants = "value" if isinstance(top.value, list) else "key"
        elif mark == ":":
            if not top or top.wants != ":":
                return False
            top.wants = "value"
        elif top.wants.startswith("value"):
            top.put(json.loads(token))
        elif top.wants.startswith("key") and token[0] == '"':
            top.key, top.wants = json.loads(token), ":"
        else:
            return False
        return True

    at = 0
    while True:
        if not stack:  # prose, up to where something opens
            start = _OPENS.search(text, at)
            if not start:
                return out
            at = start.start()
        m = _PIECES.match(text, at)
        if m["end"] is None and m["other"] is None and fits(m["mark"], m["mark"] or m["scalar"]):
            at = m.end()
            continue
        broken()
        if m["end"] is not None:
            return out
        at = m.end() if m["other"] else m.start(m.lastgroup) + (m["mark"] not in ("[", "{"))


def as_segment(item: dict) -> dict | None:
    """An object as a segment; a present key counts even if its value is null; only the speaker may be missing."""
    best: dict = {}
    for key, value in item.items():
        if known := _FIELD.get(key):
            field, rank = known
            if field not in best or rank < best[field][0]:
                best[field] = (rank, value)
    try:
        times = {k: float(best[k][1]) for k in ("start", "end")}
        return times | {"speaker": str(best["speaker"][1]) if "speaker" in best else "", "text": str(best["text"][1])}
    except (KeyError, TypeError, ValueError):
        return None


def generated_segments(text: Column) -> Column:
    """Segments of a generated JSON array, in order; null gives null, unreadable parts give nothing."""

    @F.pandas_udf(SEGMENTS)
    def read(texts):
        return texts.map(lambda t: None if t is None else [s for s in map(as_segment, whole_objects(t)) if s])

    return read(F.regexp_replace(text, WRAPPER, ""))


def marked_segments(text: Column) -> Column:
    """``array<struct<start, speaker, text, end>>`` of all markers as they stand: nothing is carried
    on and nothing left out, a label keeps its brackets and a missing one is empty."""
    at = lambda k: F.regexp_extract_all(text, F.lit(TIMED), F.lit(k))
    rows = F.arrays_zip(at(1).alias("a"), at(2).alias("s"), at(3).alias("t"), at(4).alias("b"))
    return F.transform(rows, lambda r: F.struct(r["a"].cast("double").alias("start"), r["s"].alias("speaker"), _stripped(r["t"]).alias("text"), r["b"].cast("double").alias("end")))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _marks(rows: DataFrame, keys: list[str], text: str, pattern: str, names: list[str]) -> DataFrame:
    parts = rows.select(*keys, *[F.regexp_extract_all(text, F.lit(pattern), F.lit(k)).alias(n) for k, n in enumerate(names, 1)])
    return parts.select(*keys, F.posexplode(F.arrays_zip(*names)).alias("pos", "m")).select(*keys, "pos", *[F.col(f"m.{n}").alias(n) for n in names])


def closed_markers(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``[start][Sxx]text[end]`` segments of each text: ``keys, pos, start, end, speaker, text``.

    ``keys`` must tell the texts apart.  A missing label is that of the last segment kept, S01
    at first; empty bodies and ends before the start are left out and pass no label on.
    """
    got = _marks(rows, keys, text, CLOSED, ["a", "who", "said", "b"])
    got = got.select(*keys, "pos", F.col("a").cast("double").alias("start"), F.col("b").cast("double").alias("end"), F.nullif("who", F.lit("")).alias("who"), _stripped(F.col("said")).alias("text"))
    kept = (F.col("text") != "") & (F.col("end") >= F.col("start"))
    before = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last(F.when(kept, F.col("who")), ignorenulls=True).over(before)
    got = got.withColumn("speaker", F.coalesce("who", carried, F.lit(FIRST_SPEAKER)))
    return got.where(kept).select(*keys, "pos", "start", "end", "speaker", "text")


def open_markers(rows: DataFrame, keys: list[str], text: str, offset: Column | float = 0.0) -> DataFrame:
    """``[start][Sxx]text`` or ``[start-end]...`` segments; ``offset`` is added to the times.

    Here a label is passed on even by a segment with an empty body; ``end`` may be null.
    ``offset`` may be a column only if it is one of ``keys``.
    """
    by = offset if isinstance(offset, Column) else F.lit(offset)
    got = _marks(rows, keys, text, OPEN, ["a", "b", "who", "said"])
    upto = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last(F.nullif("who", F.lit("")), ignorenulls=True).over(upto)
    got = got.withColumn("speaker", F.coalesce(carried, F.lit(FIRST_SPEAKER))).withColumn("text", _stripped(F.col("said")))
    end = F.nullif("b", F.lit("")).cast("double") + by
    return got.where("text != ''").select(*keys, "pos", (F.col("a").cast("double") + by).alias("start"), end.alias("end"), "speaker", "text")


def taken_apart(text: Column) -> Column:
    """A marked text as its bare text, its times and its labels in order."""
    bare = F.regexp_replace(text, r"\[\d+(?:\.\d+)?\]|\[S\d+\]", "")
    times = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+(?:\.\d+)?)\]"), F.lit(1)), lambda x: x.cast("double"))
    return F.struct(bare.alias("text"), times.alias("times"), F.regexp_extract_all(text, F.lit(r"\[(S\d+)\]"), F.lit(1)).alias("speakers"))


def dialogue(text: Column) -> Column:
    """``struct(speakers, turns)`` of a generated dialogue, or null where it is none.

    From the first bracket to the last it must be a JSON list of two turns or more, each with a
    speaker and a text that is not blank, of two to twelve speakers in all, who are listed as
    they first speak.
    """
    listed = F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit(""))
    items = F.try_variant_get(F.try_parse_json(listed), "$", "array<variant>")
    none = F.parse_json(F.lit("null"))
    is_text = lambda x, name: F.schema_of_variant(F.coalesce(F.try_variant_get(x, f"$.{name}", "variant"), none)) == "STRING"
    said = lambda x, name: _stripped(F.try_variant_get(x, f"$.{name}", "string"))
    turns = F.transform(items, lambda x: F.struct(said(x, "speaker").alias("speaker"), said(x, "text").alias("text")))
    whole = F.forall(items, lambda x: is_text(x, "speaker") & is_text(x, "text") & (F.coalesce(said(x, "text"), F.lit("")) != ""))
    speakers = F.array_distinct(F.transform(turns, lambda t: t["speaker"]))
    fine = whole & (F.size(items) >= 2) & F.size(speakers).between(2, 12)
    return F.when(F.coalesce(fine, F.lit(False)), F.struct(speakers.alias("speakers"), turns.alias("turns")))
