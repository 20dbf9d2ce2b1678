"""Script conversion: the longest phrase of a dictionary at each place of a text, left to right."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs that are never converted, so that Latin words inside a text stay as they are.
PROTECTED = r"[A-Za-z0-9 .,'-]+"
#: What is put right after the conversion: fixed values.
OVERRIDES = [("質量", "品質")]
#: Phrases of a dictionary; it travels to every task whole, so it is counted first.
MOST_PHRASES = 500_000


class Phrases:
    """A trie of phrases: each node holds its children by letter, and under "" what it turns into."""

    def __init__(self, pairs: Iterable[tuple[str, str]]):
        self.root: dict = {}
        for phrase, to in sorted(pairs, reverse=True):  # of one phrase's outcomes the least is put in last
            node = self.root
            for letter in phrase:
                node = node.setdefault(letter, {})
            node[""] = to

    def convert(self, text: str) -> str:
        out, at = [], 0
        while at < len(text):
            node, k, found, end = self.root, at, text[at], at + 1
            while k < len(text) and (node := node.get(text[k])) is not None:
                k += 1
                if "" in node:
                    found, end = node[""], k
            out.append(found)
            at = end
        return "".join(out)


def _collected(dictionary: DataFrame, most: int) -> list[tuple[str, str]]:
    rows = dictionary.select("phrase", "to").where("phrase <> '' and to is not null").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a dictionary of more than {most} phrases does not fit beside every task")
    return [(r.phrase, r.to) for r in rows]


def converter(dictionaries: list[DataFrame], overrides: list[tuple[str, str]] = OVERRIDES, protected: str = PROTECTED, most: int = MOST_PHRASES) -> Callable[[Column], Column]:
    """A function from a text column to its conversion.

    Each of the dictionaries ``(phrase, to)`` is applied to what the one before gave, at every
    place the longest phrase that begins there; a longer phrase beats its parts, and of several
    outcomes of one phrase the least in code-point order counts.  Null and empty phrases and
    null outcomes are ignored.  Runs of ``protected`` are passed through, and phrases do not
    reach over them.  ``overrides`` are replaced in the outcome, one after the other.  Null stays
    null.
    """
    tries = [Phrases(_collected(d, most)) for d in dictionaries]
    kept = re.compile(protected)

    def whole(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for m in (*kept.finditer(text), None):
            part = text[at : m.start() if m else len(text)]
            for t in tries:
                part = t.convert(part) if part else part
            out += [part, m[0] if m else ""]
            at = m.end() if m else len(text)
        done = "".join(out)
        for a, b in overrides:
            done = done.replace(a, b)
        return done

    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        return texts.map(whole, na_action="ignore").astype(object)

    return convert


def normalized_records(records: DataFrame, key: str, convert: Callable[[Column], Column], segments: str = "segments") -> DataFrame:
    """Records whose segments' texts are converted; all else stays.

    Segments are converted one by one and meet again under the record's key, which must be its
    own; a record without segments stays as it is.
    """
    fields = records.schema[segments].dataType.elementType.fieldNames()
    long = records.select(key, F.posexplode(segments).alias("_p", "_s")).withColumn("_t", convert(F.col("_s.text")))
    item = F.struct(*(F.col("_t").alias("text") if f == "text" else F.col(f"_s.{f}").alias(f) for f in fields))
    done = long.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", item.alias("s")))), lambda x: x["s"]).alias("_done"))
    out = records.join(done, key, "left").withColumn(segments, F.coalesce(F.col("_done").cast(records.schema[segments].dataType), segments))
    return out.select(*records.columns)
