"""Text functions on mixed-script transcripts, as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as one token.  An ideograph (unified, extension A, zero,
# compatibility, extensions B to H), a Latin word with inner apostrophes, or a run of digits.
CJK = "一-鿿㐀-䶿〇豈-﫿\U00020000-\U0003134f"
LATIN = "a-zà-öø-ɏ"
TOKEN = f"[{CJK}]|[{LATIN}]+(?:['’][{LATIN}]+)*|[0-9]+"

# Facts and transcript markup.
PERCENT = r"\d+(?:\.\d+)?%"
AMOUNT = r"\d+(?:\.\d+)?\s*[萬億千]"
DATE = r"\d{1,2}/\d{1,2}|週[一二三四五六日]|[一二三四五六七八九十]+月"
# a bare number: not inside a word, not before a colon
NUMBER = r"(?<![A-Za-z\d])\d+(?:\.\d+)?(?!:)"
TIME_MARK = r"\[\s*\d+(?:\.\d+)?\s*\]"
SPEAKER_MARK = r"\[S\d+\]|\bS\d+\s*[:：]"


def folded(text: Column) -> Column:
    """Compatibility-composed form (full-width letters and digits become plain ones).

    Only texts with a character beyond ASCII cross to Python; for others a null goes.
    """

    @F.pandas_udf("string")
    def nfkc(s):
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return F.coalesce(nfkc(F.when(F.regexp_like(text, F.lit("[^\\x00-\\x7F]")), text)), text)


def tokens(text: Column) -> Column:
    """Lower-cased tokens of the folded text in order; null and empty texts have none."""
    return F.regexp_extract_all(F.lower(folded(F.coalesce(text, F.lit("")))), F.lit(TOKEN), F.lit(0))


#: Digits, blanks and word edges are meant in all scripts, which Java must be told.
_ALL = "(?U)"


def without_markup(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, _ALL + TIME_MARK, " "), _ALL + SPEAKER_MARK, " ")


def salient_facts(text: Column) -> Column:
    """Distinct percentages, amounts and dates, blanks inside removed, sorted; null text: none."""
    text = F.coalesce(text, F.lit(""))
    found = [F.regexp_extract_all(text, F.lit(_ALL + p), F.lit(0)) for p in (PERCENT, AMOUNT, DATE)]
    return F.array_sort(F.array_distinct(F.transform(F.concat(*found), lambda x: F.replace(x, F.lit(" "), F.lit("")))))


def all_facts(text: Column) -> Column:
    """Salient facts outside of markup, and bare numbers that are no part of them, sorted.

    A number counts as part of a fact if the facts in sorted order, written without a gap,
    hold it.
    """
    plain = without_markup(F.coalesce(text, F.lit("")))
    numbers = F.array_distinct(F.regexp_extract_all(plain, F.lit(_ALL + NUMBER), F.lit(0)))
    facts = salient_facts(plain)
    return F.array_sort(F.array_union(facts, F.filter(numbers, lambda x: ~F.contains(F.array_join(facts, ""), x))))


def fidelity(transcript: Column, summary: Column) -> Column:
    """``struct(hallucinated, covered, missed, hallucination_rate, coverage)`` of a summary.

    Facts of the summary that the transcript has not; salient facts of the transcript with and
    without a place in the summary.  No facts in the summary: rate 0; none salient: coverage 1.
    """
    own, said, salient = all_facts(summary), all_facts(transcript), salient_facts(transcript)
    wrong, held = F.array_except(own, said), F.array_intersect(salient, own)
    return F.struct(
        F.array_sort(wrong).alias("hallucinated"),
        F.array_sort(held).alias("covered"),
        F.array_sort(F.array_except(salient, own)).alias("missed"),
        F.when(F.size(own) > 0, F.size(wrong) / F.size(own)).otherwise(0.0).alias("hallucination_rate"),
        F.when(F.size(salient) > 0, F.size(held) / F.size(salient)).otherwise(1.0).alias("coverage"),
    )


def loops(items: Column, n: int = 3, least: int = 4) -> Column:
    """Whether ``least`` or more consecutive places repeat the n items before them.

    So many places in a row do so if ``n + least - 1`` items in a row equal the item n before.
    """

    def run(held: Column) -> Column:
        later = F.slice(held, n + 1, F.greatest(F.size(held) - n, F.lit(0)))
        earlier = F.slice(held, 1, F.greatest(F.size(held) - n, F.lit(0)))
        return F.array_join(F.zip_with(earlier, later, lambda x, y: F.when(x == y, "1").otherwise("0")), "")

    # the items are bound once: split inside a lambda they would be split again for each
    return F.contains(F.get(F.transform(F.array(items), run), F.lit(0)), F.lit("1" * (n + least - 1)))


def cleaned(text: Column) -> Column:
    """White space of any script inside made single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, _ALL + r"\s+", " "))


def family(name: Column) -> Column:
    """A layer's name without the number after a dot or hash."""
    return F.regexp_replace(name, r"([.#])\d+(?=\.|$)", "$1*")


def id_number(label: Column) -> Column:
    """The number at a label's end; null where there is none."""
    return F.nullif(F.regexp_extract(label, r"(\d+)$", 1), F.lit("")).cast("long")


def joined(a: Column, b: Column) -> Column:
    """Two texts with a blank between, or none between two ideographs."""
    a, b = F.rtrim(a), F.ltrim(b)
    tight = F.regexp_like(a, F.lit(f"[{CJK}]$")) & F.regexp_like(b, F.lit(f"^[{CJK}]"))
    return F.when(a == "", b).when(b == "", a).when(tight, F.concat(a, b)).otherwise(F.concat_ws(" ", a, b))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Shared over all distinct items; an empty side gives 0, two empty sides ``both_empty``."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def target_text(segments: Column) -> Column:
    """``[start][Sxx]text[end]`` of each segment, joined; a label that is no number is S01."""
    number = lambda s: F.when(s.rlike("^[0-9]+$"), s.cast("int") + 1).otherwise(1)
    return F.array_join(
        F.transform(
            segments,
            lambda s: F.format_string("[%.2f][S%02d]%s[%.2f]", s["start"], number(s["speaker"]), s["text"], s["end"]),
        ),
        "",
    )


def token_weights(labels: Column, special: Column, heavy: float = 4.0) -> Column:
    """0 for masked labels (-100), ``heavy`` for special ids and the place after one, else 1."""
    return F.transform(
        labels,
        lambda x, i: F.when(x == -100, 0.0)
        .when(F.array_contains(special, x) | F.coalesce(F.array_contains(special, F.get(labels, i - 1)), F.lit(False)), heavy)
        .otherwise(1.0),
    )


def padded(ids: Column, size: int, fill: int) -> Column:
    """The last ``size`` items, filled up on the right."""
    kept = F.slice(ids, F.greatest(F.size(ids) - size + 1, F.lit(1)), size)
    return F.concat(kept, F.array_repeat(F.lit(fill), F.lit(size) - F.size(kept)))
