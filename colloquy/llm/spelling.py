"""Spelling variants of a corpus' words by wildcard groups, without pairs of words.

A word stands once in the group of each of its positions, named by the position, what comes
before and what comes after: words of one group differ from each other in that one place.  A
group hands each member its size and its best other word, which its top two words are enough
for.  Words with one code point deleted join the vocabulary, which gives both sides of every
insertion.  What a word gets from its groups is then added up, so the work grows with the
letters of the vocabulary and not with the pairs of near words.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import drop_stage, stage, table
from colloquy.llm.exact_dedup import LOWER, UPPER

LETTERS = "A-Za-z\\u00C0-\\u00FF"
#: A run whose checksum this divides has lost a code point.
LOSS = 31
LEAST_CHARS, LEAST_COUNT = 7, 2
#: A form occurs so many times as often.
TIMES = 10
#: Words up to this length are keyed by their letters, longer ones by 127-bit rolling hashes, so
#: that a run of a million letters costs a million short keys.
PLAIN = 64
#: Keys that leave a task at once, and words that one part of the vocabulary holds.
AT_ONCE, PART_WORDS = 1 << 16, 200_000
_PRIME, _BASE = (1 << 127) - 1, 0x2545F4914F6CDD1D2545F4914F6CDD1D


def text_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """``(word)`` for each run of letters that has ``least_chars`` code points after its loss.

    A null id counts as empty in the checksum.  Runs too short before the loss never qualify,
    so the pattern leaves them out.
    """
    runs = F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"[{LETTERS}]{{{least_chars},}}"), F.lit(0)))
    d = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), runs.alias("run"))
    d = d.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    d = d.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    lost = F.col("h") % LOSS == 0
    return d.where(~lost | (F.length("run") > least_chars)).select(F.when(lost, shorter).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """``(wid, word, n)`` of the words that occur often enough; wid rises in code-point order."""
    counted = stage(words.where("word is not null").groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count), "spelling-counts")
    parts = max(1, counted.count() // PART_WORDS)
    ordered = counted.repartitionByRange(parts, "word").sortWithinPartitions("word")
    # parts are in order and so are the rows of each: the row number is the word's place
    out = stage(ordered.select(F.monotonically_increasing_id().alias("wid"), "word", "n"), "spelling-words")
    drop_stage(counted)
    return out


def plain_keys(word: str) -> Iterator[tuple[int, bytes]]:
    """``(kind, key)``: the word itself (0), each group it stands in (1), each deletion of it (2)."""
    yield 0, word.encode()
    for i in range(len(word)):
        yield 1, f"{i}:{word[:i]}|{word[i + 1 :]}".encode()
    if len(word) <= PLAIN:
        for i in range(len(word)):
            if i == 0 or word[i] != word[i - 1]:  # deleting any letter of a run gives the same
                yield 2, (word[:i] + word[i + 1 :]).encode()


def _hash_key(mark: bytes, value: int) -> bytes:
    return mark + (value % _PRIME).to_bytes(16, "big")


def long_keys(word: str) -> Iterator[tuple[int, bytes]]:
    """As ``plain_keys``, with the rolling hash of each string in place of it."""
    n, codes = len(word), [ord(c) for c in word]
    powers = [1] * (n + 1)
    for i in range(n):
        powers[i + 1] = powers[i] * _BASE % _PRIME
    after = [0] * (n + 1)  # of the letters from i on
    for i in range(n - 1, -1, -1):
        after[i] = (codes[i] * powers[n - 1 - i] + after[i + 1]) % _PRIME
    yield 0, _hash_key(b"\xff", after[0])
    before = 0
    for i, c in enumerate(codes):
        yield 1, _hash_key(b"\xfe%d:" % i, before * powers[n - i] + after[i + 1])
        if i == 0 or c != codes[i - 1]:
            value = before * powers[n - 1 - i] + after[i + 1]
            yield 2, _hash_key(b"\xff", value) if n - 1 > PLAIN else (word[:i] + word[i + 1 :]).encode()
        before = (before * _BASE + c) % _PRIME


def word_keys(vocab: DataFrame) -> DataFrame:
    """``(kind, key, wid, n)``: what each word is looked up by and stands in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, ...] = ([], [], [], [])

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(held, types, strict=True)], ["kind", "key", "wid", "n"])
            for x in held:
                x.clear()
            return out

        types = (pa.int32(), pa.binary(), pa.int64(), pa.int64())
        for b in batches:
            for wid, word, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for kind, key in plain_keys(word) if len(word) <= PLAIN else long_keys(word):
                    for x, v in zip(held, (kind, key, wid, n), strict=True):
                        x.append(v)
                    if len(held[0]) >= AT_ONCE:
                        yield batch()
        yield batch()

    return vocab.select("wid", "word", "n").mapInArrow(run, "kind int, key binary, wid long, n long")


def _place(n: str, wid: str) -> Column:
    """What is largest for the most frequent word, then for the first in code-point order."""
    return F.struct(F.col(n).alias("n"), (-F.col(wid)).alias("back"))


def near_words(keys: DataFrame) -> DataFrame:
    """``(wid, n_near, best)`` of the words with a near word; best holds its n and minus its wid."""
    own = _place("n", "wid")
    group = Window.partitionBy("key").orderBy(F.desc("n"), "wid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    swapped = (
        keys.where("kind = 1")
        .select("wid", own.alias("own"), F.count("*").over(group).alias("size"), F.first(own).over(group).alias("top"), F.nth_value(own, 2).over(group).alias("second"))
        .where("size > 1")
        .select("wid", (F.col("size") - 1).alias("near"), F.when(F.col("top") == F.col("own"), F.col("second")).otherwise(F.col("top")).alias("best"))
    )
    words = keys.where("kind = 0").select("key", F.col("wid").alias("short"), F.col("n").alias("short_n"))
    joined = keys.where("kind = 2").select("key", "wid", "n").join(words, "key")
    # a row is a deletion that is a word: the longer word gets the shorter one and the other way round
    sides = F.array(
        F.struct(F.col("wid"), _place("short_n", "short").alias("best")), F.struct(F.col("short").alias("wid"), _place("n", "wid").alias("best"))
    )
    shifted = joined.select(F.inline(sides)).select("wid", F.lit(1).cast("long").alias("near"), "best")
    return swapped.unionByName(shifted).groupBy("wid").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))


def last_forms(forms: DataFrame) -> DataFrame:
    """``forms(wid, form)`` -> ``(wid, root)``, the end of the chain of forms from each word.

    A form occurs ``TIMES`` times as often, so chains are short and have no circle; each round
    doubles the steps taken.
    """
    cur = stage(forms.select("wid", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = cur.select(F.col("wid").alias("root"), F.col("root").alias("next"))
        new = stage(cur.join(ahead, "root", "left").select("wid", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        drop_stage(cur)
        if not new.where("moved").head(1):
            return new.select("wid", "root")
        cur = new


def spelling_groups(words: DataFrame, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """``words(word)``, one row an occurrence -> ``(word, form, root, n, n_near, form_n)``.

    Words that occur ``least_count`` times, whatever their length; two are near if they differ
    by one inserted, deleted or replaced code point.  A word's form is its most frequent near
    word, of equals the first in code-point order, if that occurs ``times`` times as often; its
    root is the last form from it on.  Null words are not counted.  No words: no rows.
    """
    vocab = vocabulary(words, least_count)
    keys = stage(word_keys(vocab), "spelling-keys")
    near = stage(near_words(keys), "spelling-near")
    drop_stage(keys)
    known = vocab.join(near, "wid", "left").select(
        "wid", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("best.n") >= F.col("n") * times, F.col("best")).alias("best")
    )
    known = stage(known.select("wid", "word", "n", "n_near", F.col("best.n").alias("form_n"), (-F.col("best.back")).alias("form_id")), "spelling-known")
    roots = last_forms(known.where("form_id is not null").select("wid", F.col("form_id").alias("form")))
    named = lambda c: vocab.select(F.col("wid").alias(f"{c}_id"), F.col("word").alias(c))
    changed = known.where("form_id is not null").join(roots.withColumnRenamed("root", "root_id"), "wid")
    changed = changed.join(named("form"), "form_id").join(named("root"), "root_id")
    same = known.where("form_id is null").withColumns({"form": F.lit(None).cast("string"), "root": F.col("word")})
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    return changed.select(*columns).unionByName(same.select(*columns))


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    """Every word of 7 code points and 2 occurrences in all ``documents``, with its near words.

    Null and empty texts have no words, repeated rows count each time, and runs of letters of
    any length are words; rows with a null id are checked as if it were empty.
    """
    return spelling_groups(text_words(table(spark, sf_dir, "documents")))


OP13_SQL = f"""
WITH RECURSIVE steps(i, k, c) AS (
    SELECT range::UBIGINT, 0, range::UBIGINT FROM range(256)
    UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM steps WHERE k < 8
), byte_table AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8
), runs AS (
    SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{{{LEAST_CHARS},}}')), '{UPPER}', '{LOWER}') AS run FROM documents
), counted AS (SELECT run, hex(encode(doc_id || ':' || run)) AS x, count(*) AS n FROM runs GROUP BY run, x
), checked AS (
    SELECT run, n, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(len(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::UBIGINT)),
        lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)::BIGINT])), 4294967295::UBIGINT) AS h
    FROM counted, byte_table
), lost AS (
    SELECT CASE WHEN h % {LOSS} = 0 THEN left(run, (h % len(run))::BIGINT) || substr(run, (h % len(run))::BIGINT + 2) ELSE run END AS word, n FROM checked
), v AS MATERIALIZED (
    SELECT word, sum(n)::BIGINT AS n FROM lost WHERE len(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}
), cut AS MATERIALIZED (
    SELECT DISTINCT word, n, left(word, p - 1) AS a, substr(word, p + 1) AS b, p
    FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS p FROM v)
), pairs AS MATERIALIZED (
    SELECT x.word, x.n, y.word AS other, y.n AS other_n FROM cut x JOIN cut y USING (p, a, b) WHERE x.word <> y.word
    UNION SELECT x.word, x.n, y.word, y.n FROM cut x JOIN v y ON x.a || x.b = y.word
    UNION SELECT y.word, y.n, x.word, x.n FROM cut x JOIN v y ON x.a || x.b = y.word
), near AS (
    SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS best, max(other_n) AS best_n FROM pairs GROUP BY word
), known AS (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {TIMES} * n THEN best END AS form, CASE WHEN best_n >= {TIMES} * n THEN best_n END AS form_n
    FROM v LEFT JOIN near USING (word)
), chain AS (
    SELECT word, word AS root, form AS ahead FROM known
    UNION ALL SELECT chain.word, chain.ahead, k.form FROM chain JOIN known k ON k.word = chain.ahead
)
SELECT word, form, root, n, n_near, form_n FROM known JOIN (SELECT word, root FROM chain WHERE ahead IS NULL) USING (word)
"""
