"""Exact duplicates by two passes over a Bloom filter, in DataFrame functions only.

The first pass sets a filter cell only where two rows or more hit it, so the filter answers
whether a hash may occur twice.  The second pass asks it for every row: a row that it clears is
alone and passes straight through, and only the others shuffle, to be grouped by their whole
hash.  Groups that hold over a thousandth of all rows are at most a thousand; their outcome is
broadcast and their rows stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import stage, table

#: Cells of one block of the filter: a bitmap of ``bitmap_construct_agg``.
BLOCK_CELLS = 32_768
#: Cells that each row has, where the largest filter allows it.
CELLS_PER_ROW = 16
#: The filter is broadcast: 8,192 blocks of 4 KB are 32 MB whatever the corpus.  A corpus of more
#: rows than a sixteenth of its cells is judged as right, but more of its rows shuffle.
MOST_BLOCKS = 8_192
#: Groups of more than this share of the rows are broadcast, so at most this many.
HOT_SHARE = 1_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal_text(text: Column) -> Column:
    """The text with A-Z lower-cased; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def blocks_for(rows: int, most: int = MOST_BLOCKS) -> int:
    """A power of two of filter blocks, so that each row has ``CELLS_PER_ROW`` cells if allowed."""
    wanted = max(1, -(-rows * CELLS_PER_ROW // BLOCK_CELLS))
    return min(most, 1 << (wanted - 1).bit_length())


def _places(hashed: DataFrame, blocks: int) -> DataFrame:
    """Adds the block and the two cells in it that a row's hash falls to."""
    h = F.xxhash64("digest")
    cell = lambda shift: F.shiftright(h, shift).bitwiseAND(F.lit(BLOCK_CELLS - 1))
    return hashed.withColumns({"block": F.pmod(h, F.lit(blocks)), "cell_1": cell(20), "cell_2": cell(40)})


def repeat_filter(placed: DataFrame) -> DataFrame:
    """``(block, cells)``: a bitmap of the cells that more than one row hits.

    What shuffles is a number for each cell that a task hits, counted in the task before.
    """
    hits = placed.select("block", F.explode(F.array("cell_1", "cell_2")).alias("cell"))
    twice = hits.groupBy("block", "cell").count().where("count > 1")
    return twice.groupBy("block").agg(F.bitmap_construct_agg("cell").alias("cells"))


def _is_set(cell: str) -> Column:
    byte = f"cast(conv(hex(substring(cells, cast({cell} div 8 as int) + 1, 1)), 16, 10) as bigint)"
    return F.expr(f"cells is not null and getbit({byte}, cast({cell} % 8 as int)) = 1")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: list[str] | None = None,
    most_blocks: int = MOST_BLOCKS,
    hot_share: int = HOT_SHARE,
) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256[, rest])`` for every row of ``docs``.

    Texts are equal when identical after lower-casing A-Z only, which the SHA-256 of the
    normalised text stands for; null counts as empty.  Of equal texts the row with the largest
    id stays.  Rows with a null id give way to all others; of rows that repeat an id and a
    text exactly one stays.  Columns named in ``carry`` ride along in the struct ``rest``.
    Empty table: no rows.
    """
    rest = [F.struct(*carry).alias("rest")] if carry else []
    digest = F.unhex(F.sha2(normal_text(F.col(text_col)), 256))
    read = docs.select(F.col(id_col).alias("doc_id"), digest.alias("digest"), *rest)
    # the row number decides between repeated rows, so it is written down with them
    hashed = stage(read.withColumn("row", F.monotonically_increasing_id()), "dedup-hashes")
    rows = hashed.count()
    placed = _places(hashed, blocks_for(rows, most_blocks))
    found = stage(repeat_filter(placed), "dedup-filter")
    asked = placed.join(F.broadcast(found), "block", "left")
    asked = asked.withColumn("again", _is_set("cell_1") & _is_set("cell_2")).drop("block", "cells", "cell_1", "cell_2")
    suspects = asked.where("again").drop("again")
    groups = stage(
        suspects.groupBy("digest")
        .agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("keep"))
        .where("group_size > 1"),
        "dedup-groups",
    )
    is_hot = F.col("group_size") * hot_share > rows
    hot = suspects.join(F.broadcast(groups.where(is_hot)), "digest", "left")
    cold = hot.where("keep is null").drop("group_size", "keep").join(groups.where(~is_hot), "digest", "left")
    alone = {"group_size": F.lit(1).cast("long"), "keep": F.struct("doc_id", "row")}
    whole = asked.where(~F.col("again")).drop("again").withColumns(alone)
    for part in (hot.where("keep is not null"), cold):
        whole = whole.unionByName(part.withColumns({c: F.coalesce(c, x) for c, x in alone.items()}))
    return whole.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("keep.row") == F.col("row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        *(["rest"] if carry else []),
    )


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return exact_dedup(docs, id_col, text_col, docs.columns).where("kept").select("rest.*")


def op11_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the row that stays for its text; nulls, empty, long and
    repeated texts as in ``exact_dedup``."""
    return exact_dedup(table(spark, sf_dir, "documents"))


OP11_SQL = f"""
WITH d AS (
    SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
