"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from colloquy.llm.suffix_dedup import op2_suffix_dedup
from colloquy.llm.toxicity import op1_toxicity
from colloquy.llm.wrappers import op5_wrappers
from colloquy.llm.centroids import OP12_SQL, op12_lloyd
from colloquy.llm.ctw import op9_ctw
from colloquy.llm.exact_dedup import OP11_SQL, op11_exact_dedup
from colloquy.llm.media import op4_media
from colloquy.llm.packing import op7_packing
from colloquy.llm.rans import op6_token_files
from colloquy.llm.quality import op3_quality
from colloquy.llm.sentencepiece_trie import op10_sentencepiece
from colloquy.llm.simhash import op8_simhash
from colloquy.llm.spelling import OP13_SQL, op13_spelling


def queries() -> dict:
    found = [op1_toxicity, op2_suffix_dedup, op3_quality, op4_media, op5_wrappers, op6_token_files, op7_packing, op8_simhash]
    found += [op9_ctw, op10_sentencepiece, op11_exact_dedup, op12_lloyd, op13_spelling]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict:
    return {"op11_exact_dedup": OP11_SQL, "op12_lloyd": OP12_SQL, "op13_spelling": OP13_SQL}
