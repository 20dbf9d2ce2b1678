import random
from difflib import SequenceMatcher

import pytest
from colloquy.functions import writing


@pytest.mark.parametrize("common_out", [False, True])
def test_matched_characters_are_those_of_sequence_matcher(common_out):
    r = random.Random(6)
    for k in range(80):
        letters = "ab" if k % 3 else "abcdefghij klmnop é漢😀"
        x, y = ("".join(r.choice(letters) for _ in range(r.randrange(320))) for _ in range(2))
        y = x[:40] + y + x[60:150] if k % 2 else y
        want = sum(m.size for m in SequenceMatcher(None, x, y, autojunk=common_out).get_matching_blocks())
        assert writing.matched(x, y, common_out) == want
