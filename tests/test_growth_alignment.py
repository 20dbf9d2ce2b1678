import random
import tracemalloc

from colloquy.functions import edits


def test_long_alignments_are_held_in_part():
    r = random.Random(2)
    for _ in range(60):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(30))] for _ in range(2))
        assert edits.alignment(a, b, 1) == edits.alignment(a, b)
    a = [r.choice("abcdefgh") for _ in range(4000)]
    b = [x for x in a if r.random() > 0.1]
    tracemalloc.start()
    pairs = edits.alignment(a, b, 1 << 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 << 20 and [i for i, _ in pairs if i is not None] == list(range(4000))
