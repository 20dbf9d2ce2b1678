import random
import re
import zlib
from collections import Counter, defaultdict

from colloquy.llm import spelling as sp
from pyspark.sql import functions as F

from tests.llm.helpers import CLASH, empty, frame
from tests.oracle import compare, connection


def words_of(rows):
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                yield w


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))  # noqa: B905
    return a[k:] == b[k + 1 :] or (len(a) == len(b) and a[k + 1 :] == b[k + 1 :])


def brute(words):
    n = {w: c for w, c in Counter(words).items() if c >= 2}
    beside, form = defaultdict(list), {}
    for w in n:
        beside[w] = [v for v in n if near(w, v)]
        if beside[w]:
            best = min(beside[w], key=lambda v: (-n[v], v))
            form[w] = best if n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form.get(root):
            root = form[root]
        f = form.get(w)
        out.append((w, f, root, n[w], len(beside[w]), n[f] if f else None))
    return sorted(map(str, out))


def as_text(out):
    return sorted(str((r.word, r.form, r.root, r.n, r.n_near, r.form_n)) for r in out.collect())


def variants(seed, bases, copies):
    r, out = random.Random(seed), []
    for b in bases:
        out += [b] * copies
        for _ in range(40):
            w = list(b)
            for _ in range(r.choice([1, 1, 2])):
                k = r.randrange(len(w))
                w[k : k + r.randrange(2)] = r.choice([[], ["e"], ["é"], list("zz")])
            out += ["".join(w)] * r.choice([1, 2, 2, 3])
    return out


def words_frame(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "word string").repartition(3)
    for c in (*CLASH, "wid", "n", "key", "kind", "root", "form"):
        df = df.withColumn(c, F.lit("other"))
    return df


def test_groups_agree_with_brute_force(spark):
    # chains (400, 40, 4), ties in n, doubled letters, near words that are both longer and shorter
    words = variants(1, ["language", "aaaaaaaaa", "mississippi", "straßenbahn"], 100)
    words += ["chained"] * 400 + ["chainee"] * 40 + ["chainees"] * 4 + ["tiedtwoa"] * 50 + ["tiedtwob"] * 50 + ["tiedtwoc"] * 5
    out = sp.spelling_groups(words_frame(spark, [*words, None]))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = as_text(out)
    assert got == brute(words)
    assert any("'chainees', 'chainee', 'chained'" in r for r in got)


def test_long_words_are_keyed_by_hashes(spark):
    r = random.Random(3)
    base = "".join(r.choice("ab") for _ in range(66))
    words = [base[:k] + x + base[k + d :] for k in range(0, 66, 3) for x in ("", "a", "q") for d in (0, 1)] * 2
    words += [base] * 40 + [base[:65]] * 3 + [base[:64]] * 3 + [base[:63]] * 2 + ["x" * 3000, "x" * 2999, "x" * 1500 + "y" + "x" * 1499] * 2
    assert as_text(sp.spelling_groups(words_frame(spark, words))) == brute(words)


def test_both_kinds_of_keys_say_the_same():
    for w in ("", "a", "aab", "word", "abcabc"):
        for other in ("b", "aabb", "wird", "wor", "abcab", "aabcabc", w):
            meet = [{k for kind, k in keys(w) if kind == 1} & {k for kind, k in keys(other) if kind == 1} for keys in (sp.plain_keys, sp.long_keys)]
            assert len(meet[0]) == len(meet[1])


def test_words_of_texts(spark):
    rows = [(1, None), (2, ""), (3, "  \n"), (None, "Letters LETTERS letters"), (4, "ÀÉÎ×÷ÿß Zürich-abcdefg ABCDEFGH_abcdefgh"), (5, "k" * 50_000)]
    rows += [(i, "the quick Browning riflemen wandering homewards abcdef") for i in range(200)]
    got = sorted(r.word for r in sp.text_words(frame(spark, rows)).collect())
    assert got == sorted(words_of(rows))
    assert as_text(sp.spelling_groups(sp.text_words(frame(spark, rows)))) == brute(words_of(rows))


def test_no_words(spark):
    assert sp.spelling_groups(sp.text_words(empty(spark))).count() == 0


def test_agrees_with_sql_and_brute_force(spark, sf_dir):
    out = sp.op13_spelling(spark, sf_dir)
    assert compare(out, connection(sf_dir), sp.OP13_SQL)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert as_text(out) == brute(list(words_of(rows)))
