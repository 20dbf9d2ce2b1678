import random
import re

import xxhash
from colloquy.llm import simhash as sh
from colloquy.llm.components import connected_components

from tests.llm.helpers import edge_rows, empty, frame, prose


def fingerprint(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    sh_ = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh_]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(codes, radius=3):
    up = list(range(len(codes)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= radius:
                up[find(i)] = find(j)
    return [find(i) for i in range(len(codes))]


def test_components_agree_with_brute_force(spark):
    rows = [*edge_rows(), (30, prose(1, 80).upper()), (31, prose(4, 30_000) + " tail")]
    out = sh.simhash_components(frame(spark, rows)).collect()
    codes = [fingerprint(t) for _, t in rows]
    roots = components(codes)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = sorted((str(i), c, least.get(r)) for (i, _), c, r in zip(rows, codes, roots, strict=True))
    assert sorted((str(r.doc_id), r.fp & (1 << 64) - 1, r.component_id) for r in out) == want


def test_dense_clusters_are_cut_into_parts_without_losing_links(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(6)]
    codes = list(dict.fromkeys([b ^ sum(1 << r.randrange(64) for _ in range(r.randrange(4))) for b in base for _ in range(60)]))
    df = spark.createDataFrame([(k, sh._signed(c & (1 << 64) - 1)) for k, c in enumerate(codes)], "id long, fp long")
    links = sh.near_links(df, shard_rows=10)
    got = {x.node: x.component for x in connected_components(links).collect()}
    roots = components(codes)
    first = {}
    for k, root in enumerate(roots):
        first.setdefault(root, k)
    assert [got.get(k, k) for k in range(len(codes))] == [first[x] for x in roots]


def test_tree_finds_what_a_scan_finds():
    r = random.Random(9)
    codes = list({r.getrandbits(12) for _ in range(300)})
    tree = sh.BKTree(codes)
    for q in codes[:50]:
        assert sorted(tree.within(q, 2)) == sorted(c for c in codes if (c ^ q).bit_count() <= 2)


def test_empty_table_and_no_edges(spark):
    assert sh.simhash_components(empty(spark)).count() == 0
    assert connected_components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0


def test_long_chain_is_one_component(spark):
    e = spark.range(0, 500).selectExpr("id + 1 as a", "id as b")
    assert {r.component for r in connected_components(e).collect()} == {0}


def test_the_query_on_the_whole_table(spark, sf_dir):
    docs = sorted((r.doc_id, fingerprint(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    roots, least = components([c for _, c in docs]), {}
    for (i, _), r in zip(docs, roots, strict=True):
        least.setdefault(r, i)
    out = sh.op8_simhash(spark, sf_dir)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(tuple(r) for r in out.collect()) == [(i, f"{c:016x}", least[r]) for (i, c), r in zip(docs, roots, strict=True)]
