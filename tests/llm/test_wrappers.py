import random
import time

from colloquy.llm import wrappers as w
from pyspark.sql import functions as F

from tests.llm.helpers import CLASH

PAGE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body>
<nav><ul><li>Home</li><li>News</li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head {k}</h1>{paras}{quote}</article><div class="comments"><p>Nice!</p></div><footer>Foot</footer></body></html>"""


def page(k, n, quote=False):
    paras = "".join(f"<p>Para {j} of\n  {k} &amp; <b>bold</b> more</p>" for j in range(n))
    return PAGE.replace("{k}", str(k)).replace("{paras}", paras).replace("{quote}", "<blockquote>Said &eacute;</blockquote>" if quote else "")


def text(k, n, quote=False):
    return " ".join([f"Head {k}", *[f"Para {j} of {k} & bold more" for j in range(n)], *(["Said é"] if quote else [])])


def test_main_text_of_two_layouts(spark):
    rows = [(k, f"https://a.example/{k}", page(k, 1 + k % 4, k % 3 == 0)) for k in range(12)]
    rows += [(100 + k, f"http://B.example/{k}", f"<body><div class='menu'>Menu</div><div class='post-body'><p>Only {k}</p></div></body>") for k in range(3)]
    rows += [(200, None, None), (201, "odd", ""), (202, None, "<p>just this"), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in (*CLASH, "host", "text", "_main"):
        df = df.withColumn(c, F.lit("other"))
    out = w.main_text(df).collect()
    assert len(out) == len(rows)
    want = {k: text(k, 1 + k % 4, k % 3 == 0) for k in range(12)} | {100 + k: f"Only {k}" for k in range(3)} | {200: "", 201: "", 202: "just this"}
    for r in out:
        assert r.text == want[r.page_id] and r.n_chars == len(r.text)
    assert w.main_text(df.limit(0)).count() == 0
    assert out[0].__fields__ == ["page_id", "url", "text", "n_chars"]


def wrapper(html):
    atoms, texts = w.stream(html)
    return w.Wrapper.of_page(*w.fold(atoms), texts)


def test_alignment_makes_optional_and_repeated_groups():
    one = wrapper("<ul><li>a</li></ul><p>x</p>")
    many = wrapper("<ul><li>a</li><li>b</li><li>c</li></ul>")
    both = one.merged(many)
    assert "+" in both.regex() and ")?" in both.regex()
    assert both.regex() == w.Wrapper.from_json(both.to_json()).regex()


def test_equal_texts_stay_template_and_others_become_slots():
    both = wrapper("<div>Menu<p>one</p></div>").merged(wrapper("<div>Menu<p>two</p></div>"))
    assert [h[0] is None for h in both.held] == [False, True] and '"div"' in both.regex()
    assert both.merged(wrapper("<div>Other<p>two</p></div>")).held[0][0] is None


def test_alignment_is_whole_and_equal_where_matched():
    import random

    r = random.Random(5)
    for most in (w.MOST_CELLS, 40):
        w.MOST_CELLS, before = most, w.MOST_CELLS
        for _ in range(60):
            a, b = ([r.choice("abcdefgh") + r.choice("12345") for _ in range(r.randrange(30))] for _ in range(2))
            i = j = 0
            for x, y, u, v in w.align(a, b):
                assert (x, u) == (i, j) and a[x:y] == b[u:v] or y == x or v == u
                i, j = y, v
            assert (i, j) == (len(a), len(b))
        w.MOST_CELLS = before


def test_long_pages_align_in_seconds_and_bounded_memory():
    import time

    atoms = [f"<div.c{k}>" for k in range(10_000)]
    other = [a for k, a in enumerate(atoms) if k % 7] + [f"<p.c{k}>" for k in range(10_000)]
    at = time.time()
    pieces = w.align(atoms, other)
    assert sum(b > a and d > c for a, b, c, d in pieces) > 8000
    items, slots = w.fold(w.stream("<div><p>x</p></div>" * 10_000)[0])
    assert len(items) == 1 and len(slots[0]) == 10_000
    assert time.time() - at < 20


NEUTRAL = "<html><body><div class='q1'><p>{notice}</p></div><div class='q2'><p>{first}</p><p>{second}</p><h4>Sent from our desk</h4></div><div class='q2'><p>{third}</p></div></body></html>"


def neutral_rows(host, swap):
    """Pages whose classes say nothing; on one host the template box comes first, on the other last."""
    long = lambda k, j: f"Sentence {k} {j} " + "of varying words " * (3 + (k * j) % 5) + "end."
    rows, want = [], {}
    for k in range(8):
        varied, fixed = {"first": long(k, 1), "second": long(k, 2)}, "We value your privacy and so we keep telling you about it at length, on each page."
        html = NEUTRAL.format(notice=fixed, third="Follow us there", **varied)
        if swap:
            html = html.replace("q1", "x").replace("q2", "q1").replace("class='x'", "class='q2'")
        rows.append((100 * swap + k, f"https://{host}/{k}", html))
        want[100 * swap + k] = f"{varied['first']} {varied['second']}"
    return rows, want


def test_neutral_classes_need_the_wrapper(spark):
    rows, want = neutral_rows("one.example", 0)
    more, other = neutral_rows("two.example", 1)
    df = spark.createDataFrame(rows + more, "page_id long, url string, html string")
    got = lambda: {r.page_id: r.text for r in w.main_text(df).collect()}
    assert got() == want | other
    # each page by itself, without a host, can't tell the template from the text
    alone = {r.page_id: r.text for r in w.main_text(df.withColumn("url", F.lit(None).cast("string"))).collect()}
    assert all("privacy" in t or "desk" in t for t in alone.values())


def test_without_alignment_the_result_is_another(spark, monkeypatch):
    rows, want = neutral_rows("one.example", 0)
    extra = "<html><body><div class='q2'><h4>Only on some pages</h4></div><div class='q1'><p>{}</p></div>"
    rows += [(50 + k, f"https://one.example/x{k}", h.replace("<html><body>", extra.format(f"Notice {k % 2}"), 1)) for k, _, h in rows]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want |= {50 + k: t for k, t in want.items()}
    assert {r.page_id: r.text for r in w.main_text(df).collect()} == want

    def place_for_place(left, right):
        n = min(len(left), len(right))
        return [(k, k + 1, k, k + 1) for k in range(n)] + [(k, k + 1, n, n) for k in range(n, len(left))] + [(n, n, k, k + 1) for k in range(n, len(right))]

    monkeypatch.setattr(w, "align", place_for_place)
    seen = {}
    for i, _, h in rows:
        atoms, texts = w.stream(h)
        seen[i] = (texts, *w.fold(atoms))
    one = None
    for texts, items, slots in seen.values():
        new = w.Wrapper.of_page(items, slots, texts)
        try:
            one = new if one is None else one.merged(new)
        except ValueError:  # a run set against a single item
            return
    main = w.main_slots(one)
    got = {i: " ".join(t[k] for k, p in sorted((k, p) for p, s in zip(one.places(x), slots, strict=True) for k in s) if p in main) for i, (t, x, slots) in seen.items()}
    assert got != want


def test_broken_markup_does_not_crash():
    for bad in ("<", "<!--", "<div", "<script>", "</", "<a href='x", "<p><<p>>", "&#xZZ; &nosuch;", "<!doctype", "<style>a{}"):
        w.stream(bad)


def test_pages_of_other_layouts_keep_their_text(spark):
    body = "<html class='no-sidebar'><body class='responsive has-sidebar'><nav>Menu</nav>{}<footer>Foot</footer></body></html>"
    plain = lambda k: body.format(f"<div class='x y z content'><p>Plain {k} text</p><p class='ad'>Buy</p></div>")
    rows = [(k, f"https://m.example/{k}", page(k, 2)) for k in range(3)] + [(10 + k, f"https://m.example/p{k}", plain(k)) for k in range(3)]
    rows += [(20, "https://s.example/1", body.format("<div class='a'><p>One is long enough</p></div><div class='b'><p>Two</p></div>"))]
    rows += [(30, None, page(30, 1)), (31, None, plain(31)), (32, "https://u.example/", body.format("<div><p class='share'>Share<p>Kept<ul><li>Item</ul></div>"))]
    want = {k: text(k, 2) for k in range(3)} | {10 + k: f"Plain {k} text" for k in range(3)}
    want |= {20: "One is long enough Two", 30: text(30, 1), 31: "Plain 31 text", 32: "Kept Item"}
    got = {r.page_id: r.text for r in w.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_long_tables_align_like_short_ones():
    r = random.Random(5)
    for n in range(300):
        some = [*"abcd", ("+", ("a",)), ("+", ("a", "b")), ("+", ("b", ("+", ("a",))))]
        left, right = ([r.choice(some) for _ in range(r.randrange(25))] for _ in range(2))
        assert w._row_table(left, right, r.choice([1, 40, 10_000])) == w._table(left, right), n


def test_pages_with_very_many_items_have_a_wrapper(spark):
    def page(k):
        rows = "".join(f"<div class=r{(j * 7919 + j // 3) % 977}><p>{'fixed' if j % 2 else f'own {k} {j}'}</p></div>" for j in range(900))
        return f"<html><body><div class=x><p>Same words everywhere</p>{rows}</div></body></html>"

    pages = spark.createDataFrame([(k, f"https://long.example/{k}", page(k)) for k in range(4)], "page_id long, url string, html string")
    assert len(w.fold(w.stream(page(1))[0])[0]) > w.MOST_ITEMS
    seen = w.stage(w.streams(pages.withColumn("host", F.lit("long.example"))), "streams")
    assert seen.count() > 0
    found = w.labels(seen, w.infer(seen))
    assert found.count() == 1
    text = w.main_text(pages).where("page_id = 3").first().text
    assert "Same words everywhere" not in text and "own 3 0" in text and "own 3 898" in text


def folded_slowly(atoms):
    items, changed = list(atoms), True
    while changed:
        changed = False
        for size in range(1, w.LONGEST_GROUP + 1):
            out, k = [], 0
            while k < len(items):
                run, reps = items[k : k + size], 1
                plain = not (size == 1 and isinstance(run[0], tuple)) and len(run) == size
                while plain and items[k + reps * size : k + (reps + 1) * size] == run:
                    reps += 1
                again = plain and out[-1:] == [("+", tuple(run))]
                changed |= reps > 1 or again
                out += [("+", tuple(run))] if reps > 1 else [] if again else [items[k]]
                k += reps * size if reps > 1 else size if again else 1
            items = out
    return items


def test_folding_agrees_with_slow_passes_and_skips_those_without_repeats(monkeypatch):
    r = random.Random(9)
    cases = [[r.choice(["#a", "#b/c", "<p>", "</p>"][: r.randrange(1, 5)]) for _ in range(r.randrange(60))] for _ in range(600)]
    cases.append([x for k in range(200) for x in (f"<{k}>", "#", f"<{k}>", "#", "</x>")])
    for letters in (w.MOST_LETTERS, 3):
        monkeypatch.setattr(w, "MOST_LETTERS", letters)
        for atoms in cases:
            items, slots = w.fold(atoms)
            assert items == folded_slowly(atoms)
            assert sorted(k for s in slots for k in s) == [k for k, a in enumerate(atoms) if a[0] == "#"]
    monkeypatch.undo()
    atoms = [f"<{k}>" for k in range(20_000)]
    began = time.process_time()
    w.fold(atoms)
    fast, began = time.process_time() - began, time.process_time()
    folded_slowly(atoms)
    assert fast < (time.process_time() - began) / 3
