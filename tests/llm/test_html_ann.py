import random
import re
import time

import numpy as np

from kindred.llm import ann, html_extract

#: What a tag is, as one expression (quadratic on hostile pages).
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?]?(/?[a-zA-Z][a-zA-Z0-9:-]*)?[^<>]*>", re.S | re.I | re.A)


def by_expression(page):
    names, texts, at = [], [], 0
    for m in TOKEN.finditer(page):
        texts.append(page[at : m.start()])
        names.append((m[1] or m[2] or html_extract.OTHER).lower())
        at = m.end()
    return names, [*texts, page[at:]]


def test_scan_equals_expression():
    rng = random.Random(1)
    parts = ["<", ">", "</", "<p>", "</p>", "<script", "<script>", "</script>", "</SCRIPT >", "<!--", "-->", " word ", "<svg a='>'>", "</svg", "<1", "<!doctype x>", "a", "<ſcript>", "İ", "<style>", "</style>", "<scripty>", "\n"]
    for _ in range(3000):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert html_extract.tokens(page) == by_expression(page), page


def test_hostile_pages_take_linear_time():
    for piece in ("<script ", "<script>", "<", "<!--", "<" + "a" * 50, "</script", "<style></style", "<p><script x>"):
        began = time.time()
        html_extract.extract(piece * (5_000_000 // len(piece)), {})
        assert time.time() - began < 8, piece


def test_best_region_equals_all_regions():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 9))
        words, tags = rng.integers(0, 6, n).astype(float).tolist(), (-rng.integers(0, 8, n - 1)).astype(float).tolist()
        sums = {(a, b): sum(words[a : b + 1]) + sum(tags[a:b]) for a in range(n) for b in range(a, n)}
        a, b, best = html_extract.best_region(words, tags)
        assert best == max(0.0, *sums.values())
        if best > 0:
            first = min(y for (_, y), s in sums.items() if s == best)
            assert (a, b) == (max(x for (x, y), s in sums.items() if s == best and y == first), first)


def test_known_region_equals_all_regions():
    rng = random.Random(2)
    for _ in range(100):
        content = [f"c{i}" for i in range(rng.randint(2, 6))]
        texts = [["noise"] * rng.randint(0, 3), content[:2], ["x"] * rng.randint(0, 1), content[2:], ["noise"] * rng.randint(1, 3)]
        pairs, score, last = set(zip(content, content[1:])), [], None
        for t in texts:
            score.append(0)
            for w in t:
                score[-1] += 1 if (last, w) in pairs or w == content[0] or (last is None and w in content) else -3
                last = w
        best = max(sum(score[a : b + 1]) for a in range(5) for b in range(a, 5))
        a, b = html_extract._known_region(texts, content)
        assert sum(score[a : b + 1]) == max(best, 0)


def test_learnt_weights_find_the_content_of_their_pages():
    rng = random.Random(3)
    pages = []
    for _ in range(30):
        content = [[f"w{rng.randint(0, 999)}" for _ in range(rng.randint(3, 9))] for _ in range(3)]
        nav = "".join(f"<li><a>n{rng.randint(0, 99)} m{rng.randint(0, 99)}</a></li>" for _ in range(8))
        pages.append((f"<ul>{nav}</ul><div>" + "".join(f"<p>{' '.join(c)}</p>" for c in content) + f"</div><ul>{nav}</ul>", " ".join(" ".join(c) for c in content)))
    weights = html_extract.learn(pages)
    found = sum(" ".join(html_extract.extract(p, weights)[0].split()) == c for p, c in pages)
    # Exhaustive search: weights of a grid that find all pages do exist, and learning finds nearly all.
    assert any(all(" ".join(html_extract.extract(p, {"li": -a, "/li": -a, "p": -b, "/p": -b, "?": -1.0})[0].split()) == c for p, c in pages) for a in (0.5, 2, 5) for b in (0.05, 0.5, 2))
    assert found >= 0.9 * len(pages), (found, weights)
    assert html_extract.learn([]) == {html_extract.OTHER: -1.0}


def test_empty_tables_and_pages_without_a_label(spark):
    pages = spark.createDataFrame([(1, "no number", "<p>one two</p><b>three</b>")], "page_id long, url string, html string")
    docs = spark.createDataFrame([(5, "other")], "doc_id long, text string")
    assert [tuple(r)[:3] for r in html_extract.main_text(pages, docs).collect()] in ([(1, "one two", 2)], [(1, "one two\nthree", 3)])
    assert html_extract.main_text(pages, docs).count() == 1
    assert html_extract.main_text(pages.where("false"), docs).count() == 0
    assert html_extract.main_text(pages, docs.where("false")).count() == 1


def brute(v, k):
    d = np.sqrt(((v[:, None].astype(float) - v[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return d, np.argsort(d, axis=1, kind="stable")[:, :k]


def test_neighbours_across_cells(spark):
    """Many small cells: what the neighbouring cells add is found, distances are true, and ranks follow them."""
    rng = np.random.default_rng(7)
    v = (rng.standard_normal((700, 8)) + 3 * rng.integers(0, 3, (700, 1))).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>").repartition(5)
    found = ann.nearest_neighbours(df, k=10, cell_rows=40).toPandas()
    d, near = brute(v, 10)
    assert np.allclose(found.distance, d[found.vec_id, found.neighbour_id], atol=1e-4)
    assert len({(i, j) for i in range(700) for j in near[i]} & set(zip(found.vec_id, found.neighbour_id))) > 0.9 * 7000
    by = found.sort_values(["vec_id", "rank"])
    assert all(x == list(range(1, 11)) for x in by.groupby("vec_id")["rank"].apply(list))
    assert (by.groupby("vec_id").distance.diff().fillna(0) >= 0).all()


def test_few_equal_and_empty_vectors(spark):
    table = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    few = ann.nearest_neighbours(table([(i, [float(i), 0.0]) for i in range(4)]), k=10).collect()
    assert len(few) == 12 and {r["rank"] for r in few} == {1, 2, 3}
    equal = ann.nearest_neighbours(table([(i, [1.0, 2.0]) for i in range(30)]), k=3).collect()
    got = {i: [r["neighbour_id"] for r in sorted(equal, key=lambda r: r["rank"]) if r["vec_id"] == i] for i in range(30)}
    assert got[0] == [1, 2, 3] and got[2] == [0, 1, 3] and got[29] == [0, 1, 2]
    assert ann.nearest_neighbours(table([(1, [0.0] * 4), (2, [0.0] * 4)]), k=3).count() == 2
    assert ann.nearest_neighbours(table([(1, []), (2, [])]), k=3).count() == 0


def test_queries_are_searched_for_among_all_vectors(spark):
    """Queries alone have rows, the same ones as in a search of all, and true neighbours from all vectors."""
    rng = np.random.default_rng(9)
    v = (rng.standard_normal((900, 8)) + 3 * rng.integers(0, 3, (900, 1))).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>").repartition(4)
    few = [tuple(r) for r in ann.nearest_neighbours(df, k=10, cell_rows=60, every=100).collect()]
    assert {r[0] for r in few} == set(range(0, 900, 100)) and len(few) == 90
    assert sorted(few) == sorted(tuple(r) for r in ann.nearest_neighbours(df, k=10, cell_rows=60).where("vec_id % 100 = 0").collect())
    _, near = brute(v, 10)
    assert len({(i, j) for i in range(0, 900, 100) for j in near[i]} & {r[:2] for r in few}) >= 81
    assert ann.nearest_neighbours(df.where("vec_id % 100 <> 0"), cell_rows=60, every=100).count() == 0


def test_queries_for_other_cells_leave_in_small_batches():
    made = []
    found = ((made.append(i), (i, b"i" * 10, b"v" * 60, b"p" * 20, b"b" * 10))[1] for i in range(95))
    batches = ann.batches_of(found, 1000)
    assert len(next(batches)) == 10 and len(made) == 10
    rest = list(batches)
    assert [len(b) for b in rest] == [10] * 8 + [5] and [x for b in rest for x in b.column(0).to_pylist()] == list(range(10, 95))
