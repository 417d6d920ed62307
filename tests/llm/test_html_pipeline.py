import itertools
import math

import pytest

from corpusloom.llm import html_crf as C
from corpusloom.llm.html_blocks import blocks
from corpusloom.llm.html_pages import MARK, labelled_pages


@pytest.fixture(scope="module")
def field():
    return C.trained_field()


def texts(page):
    return [b.text for b in blocks(page)]


def test_blocks():
    assert texts("<p>a <b>b</b>c<!-- x -->d<br>e<p>f &amp; g&nbsp;h</p>") == ["a bcd e", "f & g h"]
    assert texts("<script>if (a<b) '</p>'</script><style>p{}</style><p title='a>b'>x</p><textarea>t") == ["x"]
    assert texts("") == [] and texts("plain  text") == ["plain text"] and texts("<") == ["<"] and texts("a < b") == ["a < b"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert texts("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]
    nested = blocks("<div class='side-bar'><nav><a href=x>link</a></nav></div><p>after</p>")
    assert nested[0].linked == 4 and {"c=side", "t=nav"} <= nested[0].above and "t=nav" not in nested[1].above
    unclosed = blocks("<p><b>one<br><p>two</p></div></p><footer>three")
    assert [b.text for b in unclosed] == ["one", "two", "three"] and "t=footer" in unclosed[2].above


def test_viterbi_is_the_best_of_all(field):
    chain = blocks("<nav>a</nav><article><h1>b c d</h1><p>e f g h.</p><aside>i j</aside><p>k l.</p></article><footer>© m</footer>")
    s = field.scores(chain)

    def total(labels):
        return field.start[labels[0]] + sum(x for x, y in zip(s, labels) if y) + sum(field.step[a][b] for a, b in itertools.pairwise(labels))

    best = max(itertools.product((0, 1), repeat=len(chain)), key=total)
    assert field.decode(chain) == list(best) == [0, 1, 1, 0, 1, 0]


def test_marginals_are_sums_over_all():
    import numpy as np

    s, start, step = np.array([0.5, -1.0, 2.0]), np.array([0.1, -0.2]), np.array([[0.3, -0.4], [0.2, 0.6]])
    one, two = C._marginals(s, start, step)
    weight = {y: math.exp(start[y[0]] + sum(x for x, k in zip(s, y) if k) + sum(step[a, b] for a, b in itertools.pairwise(y))) for y in itertools.product((0, 1), repeat=3)}
    z = sum(weight.values())
    for t in range(3):
        assert abs(one[t, 1] - sum(w for y, w in weight.items() if y[t]) / z) < 1e-9
    assert abs(two[1, 0, 1] - sum(w for y, w in weight.items() if y[1:] == (0, 1)) / z) < 1e-9


def test_held_out_pages(field):
    wrong = total = 0
    for page in labelled_pages(150, seed=77):
        chain = blocks(page)
        labels = [MARK in b.text for b in chain]
        for b in chain:
            b.text = b.text.replace(MARK, "")
        wrong += sum(a != bool(b) for a, b in zip(labels, field.decode(chain)))
        total += len(labels)
    assert wrong <= 0.03 * total


def test_pages(spark, field):
    page = (
        "<html><head><title>T</title></head><body><header>Site name</header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies.</div><div class='ad'>Buy this now.</div>"
        "<article><h1>Head &amp; line</h1><p>First  part of it.<p>Second <i>part</i> of it.<aside>Aside text.</aside><form><label>Mail</label></form><p>Third part.</p></article>"
        "<section id='comments'><p>A comment that is long enough to read.</p></section><aside>More</aside><footer>&copy; me</footer></body></html>"
    )
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (1, "u", page), (None, "u", "<article><p>" + "word " * 60_000 + "</p></article>"), (4, "u", "<nav>only</nav>")]
    got = C.extract_main_text(spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, text string")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 6 and by[1].text == "Head & line First part of it. Second part of it. Third part." and by[1].n_chars == len(by[1].text)
    assert by[2].text == by[3].text == by[4].text == "" and by[None].n_chars == 60_000 * 5 - 1
    assert C.extract_main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_pipeline_is_its_stages(spark, tmp_path):
    """run() against plain versions of what its stages decide, over the smallest tables."""
    import corpus_pipeline
    from tests.llm.test_groups import plain_fingerprint, reach

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    left = docs
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in left.collect()}
        out = str(tmp_path / str(number))
        stage(spark, left, sf).write.parquet(out)
        left = spark.read.parquet(out)
        after = [r.doc_id for r in left.select("doc_id").collect()]
        assert len(after) == len(set(after)) and set(after) <= set(before)
        if number < 4:
            assert left.columns == docs.columns
        if number == 0:
            good = [d for d in before if labels.get(d) == 1]
            assert sum(d in after for d in good) >= 0.98 * len(good) and sum(d in after for d in before if labels.get(d) == 0) <= 2
        if number == 1:
            ids = sorted(before)
            prints = [plain_fingerprint(before[d].text) for d in ids]
            root = reach(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2])
            assert sorted(after) == sorted({ids[r] for r in root})
        if number == 2:
            bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            leaks = {d for d, r in before.items() if any(b in r.text for b in bench)}
            assert set(before) - set(after) == leaks
        if number == 4:
            assert sorted(after) == sorted(before)
    final = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, final.collect())) == sorted(map(str, left.collect()))
