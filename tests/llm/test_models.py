"""Classifiers, vectors, pages and pieces."""

import html

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.llm import html_extract, pieces, projection_passes, quality_classifier, toxicity
from textmill.llm.labelled import remainder

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def accuracy(scores, labels, label, held):
    rows = scores.join(labels, "doc_id").where(held).select((F.col("score") >= 0.5).cast("int").alias("p"), F.col(label).alias("y")).collect()
    hit = [[r["p"] == r["y"] for r in rows if r["y"] == y] for y in (0, 1)]
    return [sum(h) / max(1, len(h)) for h in hit]


def test_quality_on_held_out_rows(tables):
    docs, labels = tables
    held = remainder(F.col("doc_id"), 3) == 1
    weights = quality_classifier.train(docs, labels.where(~held))
    assert min(accuracy(quality_classifier.score_quality(docs, weights), labels, "quality", held)) > 0.85
    again = quality_classifier.train(docs.repartition(5), labels.where(~held))
    assert np.allclose(weights, again)


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = remainder(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs, labels.where(~held))
    clean, toxic = accuracy(toxicity.score_toxicity(docs, model), labels, "toxic", held)
    assert clean > 0.98 and toxic > 0.6


def toxic_rows(kind):
    """Texts of 150 words whose toxic ones hold six of 200 marking words (some short), or of 30 pairs of ordinary words."""
    rng = np.random.default_rng(8)
    common = np.array([f"{a}{b}{c}{d}" for a in "bdgklmt" for b in "aeiou" for c in ("n", "rel", "sto") for d in ("", "mi", "da")])
    words = sorted({"".join(rng.choice(list("vwxzaeiou"), rng.integers(2, 9))) for _ in range(260)})[:200]
    marks = words if kind == "words" else [" ".join(rng.choice(common, 2)) for _ in range(30)]
    rows = []
    for i in range(3000):
        toxic = i % 4 == 0
        found = list(rng.choice(marks, 6 if toxic else int(i % 20 == 1)))  # now and then in an ordinary text, too
        text = found + list(rng.choice(common, 150 - len(" ".join(found).split())))
        rng.shuffle(text)
        rows.append((i, " ".join(text), int(toxic)))
    return rows


@pytest.mark.parametrize("kind", ["words", "pairs"])
def test_toxic_texts_of_many_words(spark, kind):
    rows = spark.createDataFrame(toxic_rows(kind), "doc_id long, text string, toxic int")
    held = remainder(F.col("doc_id"), 3) == 1
    model = toxicity.train(rows.select("doc_id", "text"), rows.select("doc_id", "toxic").where(~held))
    clean, toxic = accuracy(toxicity.score_toxicity(rows, model), rows.select("doc_id", "toxic"), "toxic", held)
    assert clean > 0.9 and toxic > (0.7 if kind == "words" else 0.5), (clean, toxic)


def test_classifiers_on_edges(spark, edges, nothing, edges_null_id):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (6, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    none = labels.where("false")
    for learnt in (labels, none):
        weights = quality_classifier.train(edges, learnt)
        model = toxicity.train(edges, learnt)
        for found in (quality_classifier.score_quality(edges, weights), toxicity.score_toxicity(edges, model)):
            rows = found.collect()
            assert len(rows) == edges.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert quality_classifier.score_quality(nothing, weights).count() == 0
        assert toxicity.score_toxicity(nothing, model).count() == 0
        assert toxicity.score_toxicity(edges_null_id, model).count() == edges_null_id.count()


def test_histogram_counts_every_word():
    d = toxicity.Distances(b"the of and " * 30, b"the of and " * 30 + b"rotten ", b"thatwith")
    text = b"the rotten apple " * 200_000  # more than one piece
    assert d.histogram(text).sum() == 600_000
    assert d.histogram(b"").sum() == 0 and d.histogram(b"z" * 1000).sum() == 4


def brute_vectors(rows):
    good = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float))
    links = {i: {j for j in good if j != i and len(good[j]) == len(good[i]) and good[i] @ good[j] >= 0.95} for i in good}
    out = {}
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(links.get(i, ())), min(seen), min(seen) == i)
    return out


def test_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 40] + rng.standard_normal(16) * (0.1 if i % 3 else 0.02)]) for i in range(600)]
    rows += [(1000 + i, rows[7][1]) for i in range(50)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [None] + [1.0] * 15), (2005, [float("inf")] + [1.0] * 15), (2006, [1.0, 2.0]), (2007, [2.0, 4.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, id long, copies long")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in projection_passes.near_duplicates(df).collect()}
    assert got == brute_vectors(rows)
    exp = brute_vectors(rows)
    narrow = projection_passes.near_duplicates(df, window=64, passes=12).collect()  # bounded windows, many passes
    assert sum(r["n_links"] for r in narrow) >= 0.9 * sum(n for n, *_ in exp.values())
    assert all(r["n_links"] <= exp[r["vec_id"]][0] for r in narrow)
    assert projection_passes.near_duplicates(df.where("false")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/x">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy now</div>{body}
<div id="comments"><p>Nice post</p></div><aside>More</aside><form><p>Mail</p></form><footer>&copy; me</footer></body></html>"""


@pytest.mark.parametrize(
    "page, text",
    [
        (PAGE.replace("{body}", "<article><h1>Head</h1><p>One  &amp;\n two</p><p><b>Three<br>four<p>Five</article>"), "Head\n\nOne & two\n\nThree four\n\nFive"),
        (PAGE.replace("{body}", "<main><p>Short.</p><div class='reader-comments'><p>no</p></div></main>"), "Short."),
        (PAGE.replace("{body}", "<div><h1>Head</h1>" + "<p>" + "long words here " * 10 + "</p>" * 2 + "</div>"), "Head\n\n" + ("long words here " * 10).strip()),
        ("<article><p>a&nbsp;b&#8212;c &lt;d&gt;</p><p></p><p> </p></article>", "a b—c <d>"),
        ("", ""),
        ("<nav>only a menu", ""),
        ("plain & short", ""),
    ],
)
def test_main_text(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><h1><a href=x>Title</a></h1><p>text</p><ul>" + "<li><a href=y>Ref</a></li>" * 4 + "</ul><p>more</p><p><a href=z>End</a></p></article>", "Title\n\ntext\n\nRef\n\nRef\n\nRef\n\nRef\n\nmore\n\nEnd"),
        ("<div><h1><a href=x>Title</a></h1><p>" + "long words " * 12 + "</p>" + "<p><a href=y>Ref</a></p>" * 3 + "<p>" + "last words " * 12 + "</p></div>", "Title\n\n" + ("long words " * 12).strip() + "\n\nRef" * 3 + "\n\n" + ("last words " * 12).strip()),
        ("<body><nav>Menu</nav><p>A short page.</p></body>", "A short page."),
    ],
)
def test_linked_and_short_lines_stay(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><h2 id='related-work'>Related</h2><h2 id=legal-aspects>Legal</h2><p id='menu-planning'>Meals</p></article>", "Related\n\nLegal\n\nMeals"),
        ("<article><div class='entry-header'><h1>Head</h1></div><div class='share-bar share'>Share</div><div id=comments>no</div><p>x</p></article>", "Head\n\nx"),
        ("<article><figure><img><figcaption>Seen</figcaption></figure><p>a <math><mi>x</mi></math> b</p></article>", "Seen\n\na x b"),
        ("<article><p>a <svg class='i'/>b</p><p>c</p></article>", "a b\n\nc"),
        ("<article><p>a <object>plain</object></p><noscript><p>shown</p></noscript></article>", "a plain\n\nshown"),
    ],
)
def test_names_in_an_article(page, text):
    assert html_extract.main_text(page) == text


def test_pages_of_a_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = {r["page_id"]: r for r in html_extract.extract_main_text(pages).collect()}
    assert len(rows) == pages.count()
    for r in pages.collect():
        text = rows[r["page_id"]]["text"]
        assert rows[r["page_id"]]["n_chars"] == len(text) and "&copy" not in text and "track(" not in text
        inner = r["html"].split("<article>")[1].split("</article>")[0]
        assert text.split("\n\n")[0] == " ".join(html.unescape(inner.split("<h1>")[1].split("</h1>")[0]).split())
    odd = spark.createDataFrame([(None, None, None, "x"), (1, "u", "", "x"), (1, "u", "<article>" + "<p>x y</p>" * 20000, "x")], "page_id long, url string, html string, text string")
    assert sorted(r["n_chars"] for r in html_extract.extract_main_text(odd).collect()) == [0, 0, 20000 * 5 - 2]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces.read(MODEL)


def best_score(text, vocabulary, byte_score):
    score = {t: s for t, s, _ in vocabulary.pieces}
    best = [0.0] + [-1e18] * len(text)
    for e in range(1, len(text) + 1):
        for b in range(max(0, e - 20), e):
            s = score.get(text[b:e])
            if s is None and e - b == 1:
                s = byte_score * len(text[b:e].encode())
            if s is not None:
                best[e] = max(best[e], best[b] + s)
    return best[-1]


def test_pieces_are_the_best_way(vocabulary, documents):
    encoder = pieces.Encoder(vocabulary)
    score = {i: s for _, s, i in vocabulary.pieces}
    known = set(vocabulary.bytes)
    for row in documents.limit(40).collect():
        text = row["text"][:400]
        ids = encoder.encode(text)
        got = sum(encoder.byte_score if i in known else score[i] for i in ids)
        assert got == pytest.approx(best_score(pieces.MARK + text.replace(" ", pieces.MARK), vocabulary, encoder.byte_score))
        assert encoder.decode(ids) == text
    assert max(len(t) for t, _, _ in vocabulary.pieces) <= 20


def test_pieces_of_a_table(edges, nothing, vocabulary):
    found = pieces.encode_documents(edges, vocabulary)
    rows = found.collect()
    assert len(rows) == edges.count() and all(r["round_trip"] and r["n_pieces"] == len(r["pieces"]) for r in rows)
    back = sorted((r["doc_id"], r["text"]) for r in pieces.decode_documents(found, vocabulary).collect())
    assert back == sorted((r["doc_id"], r["text"] or "") for r in edges.collect())
    assert pieces.encode_documents(nothing, vocabulary).count() == 0
