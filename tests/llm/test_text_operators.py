"""Operators on texts against brute force: toxicity, language, licences, decontamination, secrets, pages."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetdrift.llm import decontaminate, language, licenses, secrets, toxicity, webpages

ODD = [None, "", " ", "\n\n", "a", "été ÀB 漢字 x1", "word " * 3000, "the same row", "the same row"]
SCHEMA = "doc_id long, text string, score string, node string, `start` int"


def odd_docs(spark, texts=ODD):
    return spark.createDataFrame([(i, t, "s", "n", 1) for i, t in enumerate(texts)] + [(None, "no id", "s", "n", 1)], SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


# --- toxicity ---


def test_toxic_words_are_learned_from_positives_and_unlabelled(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 8 == 0
        text = " ".join(rng.choice(words, 40)) + (" vile rotten" if toxic else "")
        rows.append((i, text))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train_toxicity(docs, known)
    scored = toxicity.score_toxicity(docs, model, ["doc_id"]).collect()
    held = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(scored) == 1500 and all(0 <= r.score <= 1 for r in scored)
    assert all(r.predicted == (r.doc_id % 8 == 0) for r in held) and held


def test_held_out_labels_change_no_score(spark):
    docs = spark.createDataFrame([(i, f"a{i % 7} b{i % 11} {'bad' if i % 5 == 0 else ''}") for i in range(400)], "doc_id long, text string")
    labels = [(i, int(i % 5 == 0)) for i in range(400)]
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    models = [toxicity.train_toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped)]
    a, b = (by_id(toxicity.score_toxicity(docs, m, ["doc_id"]), "score") for m in models)
    assert max(abs(a[i][0] - b[i][0]) for i in a) < 1e-6


def test_toxicity_of_odd_and_empty_tables(spark):
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    model = toxicity.train_toxicity(odd_docs(spark), labels)
    assert toxicity.score_toxicity(odd_docs(spark), model, ["doc_id"]).count() == len(ODD) + 1
    none = toxicity.train_toxicity(empty_docs(spark), labels.limit(0))
    assert none == b"" and {r.score for r in toxicity.score_toxicity(odd_docs(spark), none, ["doc_id"]).collect()} == {0.0}
    assert toxicity.score_toxicity(empty_docs(spark), none, ["doc_id"]).count() == 0


def test_corrected_risk_stays_up_when_positives_are_unlabelled_too():
    rows = [np.array([1, 2]) if i % 4 == 0 else np.array([2, 3]) for i in range(400)]
    positive = np.array([i % 8 == 0 for i in range(400)])  # half of the truly toxic texts are confirmed
    weights, bias = toxicity.fit_nnpu(rows, positive, 0.25)
    scores = np.array([weights[r].sum() + bias for r in rows])
    assert scores[::4].min() > scores[1::4].max()


def test_bounded_samples_score_like_the_full_fit(spark, monkeypatch):
    rng = np.random.default_rng(5)
    toxic = rng.random(9000) < 0.11
    # Words that toxic texts use more often, none of them certain: the scores are probabilities between 0 and 1.
    hint = np.where(toxic[:, None], 0.3, 0.08) > rng.random((9000, 8))
    texts = [" ".join([f"w{j}" for j in rng.integers(0, 60, 6)] + [f"hint{j}" for j in np.flatnonzero(h)]) for h in hint]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, y in enumerate(toxic)], "doc_id long, toxic int")

    def scores():
        return np.array([s for (s,) in by_id(toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels), ["doc_id"]), "score").values()])

    full = scores()
    monkeypatch.setattr(toxicity, "POSITIVES", 500)
    monkeypatch.setattr(toxicity, "UNLABELLED", 1500)  # of some 660 and 6,000
    sampled = scores()
    assert full.mean() == pytest.approx(toxic.mean(), abs=0.03)
    assert sampled.mean() == pytest.approx(full.mean(), abs=0.03)


# --- language ---


def test_languages_of_held_out_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names, model = language.train_language(docs)
    found = language.predict_language(docs, names, model).join(docs.select("doc_id", "lang"), "doc_id")
    rows = [r for r in found.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)
    hidden = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    assert language.train_language(hidden)[0] == names


def test_language_of_odd_and_empty_tables(spark):
    docs = odd_docs(spark).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.lit("en")))
    names, model = language.train_language(docs)
    found = by_id(language.predict_language(docs, names, model), "lang_pred", "score")
    assert all(found[i] == ("und", 0.0) for i in range(4)) and found[4][0] == "en"
    assert language.predict_language(docs, [], b"").where("lang_pred <> 'und'").count() == 0
    assert language.train_language(docs.limit(0)) == ([], b"")


def test_temperature_minimises_loss():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(4000, 3)) * 2
    p = np.exp(logits / 3)
    p /= p.sum(1, keepdims=True)
    labels = np.array([rng.choice(3, p=x) for x in p])
    assert language.fit_temperature(logits, labels) == pytest.approx(3, rel=0.1)


# --- licences ---


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [
        (i, label)
        for phrase, label in licenses.PHRASES
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_license_base_places(spark, small):
    texts = ODD + ["MIT License. cc-by CC BY\nApache License", "gnu general public\nlicense é mit license"]
    docs = odd_docs(spark, texts).select("doc_id", "text").unionByName(spark.read.parquet(f"{small}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    text = by_id(docs, "text")
    found = by_id(licenses.scan_licenses(docs, ["doc_id"]), "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert all(found[i] == brute_base(text[i][0]) for i in text)
    assert licenses.scan_licenses(empty_docs(spark), ["doc_id"]).count() == 0


def whole_text(label, *words):
    """A template's text with its optional regions left out and ``words`` in its replaceable ones."""
    template = re.sub(r"\[\[[^\]]*\]\]", "", dict(licenses.TEMPLATES)[label])
    for w in words:
        template = re.sub(r"<<\d+>>", w, template, count=1)
    return template.replace(" software", " Software,")


BSD = ("the copyright holders and contributors", "the copyright holder or contributors")


@pytest.mark.parametrize(
    ("text", "label", "found"),
    [
        (whole_text("MIT", "authors or copyright holders"), "MIT", True),
        (whole_text("MIT", "authors or copyright holders").replace("noninfringement", "infringement"), "MIT", False),
        (whole_text("MIT", "authors or copyright holders").split(" the Software, is provided")[0], "MIT", False),
        (whole_text("ISC", "the author", "the author"), "ISC", True),
        (whole_text("BSD-2-Clause", *BSD), "BSD-2-Clause", True),
        (whole_text("BSD-2-Clause", *BSD), "BSD-3-Clause", False),
        (whole_text("BSD-3-Clause", "the holder", "its", *BSD), "BSD-3-Clause", True),
        (whole_text("BSD-3-Clause", "the holder", "its", *BSD), "BSD-2-Clause", False),
        (whole_text("Zlib", "authors"), "Zlib", True),
        ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0", True),
        ("My big work is licensed under the terms of the GNU General Public License version 3 or later", "GPL-3.0", True),
        ("This work is licensed under a GNU General Public License, version 3.", "GPL-3.0", False),
        ("Licensed under a Creative Commons CC BY-NC 4.0 International License", "CC-BY-NC-4.0", True),
        ("Licensed under CC BY-NC 3.0", "CC-BY-NC-4.0", False),
    ],
)
def test_mandatory_wording_decides(spark, text, label, found):
    docs = spark.createDataFrame([(1, f"x\n{text} y")], "doc_id long, text string")
    assert (label in licenses.scan_licenses(docs, ["doc_id"]).first().labels.split(",")) is found


# --- decontamination ---


def brute_tiles(text, item, seed):
    """Greedy string tiling by its definition: try every pair of places, mark the longest, repeat."""
    in_text, in_item, tiles = set(), set(), []
    while True:
        best = (0, 0, 0)
        for a in range(len(text)):
            for b in range(len(item)):
                n = 0
                while (
                    a + n < len(text) and b + n < len(item) and text[a + n] == item[b + n]
                    and a + n not in in_text and b + n not in in_item
                ):
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < seed:
            return sorted(tiles)
        tiles.append((a, b, n))
        in_text.update(range(a, a + n))
        in_item.update(range(b, b + n))


def test_tiles_equal_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(60):
        text, item = rng.integers(0, 4, 40).tolist(), rng.integers(0, 4, 25).tolist()
        seed = 3
        hits = [(a, b) for a in range(38) for b in range(23) if text[a : a + 3] == item[b : b + 3]]
        if hits:
            found = decontaminate.tile(np.array([h[0] for h in hits]), np.array([h[1] for h in hits]), seed)
            assert sum(t[2] for t in found) == sum(t[2] for t in brute_tiles(text, item, seed))
            assert found == brute_tiles(text, item, seed)


def test_reordered_passages_are_caught_and_clean_texts_left(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    moved = item[10:] + ["and", "then"] + item[:10]
    docs = [
        (0, " ".join(item)), (1, "Before. " + ", ".join(moved) + " after"), (2, " ".join(item[:8])), (3, None), (4, ""),
        (5, " ".join(item[::-1])), (6, " ".join(item)), (6, " ".join(item)), (None, " ".join(item)),
    ]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (7, " ".join(item)), (8, "too short"), (9, None)], "item_id long, text string")
    rows = decontaminate.contaminated(docs, bench).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.item_id, r.coverage) for r in rows if r.doc_id is not None) == [
        (False, 0, 7, 1.0), (False, 1, 7, 1.0), (False, 6, 7, 1.0)
    ]
    assert sum(r.doc_id is None for r in rows) == 1 and {r.reordered for r in rows if r.doc_id == 1} == {True}
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_short_items_are_found_whole(spark):
    docs = spark.createDataFrame(
        [(1, "the answer is forty two of course"), (2, "forty two"), (3, "forty, TWO!"), (4, "forty and two"), (5, "yes"), (6, None)], "doc_id long, text string"
    )
    bench = spark.createDataFrame([(10, "Forty two"), (11, "yes"), (12, ""), (13, None), (14, "is forty two of")], "item_id long, text string")
    rows = decontaminate.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(1, 10), (2, 10), (3, 10), (5, 11), (1, 14)}
    assert all(r.coverage == 1 and r.n_tiles == 1 for r in rows)


def test_tiles_of_repetitive_texts():
    """Two words in a long text and a long item: every place matches many others."""
    text, item = (np.random.default_rng(3).integers(0, 2, n).tolist() for n in (2000, 300))
    places = [(a, b) for a in range(len(text) - 4) for b in range(len(item) - 4) if text[a : a + 5] == item[b : b + 5]]
    found = decontaminate.tile(np.array([x[0] for x in places]), np.array([x[1] for x in places]), 5)
    assert all(text[t : t + n] == item[i : i + n] and n >= 5 for t, i, n in found)
    assert len({t + k for t, _, n in found for k in range(n)}) == sum(n for _, _, n in found)
    assert decontaminate.tile(np.zeros(0, int), np.zeros(0, int), 5) == []


def test_decontamination_equals_brute_force_with_and_without_the_filter(spark, small, monkeypatch):
    docs, bench = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("documents", "benchmark"))
    split = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    items = {r.item_id: split(r.text) for r in bench.collect()}
    expected = set()
    for r in docs.collect():
        text = split(r.text)
        seeds = {tuple(text[i : i + 5]) for i in range(len(text) - 4)}
        for i, item in items.items():
            if any(tuple(item[k : k + 5]) in seeds for k in range(len(item) - 4)):
                if sum(t[2] for t in brute_tiles(text, item, 5)) >= decontaminate.COVERAGE * len(item):
                    expected.add((r.doc_id, i))
    run = lambda: {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert run() == expected and expected
    monkeypatch.setattr(decontaminate, "MOST_SENT", 0)
    assert run() == expected


# --- secrets ---


def test_weak_parts_need_their_complement(spark):
    key = "Ab3" + "xY9" * 7
    texts = [
        f"login: anna then {key}", f"just {key}", "login: anna only", f"https://host.example.org/x {key}",
        "https://host.example.org/x", "password=abcdefgh9", f"login=anna{' ' * 300}{key}", None, "", "token=short",
    ]
    rows = by_id(secrets.scan_secrets(odd_docs(spark, texts)), "spans", "n_assign")
    kinds = {i: re.sub(r":\d+:\d+", "", rows[i][0]) for i in range(len(texts))}
    assert kinds == {0: "identifier,key", 1: "", 2: "", 3: "endpoint,key", 4: "", 5: "assign", 6: "", 7: "", 8: "", 9: ""}
    assert secrets.scan_secrets(empty_docs(spark)).count() == 0


def test_redaction_leaves_no_strong_part(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(50)
    token = F.concat(F.lit('token = "'), F.sha2(F.col("text"), 256), F.lit('" AKIA'), F.upper(F.substring(F.md5("text"), 1, 16)))
    docs = docs.withColumn("text", F.concat("text", F.lit(" "), token, F.lit(" "), "text"))
    clean = secrets.redact_secrets(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    found = F.sum(F.col("n_assign") + F.col("n_access") + F.col("n_hex"))
    assert secrets.scan_secrets(clean).agg(found).first()[0] == 0 and secrets.scan_secrets(docs).agg(found).first()[0] > 0
    odd = secrets.redact_secrets(odd_docs(spark, ["é password=abcdefgh9 é", None, "password=secret=abcdefgh password=abcdefgh"]))
    assert by_id(odd, "text")[0] == ("é [REDACTED] é",) and by_id(odd, "text")[1] == (None,)


def test_secret_plan_has_no_python(spark, small):
    plan = secrets.scan_secrets(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


# --- pages ---


def page(host, i, body):
    return (i, f"https://{host}/{i}", body)


def test_recurring_subtrees_go_and_article_paragraphs_stay(spark):
    widget = "<div><p>Win a prize</p><p>today</p></div>"
    rows = [page("a.org", i, f"<body>{widget}<div><p>Story {i} &amp; more</p><p>shared passage</p></div>") for i in range(6)]
    rows += [page("b.org", i, f"<body><article><h1>T{i}</h1>{widget}<p>shared passage</p></article>") for i in range(10, 16)]
    rows += [page("c.org", 20, f"<body>{widget}<p>alone</p>"), (30, None, "<p>x"), (31, "not a url", None), (32, "https://d.org", "")]
    found = {r.page_id: r.text for r in webpages.extract_texts(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id", "url"]).collect()}
    assert "Win" not in found[0] and found[0].startswith("Story 0 & more")
    assert found[10] == "T10 shared passage" and found[20] == "Win a prize today alone"
    assert found[30] == "x" and found[31] == "" and found[32] == ""


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<nav>m</nav><article><p>a  b\n c<p>d&lt;e&#233;<br>f</article><footer>z", "a b c d<eé f"),
        ("<article>x<aside>no</aside>y<script>if(a<b)</script></article>", "x y"),
        ("<main><p class='ad'>no</p><p id=comments>no</p><p>yes</p></main>", "yes"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a b c d"),
        ("t<b>e</b>x<!-- no -->t <a href='>'>link</a> <p unfinished", "text link"),
        ("<article>one</article><article class=comment>two</article>", "one"),
    ],
)
def test_blocks_and_roles(html, text):
    assert webpages.Page(html).text() == text


def test_pages_of_the_small_table(spark, small):
    """Plain reading of the article between its tags gives the same text."""
    import html

    rows = webpages.extract_texts(spark.read.parquet(f"{small}/pages.parquet"), ["page_id", "html"]).collect()
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [html.unescape(re.sub(r"<[^>]+>", "", x)).split() for x in re.split(r"</?(?:p|h\d|br|li|ul)\b[^>]*>", body)]
        assert r.text == " ".join(" ".join(b) for b in blocks if b) and r.n_chars == len(r.text)


def test_templates_decide_without_article_elements(spark):
    """A rotating box on a twentieth of a large host's pages, without any telling name, goes; shared passages stay."""
    shared = "A passage that very many pages of this host quote word for word."
    rows = []
    for i in range(1200):
        box = f"<div><ul><li>Box {i % 20}</li><li>of the site</li></ul></div>"
        quote = f"<p>{shared}</p>" if i % 3 == 0 else ""
        rows.append((i, "http://big.example/x", f"<body>{box}<div><p>Own text number {i}.</p>{quote}</div></body>"))
    found = {r.page_id: r.text for r in webpages.extract_texts(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()}
    assert found == {i: f"Own text number {i}." + (f" {shared}" if i % 3 == 0 else "") for i in range(1200)}


def test_class_words_within_an_article():
    article = (
        "<article><div class='share-price'>A</div><h2 class='section-header'>B</h2><p id='notice-of-appeal'>C</p>"
        "<section class='social-history'>D</section><div class='ad-slot'>X</div><div class='comments'>Y</div></article>"
    )
    assert webpages.Page(article).text() == "A B C D"
    assert webpages.Page("<p><a href=it's title=\"a>b\">link</a> text</p>").text() == "link text"
    body = "Long text of the page. " * 20
    assert webpages.Page(f"<div><p>{body}</p></div><article>teaser</article>").text() == f"{body.strip()} teaser"


def test_deep_and_broken_pages_take_linear_time():
    import time

    start = time.perf_counter()
    assert webpages.Page("<div>" * 50000 + "x" + "</div>" * 50000).text() == "x"
    webpages.Page("<a " * 20000)
    webpages.Page('<a b="' * 20000)
    webpages.Page("<i>" * 20000 + "</b>" * 50000)
    assert time.perf_counter() - start < 5


def test_pages_of_nothing(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert webpages.extract_texts(empty, ["page_id", "url"]).count() == 0
