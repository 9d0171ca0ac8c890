"""Operators 4, 6, 9, 10 and the pipeline."""

import random
import zlib

import brute
import numpy as np
import pytest
import sentencepiece
import xxhash

import corpus_pipeline
from tidewater.llm import html, language, pieces, quality, secrets
from tidewater.llm.common import documents, table

ODD = [(1, None), (2, ""), (3, "12 34 !!"), (3, "12 34 !!"), (None, "the and of"), (4, "漢字 ☃ ▁ é\x00\n" * 3000), (5, "a" * 40000), (6, "日本語" * 12000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(a, b, "en", "x", "y") for a, b in ODD], "doc_id bigint, text string, lang string, h string, key string")


@pytest.fixture(scope="module")
def sf_small():
    return "/root/testdata/sf0.01"


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_language_accuracy(spark, sf_small):
    truth = {r.doc_id: r.lang for r in table(spark, sf_small, "documents").collect()}
    r = language.op4_language(spark, sf_small).collect()
    assert sorted(x.doc_id for x in r) == sorted(truth)
    assert all(x.held_out == (fold(x.doc_id, 3) == 1) and 0 <= x.score <= 1 for x in r)
    held = [x for x in r if x.held_out]
    assert sum(x.lang_pred == truth[x.doc_id] for x in held) > 0.98 * len(held)


def test_language_sample_is_the_smallest_hashes(spark, sf_small, monkeypatch):
    monkeypatch.setattr(language, "TRAIN_DOCS", 7)
    monkeypatch.setattr(language, "learn", lambda samples, most: samples)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        docs = table(spark, sf_small, "documents").select("doc_id", "text", "lang")
        got = language.fit(docs.unionByName(docs))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want: dict[str, dict[int, str]] = {}
    for r in docs.collect():
        if fold(r.doc_id, 3) != 1 and r.lang is not None and any(map(str.isalpha, r.text or "")):
            want.setdefault(r.lang, {})[np.uint64(xxhash.xxh64_intdigest(r.text.encode(), 42)).astype(np.int64)] = r.text
    for lang, texts in want.items():
        rows, n = [], 0
        for h in sorted(texts)[:7]:
            if n < language.TRAIN_CHARS:
                rows.append(texts[h])
                n += len(texts[h])
        assert got[lang] == rows
    assert got.keys() == want.keys()


def test_suffix_automaton():
    rng = random.Random(0)
    seq = [rng.randrange(2, 5) for _ in range(300)]
    t = language.suffix_automaton(seq, 6)
    subs = {tuple(seq[i:j]) for i in range(300) for j in range(i + 1, min(300, i + 6) + 1)}
    for _ in range(2000):
        w = [rng.randrange(2, 6) for _ in range(rng.randrange(1, 6))]
        s = 1
        for c in w:
            s = t[s, c] if s else 0
        assert (s > 0) == (tuple(w) in subs)


def test_cross_parsing_counts_phrases():
    m = language.learn({"a": ["abcabc"], "b": ["cbacba"]})
    p, n = language.phrases(m, ["abc", "abcab cba", "", "zz"])
    assert n.tolist() == [3, 9, 0, 2] and p[0].tolist() == [1, 3] and p[3].tolist() == [2, 2]


def test_language_odd(spark, odd):
    r = language.identified(odd, language.fit(odd)).collect()
    assert len(r) == len(ODD) and all(x.lang_pred == "und" and x.score == 0 for x in r if x.doc_id in (1, 2, 3))
    assert language.identified(odd.limit(0), language.fit(odd.limit(0))).count() == 0
    assert {x.lang_pred for x in language.identified(odd, language.fit(odd.limit(0))).collect()} == {"und"}


def test_quality_accuracy(spark, sf_small):
    q = {r.doc_id: r.quality for r in table(spark, sf_small, "labels").collect()}
    r = quality.op10_quality(spark, sf_small).collect()
    assert len(r) == documents(spark, sf_small).count()
    assert all(x.held_out == (fold(x.doc_id, 4) == 2) and 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in r)
    held = [x for x in r if x.held_out and x.doc_id in q]
    assert sum(x.predicted == q[x.doc_id] for x in held) > 0.93 * len(held)


def test_machine_equals_pairs():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, quality.RANK)))
    idx, val = [3, 50, 900], [0.5, 2.0, -1.0]
    want = 0.3 + sum(m.w[i] * x for i, x in zip(idx, val)) + sum(m.v[idx[a]] @ m.v[idx[b]] * val[a] * val[b] for a in range(3) for b in range(a))
    assert quality.margins(m, np.array(idx), np.array(val), np.array([0]))[0] == pytest.approx(want)


def test_quality_odd(spark, odd):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    m = quality.fit(odd, none)
    r = quality.scored(odd, m).collect()
    assert len(r) == len(ODD) and all(x.score == 0.5 for x in r)
    some = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 0), (4, None), (None, 1)], "doc_id bigint, quality int")
    assert quality.scored(odd, quality.fit(odd, some)).count() == len(ODD)
    assert quality.keep_good(odd, m).count() == 0 and quality.keep_good(odd.limit(0), m).columns == odd.columns


PAGE = """<html><body class="page-header x"><header>H</header><div class="cookie-notice">We use</div><article class="post"><h1>T &amp; t</h1><p>One  two<br>three
<a href=x>link</a> b&#233;.<div class="share">s</div><ul class="comments"><li>c</li></ul><script>if(a<b){}</script><!-- x --><p>Four<section id="comments"><p>bad</section>
<aside>z</aside><p>1 < 2 &lt;b&gt;</article><div id=sidebar>S</div><form><p>f</form><footer>F</footer>"""


def test_page():
    assert html.extract(PAGE, {}) == "T & t\nOne two three link bé.\nFour\n1 < 2 <b>"
    assert html.extract("<div><ul><li><a>m1</a><li><a>m2</a></ul><p>Main <b>bold</b>.</p><pre>a\n b</pre><table><tr><td>x<td>y</table></div>", {}) == "Main bold.\na b\nx\ny"
    assert [html.extract(x, {}) for x in (None, "", "<script>x", "<p", "a & b", "<a title=\"x")] == ["", "", "", "", "a & b", ""]


def test_alignment():
    e = html.expression
    assert html.align(e(("p", "p", "ul")), e(("p", "div", "ul"))) == [["p", False, True], ["div", True, False], ["ul", False, False]]
    assert html.align(e(()), e(("p",))) == [["p", True, False]]


def test_template_text_and_hosts(spark):
    page = lambda i: f"<body><div><p>Follow us for more</p></div><div><h2>Title {i}</h2><p>Body {i} of the page.</p></div></body>"
    rows = [(i, "https://u@A.example:80/x", page(i), "h") for i in range(8)] + [(90, None, "<p>alone</p>", "h"), (91, "no url", None, "h"), (90, None, "<p>alone</p>", "h")]
    r = html.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string, host string")).collect()
    assert {x.text for x in r if x.page_id < 90} == {f"Title {i}\nBody {i} of the page." for i in range(8)}
    assert sorted(x.text for x in r if x.page_id >= 90) == ["", "alone", "alone"] and all(x.n_chars == len(x.text) for x in r)


def test_pages_of_the_table(spark, sf):
    import re
    from html import unescape

    pages = {r.page_id: r.html for r in table(spark, sf, "pages").collect()}

    def plain(h):
        a = h[h.index("<article>") :].partition("</article>")[0]
        a = unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?(p|h1)>", "\n", a)))
        return "\n".join(x for x in (re.sub(r"\s+", " ", t).strip() for t in a.split("\n")) if x)

    r = html.op6_html(spark, sf).collect()
    assert {x.page_id: x.text for x in r} == {k: plain(h) for k, h in pages.items()}


def library():
    return sentencepiece.SentencePieceProcessor(model_proto=pieces.model_bytes())


def ids(packed):
    return np.frombuffer(packed, dtype=np.int32).tolist()


def test_scan_equals_the_library():
    p, sp = pieces.Pieces(pieces.model_bytes()), library()
    rng = random.Random(1)
    for k in range(150):
        s = "".join(rng.choice("abcdeé漢 \ntiontheing" if k % 3 else "tionhe" if k % 2 else " a") for _ in range(rng.randrange(1, 400)))
        parts = pieces.chunks(" " + s, p.width, 40)
        mats = [p.matrix(*x) for x in parts]
        states = pieces.boundary_states(mats)
        got = b"".join(p.trace(*x, i, j) for x, (i, j) in zip(parts, states, strict=True))
        assert ids(got) == sp.encode(s) == ids(p.encode(s)) and p.decode(ids(got)) == s
        if len(mats) > 2:
            a = pieces.plus(pieces.plus(mats[0], mats[1]), mats[2])
            assert (a == pieces.plus(mats[0], pieces.plus(mats[1], mats[2]))).all()
            assert pieces.boundary_states([pieces.product(mats[:2]), *mats[2:]])[1:] == states[2:]
        assert (pieces.product(mats) == 0).sum() == 1  # one path alone


def test_stretches_equal_the_library():
    p, sp = pieces.Pieces(pieces.model_bytes()), library()
    rng = random.Random(2)
    words = list({" " + " " * rng.randrange(4) + "".join(rng.choice("abthiecnogré漢☃") for _ in range(rng.randrange(1, 30))) for _ in range(500)} | {"\n", "  ", "   "})
    for w, got in zip(words, p.solve_many(words), strict=True):
        assert got == p.solve(w) and (ids(got) == sp.encode(w[1:]) if w[0] == " " else ids(got) == sp.encode(w)[1:])


def test_neighbours_that_fit_make_the_encoding():
    p, sp = pieces.Pieces(pieces.model_bytes()), library()
    rng = random.Random(3)
    for _ in range(300):
        s = " " + "".join(rng.choice("aeinorst") for _ in range(rng.randrange(1, 12)))
        paths = [()]  # every path whose neighbours fit, in the plainest way
        out = []
        while paths:
            path = paths.pop()
            at = sum(map(len, path))
            if at == len(s):
                out.append(path)
            for e in p.ends(s, at) if at < len(s) else ():
                if p.fits(path[-1] if path else "", s[at:e]):
                    paths.append((*path, s[at:e]))
        assert [[p.pieces[x][0] for x in path] for path in out] == [sp.encode(s[1:])]


def test_every_text_of_the_table_has_the_ids_of_the_library(spark, sf_small):
    docs = documents(spark, sf_small).collect()
    want = {(r.doc_id, tuple(i)) for r, i in zip(docs, library().encode([r.text or "" for r in docs]), strict=True)}
    r = pieces.op9_pieces(spark, sf_small).collect()
    assert {(x.doc_id, tuple(x.ids)) for x in r} == want and all(x.round_trip for x in r)


def test_pieces_odd_and_giant(spark, odd):
    m = pieces.model_bytes()
    e = pieces.encoded(odd, m)
    r = e.collect()
    assert len(r) == len(ODD) and all(x.round_trip for x in r) and all(len(x.ids) == x.n_tokens for x in r)
    assert sorted((str(x.doc_id), x.text) for x in pieces.decoded(e, m).collect()) == sorted((str(a), b or "") for a, b in ODD)
    text = "the tion " * 6000
    one = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert pieces.encoded(one, m).first().ids == pieces.encoded(one, m, giant=1 << 30).first().ids == library().encode(text)
    assert pieces.encoded(one, m, fan=3, size=64).first().ids == library().encode(text)  # matrices combined on several levels
    assert pieces.encoded(odd.limit(0), m).count() == 0


def test_pipeline(spark, sf, tmp_path):
    docs, kept = table(spark, sf, "documents"), []
    names = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert docs.columns == names
        kept.append(docs.collect())
    machine = quality.fit(table(spark, sf, "documents"), table(spark, sf, "labels"))
    first = [r for r in table(spark, sf, "documents").collect() if quality.score(machine, [quality.features(r.text, {})])[0] >= 0.7]
    assert sorted(first) == sorted(kept[0])
    comp = brute.simhash_rows([(r.doc_id, r.text) for r in first])
    second = [r for r, (d, _, c) in zip(first, comp, strict=True) if d == c]
    assert sorted(second) == sorted(kept[1])
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    third = [r for r, x in zip(second, brute.contamination([(r.doc_id, r.text) for r in second], items), strict=True) if not x[5]]
    assert sorted(third) == sorted(kept[2])
    auto = secrets.automaton()
    fourth = {r.doc_id: secrets.mask(r.text, secrets.scan(r.text, auto)) for r in third}
    assert fourth == {r.doc_id: r.text for r in kept[3]} and all(r.n_chars == len(r.text) for r in kept[3])
    assert {r.doc_id for r in kept[4]} == set(fourth) and all(r.round_trip for r in kept[4])
    assert corpus_pipeline.run(spark, sf).count() == len(kept[4])
