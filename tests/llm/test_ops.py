"""The pipeline operators: brute force, exact round trips, and the odd inputs each has to stand."""

import hashlib
import html
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.llm import bpe, chat, jaccard, langid, licenses, media, mixing, packing, queries, sitetree, sketch, tokens
from attestry.llm.bpe import tokenizer_path
from attestry.llm.common import only, without

DOC = "doc_id long, text string, lang string, source string, n_tokens long, feature string, sign string, length long"
ODD = [(1, None), (2, ""), (3, "a"), (3, "a"), (4, "One two three four five six."), (5, "One two three four five six."), (None, "no id"), (6, "  \n\t "), (7, "日本語 テキスト é É"), (8, "word " * 30_000)]


def odd_docs(spark, rows=ODD):
    """Null and repeated ids, null, empty and very long texts, and columns named like the results'."""
    return spark.createDataFrame([(i, t, "en" if t else None, None if i == 4 else "src1", 9, "x", "y", 5) for i, t in rows], DOC)


def collect(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_sql(spark, sf, same, name):
    same(queries.QUERIES[name](spark, sf), queries.ORACLES[name])


# --- media ----------------------------------------------------------------------------------------------


def test_media_round_trip(spark):
    rows = collect(media.read_media(media.store_media(odd_docs(spark))), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "feature")
    want = []
    for i, t in ODD:
        data = (t or "").encode()
        pay = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        want.append((i, len(data), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:])))
    assert sorted(map(str, (r[:5] for r in rows))) == sorted(map(str, want))
    by_text = {r[3]: {x[5] for x in rows if x[3] == r[3]} for r in rows}
    assert all(len(f) == 1 for f in by_text.values())


@pytest.mark.parametrize("kind", range(5))
def test_all_row_filters(kind):
    rng = np.random.default_rng(kind)
    image = rng.integers(0, 256, (9, 64), dtype=np.uint8)
    rows = np.zeros_like(image)
    for y in range(9):
        for x in range(64):
            a = int(image[y, x - 1]) if x else 0
            b = int(image[y - 1, x]) if y else 0
            c = int(image[y - 1, x - 1]) if x and y else 0
            paeth = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            rows[y, x] = (int(image[y, x]) - [0, a, b, (a + b) // 2, paeth][kind]) % 256
    assert (media.unfiltered(np.full(9, kind, np.uint8), rows) == image).all()


def test_damaged_media_is_refused():
    good = media.write_png(media.padded(b"hello"))
    assert media.read_png(good).tobytes() == media.padded(b"hello")
    for at in range(8, len(good)):
        with pytest.raises(ValueError):
            media.read_png(good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :])


def test_feature_is_a_low_frequency_cosine_hash():
    rng = np.random.default_rng(5)
    for size in (1, 64, 200, 64 * 31, 64 * 32, 64 * 100 + 7):
        image = media.read_png(media.write_png(media.padded(rng.integers(32, 127, size, dtype=np.uint8).tobytes())))
        h = len(image)
        small = np.zeros((32, 32))
        for y in range(32):
            rows = [y * h // 32] if h < 32 else range(y * h // 32, (y + 1) * h // 32)
            for x in range(32):
                small[y, x] = np.mean([image[r, c] for r in rows for c in (2 * x, 2 * x + 1)])
        low = []
        for u in range(8):
            for v in range(8):
                low.append(round(sum(small[y, x] * np.cos(np.pi * (2 * y + 1) * u / 64) * np.cos(np.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32)), 6))
        bits = "".join("1" if c > np.median(low[1:]) else "0" for c in low)
        assert media.cosine_hashes([image]) == [f"{int(bits, 2):016x}"]


# --- tokens ---------------------------------------------------------------------------------------------

TEXTS = ["", "  a  b\n\n c", "don't I'll  x\t\ty <|endoftext|> z", "日本語 テキスト ok", "a\xa0b c  d", "é é É ÀÉ'S", "x" * 300 + " y", "12345 1,2\n", " lead", "trail \n", "\x1c \x85q", "a\r\n b", "ſ ª² ΣΑΣ", "<|startoftext|>x", "<|endo ftext|>"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_library(name):
    encoder = bpe.load(tokenizer_path(name))
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab cdé \n\t'.,1<|>") for _ in range(rng.randrange(60))) for _ in range(400)]
    found = encoder.encode([t.encode() for t in texts])
    ends = np.cumsum(found.counts())
    got = [found.flat()[e - n : e].tolist() for e, n in zip(ends, found.counts())]
    assert got == [e.ids for e in encoder.library.encode_batch(texts, add_special_tokens=False)]


def test_overlaps_resynchronise():
    encoder = bpe.load(tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(2)
    words = ["alpha", "be", "l'été", "naïve", "x" * 90, "日本語", "<|endoftext|>", "\n\n", "12,5"]
    for _ in range(60):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(200)))
        want = len(encoder.library.encode(text, add_special_tokens=False).ids)
        assert tokens.counts(encoder, [text.encode()], huge=10, chunk=64, overlap=14)[0] == want
    for solid in ("ab" * 500, " " * 700, "的一是不了" * 90, "的一，是不了" * 90, "x<|endoftext|>y" * 40):  # few edges, or none: chunks become one
        assert tokens.counts(encoder, [solid.encode()], huge=10, chunk=64, overlap=14)[0] == len(encoder.library.encode(solid).ids)


def test_chunks_cost_no_more_than_the_text():
    encoder = bpe.load(tokenizer_path("byte_bpe_50k.json"))
    read = []

    class Library:
        def encode(self, text, **options):
            read.append(len(text))
            return encoder.library.encode(text, **options)

    for text in ("的一是不了人我在有他" * 30_000, "的一是不了人，我在有他" * 20_000, "some words, " * 20_000):
        read.clear()
        assert tokens.splice(Library(), text) == len(encoder.library.encode(text).ids)
        assert sum(read) <= 3 * len(text)


def test_counts_of_odd_rows(spark):
    library = bpe.load(tokenizer_path("byte_bpe_50k.json")).library
    got = collect(tokens.count_tokens(odd_docs(spark), tokenizer_path("byte_bpe_50k.json")), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = []
    for i, t in ODD:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    assert sorted(map(str, got)) == sorted(map(str, want))


# --- language -------------------------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    pieces = langid.Pieces.of(["a", "ab", "abc", "b", "bc", "c", "▁", "▁a"])
    p = np.array([0.1, 0.2, 0.05, 0.1, 0.15, 0.1, 0.2, 0.1, langid.UNKNOWN, 0.0])
    where = {n: k for k, n in enumerate(pieces.names)}

    def walk(word):
        if not word:
            return 1.0
        return sum(walk(word[k:]) * (p[where[word[:k]]] if word[:k] in where else langid.UNKNOWN if k == 1 else 0) for k in range(1, min(langid.LONGEST, len(word)) + 1))

    words = ["▁abc", "▁", "▁xabcab", "abcabcabc"]
    size, number = pieces.tables(words)
    alpha = langid.forward(size, number, p)
    assert np.allclose(alpha[size, np.arange(len(words))], [walk(w) for w in words], rtol=1e-12)


def test_no_piece_and_no_cut_of_a_word_is_left_out(monkeypatch):
    names = langid.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    assert len(names) == 22240 and max(map(len, names)) == 16
    word = "ab" * 40 + max(names, key=len).strip("▁") + "b" * 30
    assert langid.letters(word) == ["▁" + word]
    pieces = langid.Pieces.of(names)
    rng = np.random.default_rng(0)
    p = np.concatenate([rng.random((len(names), 2)) / len(names), [[langid.UNKNOWN] * 2, [0, 0]]])
    where = {n: k for k, n in enumerate(names)}
    words = ["▁" + word, "▁" + word[7:60], "▁international", "▁" + word[:33], "▁" + word[:32]]

    def brute(w, q):
        sums = [1.0]
        for i in range(1, len(w) + 1):
            sums.append(sum(sums[j] * (q[where[w[j:i]]] if w[j:i] in where else langid.UNKNOWN if i - j == 1 else 0) * 1e2 ** (i - j) for j in range(max(0, i - 16), i)))
        return np.log(sums[-1]) - len(w) * np.log(1e2)

    monkeypatch.setattr(langid, "STEP", 20)
    got = langid.Model(["x", "y"], pieces, p).scores([[w] for w in words])
    assert np.allclose(got, [[brute(w, p[:, c]) for c in (0, 1)] for w in words], rtol=1e-9)


def test_long_words_are_fitted_as_short_ones(monkeypatch):
    pieces = langid.Pieces.of(["a", "ab", "abc", "b", "bc", "c", "▁", "▁a"])
    counts = {"▁abcab": 3, "▁a": 2, "▁xbc": 1, "▁abcabcabc": 5}
    want = langid.fit(counts, pieces)
    monkeypatch.setattr(langid, "PART", 4)
    assert np.allclose(langid.fit(counts, pieces), want, rtol=1e-9)


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = queries.op2_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and held
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_copies_do_not_fill_the_sample(spark):
    rows = [(k, "the same words again" if k % 4 else f"other words {k}", "en", "s", 0, "", "", 0) for k in range(4000)]
    docs = spark.createDataFrame(rows, DOC)
    model = langid.train(docs, tokenizer_path("piece_bpe_32k.model"), rows=100)
    assert model.langs == ["en"]
    where = {n: k for k, n in enumerate(model.pieces.names)}
    # one text in a thousand: the copies' words stay rare
    assert model.p[where["▁other"], 0] > 20 * model.p[where["▁again"], 0]


def test_language_of_odd_rows(spark):
    docs = odd_docs(spark)
    model = langid.train(docs, tokenizer_path("piece_bpe_32k.model"))
    got = collect(langid.predict(docs, model), "doc_id", "lang_pred", "score")
    assert len(got) == len(ODD)
    assert {r[1:] for r in got if r[0] in (1, 2, 6)} == {("und", 0.0)}
    nobody = langid.train(docs.limit(0), tokenizer_path("piece_bpe_32k.model"))
    assert {r[1] for r in collect(langid.predict(docs, nobody), "doc_id", "lang_pred")} == {"und"}
    assert langid.told(docs, model, 0.5).columns == docs.columns
    assert langid.told(docs, model, 0.5).count() == len([1 for _, t in ODD if t and any(c.isalpha() for c in t)])


# --- fingerprints ---------------------------------------------------------------------------------------


def edited(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        yield i, t, t[: len(t) - cut] + after[:cut], after


def test_successors_and_edits(spark):
    rows = [(k * 7 % 101, f"text number {k} " * (k % 9)) for k in range(101)]
    got = {r.doc_id: r for r in sketch.successor_fingerprints(odd_docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t, e, after in edited(rows):
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        marks = [sketch.sketch(sketch.points_of(x)) for x in (t, e, after)]
        assert r.fingerprint == sketch.text_of(marks[0]) and r.edited_fingerprint == sketch.text_of(marks[1])
        assert (r.near_edited, r.near_next) == (sketch.likeness(marks[0], marks[1]), sketch.likeness(marks[0], marks[2]))


def test_fingerprints_of_odd_rows(spark):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_chars, r.edited_sha256) for r in sketch.successor_fingerprints(odd_docs(spark)).collect())
    rows = sorted(((-1 if i is None else i, t or "") for i, t in ODD), key=lambda r: (-r[0], r[1]))
    assert got == sorted((i, len(t), hashlib.sha256(e.encode()).hexdigest()) for (i, t), (_, _, e, _) in zip(rows, edited(rows)))
    assert sketch.successor_fingerprints(odd_docs(spark, [(1, "x")])).count() == 1
    assert sketch.successor_fingerprints(odd_docs(spark).limit(0)).count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(0)
    a, b = rng.integers(97, 123, 40_000).astype(np.uint32), rng.integers(97, 123, 300).astype(np.uint32)
    whole = np.concatenate([a, b])
    both = sketch.merge(sketch.sketch(a), sketch.sketch(b))
    joint = np.union1d(sketch.shingle_hashes(a), sketch.shingle_hashes(b))
    assert (both == joint[joint < sketch.LIMIT]).all()
    inside, _ = sketch.containment(sketch.sketch(b), sketch.sketch(whole))
    assert inside > 0.9  # a short text within a very long one
    assert len(sketch.sketch(sketch.points_of("x"))) == 1 and not len(sketch.sketch(sketch.points_of("")))
    assert sketch.likeness(sketch.sketch(a), sketch.sketch(b)) < 0.1


# --- mixing ---------------------------------------------------------------------------------------------


def waterfill(budget, children):
    """children: (name, cap, weight): level by level, what a full child leaves goes to its siblings."""
    share, open_ = {}, list(children)
    while open_:
        level = budget / sum(w for *_, w in open_)
        full = [(n, c, w) for n, c, w in open_ if c <= w * level + 1e-9]
        if not full:
            return share | {n: w * level for n, c, w in open_}
        for n, c, _ in full:
            share[n] = c
            budget -= c
        open_ = [x for x in open_ if x not in full]
    return share


def test_shortages_stay_among_siblings(spark):
    rows = [(i, "w " * n, lang, src, 0, "", "", 0) for i, (n, lang, src) in enumerate([(50, "en", "src0")] * 20 + [(5, "de", "src0")] * 3 + [(40, "en", "src1")] * 10 + [(30, "fr", "src4")] * 10)]
    docs = spark.createDataFrame(rows, DOC)
    slim = mixing.leaf_columns(docs)
    got = {(r.domain, r.lang, r.source): r.quota for r in mixing.leaf_budgets(slim, mixing.WEIGHTS, 0.5, 1).collect()}
    caps = {("domain0", "en", "src0"): 1000, ("domain0", "de", "src0"): 15, ("domain1", "en", "src1"): 400, ("domain0", "fr", "src4"): 300}
    total = sum(caps.values()) * 0.5
    top = waterfill(total, [(d, sum(v for k, v in caps.items() if k[0] == d), mixing.WEIGHTS["domain"][d]) for d in ("domain0", "domain1")])
    for d in top:
        langs = waterfill(top[d], [(k[1], v, mixing.WEIGHTS["lang"][k[1]]) for k, v in caps.items() if k[0] == d])
        for k in caps:
            if k[0] == d:
                assert abs(got[k] - langs[k[1]]) <= 1


def test_mix_of_odd_rows(spark):
    docs = odd_docs(spark)
    got = mixing.mix(docs, share=0.5, epochs=1)
    held = {(r.lang, r.source): r.tokens for r in mixing.leaf_columns(docs).groupBy("lang", "source").agg(F.sum("tokens").alias("tokens")).collect()}
    assert {("unknown", "src1"), ("en", "unknown")} <= set(held)
    assert 0 < sum(r.tokens for r in got.collect()) <= 0.5 * sum(held.values()) + 1
    one = mixing.mix(docs, share=2.0, epochs=1, domain=lambda source: F.lit("all"))
    assert {r.domain for r in one.collect()} == {"all"} and one.count() == len(ODD)
    assert mixing.mix(docs.limit(0)).count() == 0
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    everything = mixing.mixed_documents(docs, share=2.0, epochs=2)
    assert everything.count() == 2 * len(ODD)


# --- pages ----------------------------------------------------------------------------------------------


def test_main_text_of_articles(spark, sf):
    rows = queries.op6_main_text(spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect()
    assert rows
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:h1|p)>", body))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_furniture_goes():
    page = (
        "<html><head><title>T</title></head><body><header>Site</header><nav>x<ul><li>a</ul></nav><div class='cookie-notice'>We use</div>"
        "<article class='post'><header><h1>T &amp; x</h1></header><p>One <b>bold <i>it</b></i>\n two<p>Next<span class='ad'>buy</span> on"
        "<ul><li>l1<li>l2</ul><form>q</form><div id='comments'><p>nice</p></div></article><aside>s</aside><footer>f</footer><script>var a='<p>';</script>"
    )
    assert sitetree.main_text(page, set(), set()) == "T & x\nOne bold it two\nNext on\nl1\nl2"
    assert sitetree.main_text("", set(), set()) == ""
    assert sitetree.main_text("<p>plain <", set(), set()).startswith("plain")


def test_repeated_template_goes(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div class='box'><p>Same words everywhere</p></div><div class='text'><p>Own text number {i} {'z' * i}</p></div></body>") for i in range(30)]
    rows += [(100, None, "<p>no host</p>"), (101, "http://x.example/", None), (100, None, "<p>no host</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("paths", F.lit("clash"))
    got = collect(sitetree.extract_main_text(pages), "page_id", "text")
    assert len(got) == len(rows)
    assert all(t == f"Own text number {i} {'z' * i}" .strip() for i, t in got if i < 30)
    assert sorted(t for i, t in got if i >= 100) == ["", "no host", "no host"]
    assert sitetree.extract_main_text(pages.limit(0)).count() == 0


def test_paragraphs_behind_a_fixed_first_one_stay(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><article><p>By the staff {i % 2}</p><p>Own text {i} a</p><p>Own text {i} b</p></article></body>") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = collect(sitetree.extract_main_text(pages), "page_id", "text")
    assert all(t.endswith(f"Own text {i} a\nOwn text {i} b") for i, t in got) and len(got) == 300


def test_undeclared_template_goes_by_the_tree(spark):
    """Branches that no name declares; without the tree all of them stay. Titles and passages inside articles stay though repeated."""
    rows = []
    for i in range(12):
        host = "a.example" if i < 9 else "b.example"
        body = f"<div class='x1'>Welcome to {host}<ul><li>one<li>two</ul></div><article><h1>Same title</h1><p>Text {i} of {host} only</p></article><div><p>All rights reserved {host}</p></div>"
        rows.append((i, f"https://{host}/{i}", f"<body>{body}</body>"))
        rows.append((100 + i, f"https://plain-{host}/{i}", f"<body>{body.replace('article>', 'section>').replace('Same title', f'Title {i}')}</body>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = dict(collect(sitetree.extract_main_text(pages), "page_id", "text"))
    for i in range(12):
        host = "a.example" if i < 9 else "b.example"
        assert got[i] == f"Same title\nText {i} of {host} only"
        assert got[100 + i] == f"Title {i}\nText {i} of {host} only"
    assert "Welcome" in sitetree.main_text(rows[1][2], set(), set())


def test_a_page_without_article_stays_among_pages_with_one(spark):
    nav, foot = "<div class='x'>Same links</div>", "<div class='y'>Same end</div>"
    rows = [(i, f"http://h.example/{i}", f"<body>{nav}<article><p>Text {i} {'z' * i} of its own</p></article>{foot}</body>") for i in range(9)]
    rows.append((9, "http://h.example/9", f"<body>{nav}<section><p>A text in no article, longer than all that stands around it</p></section>{foot}</body>"))
    got = dict(collect(sitetree.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id", "text"))
    assert got[9] == "A text in no article, longer than all that stands around it"
    assert all(got[i] == f"Text {i} {'z' * i} of its own".replace("  ", " ") for i in range(9))


def test_deep_and_malformed_pages():
    for deep in ("<div>" * 100_000 + "text", "<div><p>x</span></b></ul>" * 20_000 + "text", "<b>" * 100_000 + "text</i>" * 1000, "<p" * 50_000, "</div>" * 100_000 + "text", "<div " + "a=1 " * 50_000 + ">text"):
        reader = sitetree.read(deep, nodes=True)
        assert len(reader.nodes) <= 100_000
        assert "text" not in deep or "text" in sitetree.main_text(deep, set(), set())


@pytest.mark.parametrize("tag", ["article", "div"])
def test_paragraphs_of_near_copies_stay(spark, tag):
    shared = [f"Paragraph {k} of a text that others copy with one line changed" for k in range(6)]
    texts = [[*shared, f"Copy {i}"] if i < 10 else [f"Own text {i} {k} of the page alone" for k in range(6)] for i in range(26)]
    line = "<div class='x'><p>A line of all pages</p></div>" if tag == "article" else "<p>A line of all pages</p>"
    rows = [(i, f"http://h.example/{i}", f"<body><{tag}>{'' if tag == 'article' else line}{''.join(f'<p>{p}</p>' for p in t)}</{tag}>{line if tag == 'article' else ''}</body>") for i, t in enumerate(texts)]
    got = dict(collect(sitetree.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id", "text"))
    assert got == {i: "\n".join(t) for i, t in enumerate(texts)}


# --- Jaccard join -----------------------------------------------------------------------------------------


def brute_join(rows, n, percent):
    """(n_shingles, component, links) of every document; rows: documents of one text each."""
    sets = {}
    for i, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0d]+", low)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root, links = {i: i for i in sets}, dict.fromkeys(sets, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                m = len(sets[a] & sets[b])
                if 100 * m >= percent * (len(sets[a]) + len(sets[b]) - m):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
                    links[a] += 1
                    links[b] += 1
    return {i: (len(sets[i]), find(i), links[i]) for i in sets}


def brute_components(rows, n, percent):
    return {i: r[:2] for i, r in brute_join(rows, n, percent).items()}


def near_copies(seed, groups, copies, length, edits):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)]
    base = [list(rng.choice(words, length)) for _ in range(groups)]
    rows = []
    for k in range(groups * copies):
        b = list(base[k % groups])
        for _ in range(rng.integers(0, edits)):
            b[rng.integers(0, length)] = str(rng.choice(words))
        rows.append((k, " ".join(b)))
    return rows


def joined_rows(spark, rows, n, percent):
    return {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.jaccard_join(odd_docs(spark, rows), n, percent).collect()}


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_join_equals_brute_force(spark, n, percent):
    rows = near_copies(3, 3, 70, 110, 7)
    rows += [(1000 + k, t) for k, t in enumerate(["", None, "a", "A", "a b", "a b c", "a  b\tc", "x y z w", "X Y z w", " "])]
    assert joined_rows(spark, rows, n, percent) == brute_join(rows, n, percent)


def test_all_links_come_from_regions(spark, monkeypatch):
    def no_links(batches):
        for batch in batches:
            yield from ()

    rows = near_copies(3, 3, 20, 60, 4)
    assert len({r[1] for r in joined_rows(spark, rows, 4, 85).values()}) < len(rows)
    monkeypatch.setattr(jaccard, "region_links", lambda t: no_links)
    different = {t: k for k, t in rows}
    assert all(r[1] == k for k, r in joined_rows(spark, [(k, t) for t, k in different.items()], 4, 85).items())


@pytest.mark.parametrize("region, crowd, often", [(25, 1 << 20, 32), (60, 10, 5), (12, 4, 1 << 20)])
def test_divided_regions_lose_nothing(spark, monkeypatch, region, crowd, often):
    """Regions divided by distributed pivots, down to dense blocks; crowded shingles' pivots by aggregation."""
    for name, value in (("REGION", region), ("SMALL", 4), ("CROWD", crowd), ("OFTEN", often), ("SPLIT", 6)):
        monkeypatch.setattr(jaccard, name, value)
    rows = near_copies(5, 4, 45, 70, 9)
    assert joined_rows(spark, rows, 4, 85) == brute_join(rows, 4, 85)


def test_parts_of_a_region_are_exact(monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 8)
    rows = near_copies(9, 12, 20, 80, 4)
    sets = jaccard.shingle_sets([t.encode() for _, t in rows], 4)
    region = jaccard.Region(sets, 85).join()
    want = brute_join(rows, 4, 85)
    assert region.degree.tolist() == [want[k][2] for k in range(len(rows))]
    groups, truth = {}, {}
    for k in range(len(rows)):
        groups.setdefault(region.find(k), set()).add(k)
        truth.setdefault(want[k][1], set()).add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, truth.values()))


def test_counters_never_rule_a_link_out():
    rng = np.random.default_rng(1)
    for size in (1, 3, 40, 130, 700, 3000):
        a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        for share in (0.8, 0.9, 1.0):
            b = np.concatenate([a[: int(size * share)], rng.integers(0, 1 << 63, size // 9, dtype=np.uint64)])
            small, large = sorted((a, b), key=len)
            x, y = (np.frombuffer(jaccard.counters(v), np.uint8).astype(int) for v in (small, large))
            assert np.abs(x - y.reshape(-1, len(x)).sum(0)).sum() <= len(np.setxor1d(a, b))


def test_documents_of_several_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, b + " more"), (9, "c c c c d"), (9, a), (8, "c c c c d"), (7, "lone"), (7, "alone"), (1, a)]
    got = sorted((r.doc_id, r.component_id, r.n_links) for r in jaccard.jaccard_join(odd_docs(spark, rows), 4, 85).collect())
    # text a: 1, 9 and, one word longer, 2; text b: 1 and, one word longer, 3 and 4; the short text: 8 and 9
    assert got == [(1, 1, 2), (1, 1, 2), (1, 1, 2), (2, 1, 2), (3, 1, 2), (4, 1, 2), (7, 7, 0), (7, 7, 0), (8, 1, 1), (9, 1, 1), (9, 1, 2)]


def test_join_of_odd_rows(spark):
    docs = odd_docs(spark)
    got = collect(jaccard.jaccard_join(docs), "doc_id", "n_shingles", "component_id")
    assert len(got) == len(ODD)
    assert {(i, c) for i, _, c in got} == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (7, 7), (8, 8), (None, None)}
    assert jaccard.jaccard_join(docs.limit(0)).count() == 0
    kept = jaccard.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [1, 2, 3, 4, 6, 7, 8]
    twice = odd_docs(spark, [(1, "b text"), (1, "a text"), (2, None), (2, "x"), (None, "x"), (None, "x")])
    assert sorted(collect(jaccard.first_of_each(twice), "doc_id", "text"), key=str) == [(1, "a text"), (2, None), (None, "x"), (None, "x")]


def test_bitmap_filters(spark):
    rows = spark.range(5000).withColumnRenamed("id", "doc_id")
    ids = rows.filter("doc_id % 7 = 0")
    assert only(rows, ids).count() == ids.count()
    assert without(rows, ids).count() == 5000 - ids.count()
    assert without(rows, ids.limit(0)).count() == 5000 and only(rows, ids.limit(0)).count() == 0


# --- packing --------------------------------------------------------------------------------------------


def check_packing(rows, capacity):
    spans = {}
    for sequence, offset, length in rows:
        spans.setdefault(sequence, []).append((offset, length))
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(spans)


def test_plan_is_tight():
    rng = np.random.default_rng(0)
    for _ in range(20):
        capacity = int(rng.integers(8, 200))
        sizes = rng.integers(1, capacity + 1, rng.integers(1, 400))
        counts = {int(s): int((sizes == s).sum()) for s in {*sizes.tolist()}}
        plan = packing.plan(counts, capacity)
        assert {s: int(plan[plan[:, 0] == s, 2].sum()) for s in counts} == counts
        rows = [(first + k, offset, s) for s, _, n, first, offset in plan.tolist() for k in range(n)]
        used = check_packing(rows, capacity)
        best, gaps = 0, []
        for s in sorted(sizes.tolist(), reverse=True):  # plain best fit
            fits = [g for g in range(len(gaps)) if gaps[g] >= s]
            if fits:
                gaps[min(fits, key=lambda g: gaps[g])] -= s
            else:
                gaps.append(capacity - s)
        best = len(gaps)
        assert used <= best * 1.05 + 1


def test_packed_documents(spark):
    docs = odd_docs(spark)
    path = tokenizer_path("word_bpe_49k.json")
    library = bpe.load(path).library
    rows = packing.pack_documents(docs, path, capacity=256).collect()
    check_packing([(r.sequence_id, r.offset, r.length) for r in rows], 256)
    want = []
    for i, t in ODD:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 256):
            want.append((i, k // 256, k, len(ids[k : k + 256]), zlib.crc32(np.array(ids[k : k + 256], "<u4").tobytes())))
    assert sorted(map(str, ((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows))) == sorted(map(str, want))
    assert packing.pack_documents(docs.limit(0), path).count() == 0


# --- chats ----------------------------------------------------------------------------------------------

LONG = "very ## long \\h " * 50_000
TURNS = [(4, 1, "assistant", LONG), (1, 1, "user", "hi ## </turn> \\h"), (1, 2, "assistant", "### a: b"), (1, 3, "assistant", None), (1, 4, "sys:tem", "\\s####"), (1, 5, None, "x"), (2, 2, "assistant", "b"), (2, 1, "user", "a"), (2, 1, "user", "a"), (None, 1, "user", "lost"), (3, None, "user", "no turn")]


def test_chats_read_back(spark):
    turns = spark.createDataFrame([(*r, 1, "clash") for r in TURNS], "conv_id long, turn long, role string, text string, n_turns long, formatted string")
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(turns)).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv, r in got.items():
        rows = sorted(((t if t is not None else -1), role or "", x or "") for c, t, role, x in TURNS if c == conv)
        told = "".join(f"{role}\n{x}\n" for _, role, x in rows)
        loss = "".join(x for _, role, x in rows if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(rows), hashlib.sha256(told.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    text = {r.conv_id: r.formatted for r in chat.format_chats(turns).collect()}
    assert text[2] == "### user: a</turn>a</turn>\n### assistant: b</turn>\n"
    assert chat.format_chats(turns.limit(0)).count() == 0


# --- licenses -------------------------------------------------------------------------------------------


def brute_licenses(text, templates, threshold=licenses.THRESHOLD):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    met = {}
    for label, (notice, must) in templates.items():
        own, length = set(notice.split()), len(notice.split())
        for s in range(len(w)):
            block = own & set(w[s : s + length])
            if len(block) >= threshold * len(own) - 1e-9 and set(must.split()) <= block:
                met[label] = max(met.get(label, 0), len(block) / len(own))
    return met


def test_license_blocks_equal_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for k, (label, (notice, _)) in enumerate(list(licenses.TEMPLATES.items()) * 12):
        w = notice.split()
        for _ in range(rng.randrange(len(w) // 3)):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = rng.sample(["the", "software", "filler", "of", "license"], rng.randrange(2))
        filler = [rng.choice(["the", "and", "text", "granted", "of"]) for _ in range(rng.randrange(40))]
        rows.append((k, " ".join([*filler, *w, *filler])))
    templates = licenses.TEMPLATES | {"long": (" ".join(f"clause{i} of" for i in range(300)), "clause7")}  # far beyond any fixed block
    rows += [(900, " ".join(f"clause{i} of" for i in range(260))), (901, " ".join(f"clause{i} of" for i in range(200))), (902, "clause7 " * 5)]
    got = {r.doc_id: (r.labels, round(r.score, 9)) for r in licenses.scan_licenses(odd_docs(spark, rows), templates).collect()}
    for k, text in rows:
        met = brute_licenses(text, templates)
        assert got[k] == (",".join(sorted(met)), round(max(met.values(), default=0.0), 9)), k
    assert got[900][0] == "long" and got[901][0] == "" and len({v for v, _ in got.values()}) > 6


def test_license_labels(spark):
    mit, gpl = licenses.TEMPLATES["mit"][0], licenses.TEMPLATES["gpl-3"][0]
    rows = [
        (1, "Released UNDER the MIT License. under the mit license"), (2, mit.upper().replace("SOFTWARE", "Software,")),
        (3, "nothing here"), (4, None), (5, ""), (6, "Apache License, Version 2.0 and cc-by-nc"), (7, "word " * 5000 + gpl), (3, "nothing here"), (8, "Licensed under CC BY 4.0"),
    ]
    got = collect(licenses.scan_licenses(odd_docs(spark, rows)), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels")
    by = {r[0]: r[1:] for r in got}
    assert len(got) == len(rows)
    assert by[1] == (9, 2, 1, 5, "mit", "mit") and by[2][1:] == (0, None, None, "", "mit") and by[3] == (2, 0, None, None, "", "") and by[8][4:] == ("", "")
    assert by[4] == by[5] == (0, 0, None, None, "", "") and by[6][1:5] == (2, 0, 6, "apache-2,cc-by-nc") and by[7][4:] == ("", "gpl-3")
    assert licenses.scan_licenses(odd_docs(spark).limit(0)).count() == 0
