"""The training-data operators against brute force, round trips and planted cases."""

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from citegrain.llm import ann, binary, html, langid, lm, mixing, packing, quality, rules, simhash, tokens
from citegrain.llm.trie import ef_get, elias_fano

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, k string"
WORDS = "the of and river stone quiet garden window mountain paper letter music winter".split()


def sentence(seed: int, n: int = 60) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n)) + f" end{seed}."


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, sentence(i), "en", "a" if i % 3 else "b", 1, "x", "y") for i in range(40)]
    rows += [(40, None, None, None, None, None, None), (41, "", "en", None, 0, None, None), (None, "null key here", "fr", "a", 1, None, None), (42, sentence(1), "en", "a", 1, None, None), (1, sentence(1), "en", "a", 1, "x", "y")]
    rows += [(43, "mot très long " * 3000, "fr", "b", 1, None, None), (44, "!!! ??? 123", "en", "a", 1, None, None)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_special_tokens_are_those_of_the_plain_library(name):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(name))
    added = [x.content for x in plain.get_added_tokens_decoder().values()]
    texts = [f"{a} hi" for a in added] + [f"hi{a}there {a}" for a in added] + [a.upper() for a in added] + ["<|endoftext", "hi there"]
    e = tokens.Encoder(public_tokenizers.path(name))
    assert [np.frombuffer(x, e.kind).tolist() for x in e.ids(texts)] == [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name,end", [("word_bpe_49k.json", 2), ("byte_bpe_50k.json", 0)])
def test_tokens_are_the_library_s(name, end):
    e = tokens.Encoder(public_tokenizers.path(name))
    texts = ["", "  a  b\n\n c", "it's o'clock's ''s !'s", "naïve ½ ² x\x1cy\x85z \xa0 q", "İstanbul", "日本語 text", "<|endoftext|> hi", "a\r\n\tb ", sentence(3)]
    assert [np.frombuffer(x, e.kind).tolist() for x in e.ids(texts)] == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_code_lengths_are_optimal_and_limited():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 0])
    lengths = binary.code_lengths(counts)
    assert lengths[-1] == 0 and (2.0 ** -lengths[:-1].astype(float)).sum() == 1
    assert (lengths[:-1] * counts[:-1]).sum() == 132  # Huffman's cost for Fibonacci counts
    short = binary.code_lengths(counts, 4)
    assert short.max() == 4 and (2.0 ** -short[:-1].astype(float)).sum() <= 1
    assert binary.code_lengths(np.array([0, 7])).tolist() == [0, 1]


def test_huffman_round_trip(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    tool = tokens.Encoder(path).tokenizer
    got = binary.round_trip(docs, path).toPandas().sort_values("start")
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0))
    want = [tool.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in rows]
    assert [np.frombuffer(x, "<u4").tolist() for x in got["ids"]] == want
    assert got["start"].tolist() == np.cumsum([0] + [len(x) for x in want])[:-1].tolist()
    assert binary.round_trip(docs.limit(0), path).count() == 0


def test_one_doc_id_of_many_rows_is_dealt_to_several_parts(spark, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(binary, "RANGE_DOCS", 2)
    rows = [(5, sentence(i, 9)) for i in range(60)] + [(None, sentence(i, 5)) for i in range(30)] + [(i, sentence(i, 7)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("x")).repartition(3)
    encoded = binary.encode(df, path, 2).toPandas()
    assert encoded[encoded["doc_id"] == 5]["part"].nunique() > 3 and encoded[encoded["doc_id"].isna()]["part"].nunique() > 3
    got = binary.round_trip(df, path).toPandas().sort_values("start")
    assert (got["start"] == (got["ids"].str.len() // 4).cumsum() - got["ids"].str.len() // 4).all()
    assert got["doc_id"].isna().tolist() == [True] * 30 + [False] * 90 and got["doc_id"][got["doc_id"].notna()].is_monotonic_increasing
    tool = tokens.Encoder(path).tokenizer
    want = sorted((-1 if k is None else k, np.array(tool.encode(x, add_special_tokens=False).ids + [2], "<u4").tobytes()) for k, x in rows)
    assert sorted((-1 if pd.isna(k) else int(k), bytes(x)) for k, x in zip(got["doc_id"], got["ids"])) == want


@pytest.mark.parametrize("sent", [2048, 0])
def test_packing(spark, docs, monkeypatch, sent):
    monkeypatch.setattr(packing, "BROADCAST_TASKS", sent)
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pieces(docs, path).toPandas()
    tool = tokens.Encoder(path).tokenizer
    total = sum(len(tool.encode(r[0] or "", add_special_tokens=False).ids) + 1 for r in docs.select("text").collect())
    assert got["length"].sum() == total and got["length"].max() <= packing.SIZE
    s = got.sort_values(["sequence_id", "offset"])
    assert (s["offset"] == s.groupby("sequence_id")["length"].cumsum() - s["length"]).all()
    assert s.groupby("sequence_id")["length"].sum().max() <= packing.SIZE
    assert got["sequence_id"].nunique() == -(-total // packing.SIZE)
    want = sorted((-1 if r[0] is None else r[0], np.array(tool.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for r in docs.select("doc_id", "text").collect())
    whole, last = [], None
    for r in got.assign(k=got["doc_id"].fillna(-1).astype(int)).sort_values(["k", "piece"]).itertuples():
        assert r.piece == 0 or (r.length == packing.SIZE and r.offset == 0)
        if r.k not in (1, -1) and r.piece:
            assert r.start == len(whole[-1][1]) // 4
            whole[-1] = (r.k, whole[-1][1] + r.ids)
        else:
            assert r.start == 0
            whole.append((r.k, r.ids))
    assert sorted((k, bytes(x)) for k, x in whole) == want
    assert packing.pieces(docs.limit(0), path).count() == 0


def test_fullest_is_exact():
    for seed in range(30):
        rng = np.random.default_rng(seed)
        counts = {int(k): int(n) for k, n in zip(rng.integers(3, 40, 5), rng.integers(1, 4, 5))}
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1)}
        used = packing.fullest(61, sorted(counts, reverse=True), counts)
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= 61)
        assert all(n <= counts[k] for k, n in used.items())


def test_mixing_meets_budgets(spark, monkeypatch):
    rows = [(i, "w " * 10, s) for i, s in enumerate(["big"] * 300 + ["mid"] * 60 + ["low"] * 20 + [None] * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, entropy=0.9, block_tokens=100).toPandas()
    tokens_of = got.assign(s=got["source"].fillna("?")).groupby("s").size() * 10
    share = np.array([3000, 600, 200, 50]) / 3850
    best = max(a for a in np.linspace(0, 1, 1001) if -(p := share**a / (share**a).sum()) @ np.log(p) >= 0.9 * np.log(4))
    want = share**best / (share**best).sum() * 3850
    assert abs(tokens_of[["big", "mid", "low", "?"]].to_numpy() - want).max() <= 20
    assert got.groupby(["doc_id", "mix_epoch"]).size().max() == 1
    assert (got.groupby("doc_id")["mix_epoch"].max() + 1 == got.groupby("doc_id").size()).all()
    capped = mixing.mix(df, repeats=2.0).toPandas()
    assert capped.groupby("source").size()["low"] <= 41
    for digits in (1, 32):
        monkeypatch.setattr(mixing, "RANGE_DIGITS", digits)
        again = mixing.mix(df, entropy=0.9, block_tokens=100).toPandas()
        assert sorted(zip(again["doc_id"], again["mix_order"])) == sorted(zip(got["doc_id"], got["mix_order"]))
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_takes_odd_rows(spark, docs):
    got = mixing.mix(docs.withColumn("mix_epoch", F.lit("mine"))).toPandas()
    assert got["mix_epoch"].dtype.kind == "i" and 40 not in set(got["doc_id"]) and (got["doc_id"] == 1).sum() >= 2


def test_language(spark):
    fr = "le la les une dans avec pour être maison jardin fenêtre hiver musique lettre".split()
    rows = [(i, sentence(i), "en") for i in range(60)] + [(100 + i, " ".join(np.random.default_rng(i).choice(fr, 50)), "fr") for i in range(60)]
    rows += [(300, None, None), (301, "123 !!", "en"), (302, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, training=F.col("doc_id") % 2 == 0)
    got = df.select("*", langid.predict(F.col("text"), model).alias("p")).select("*", "p.score", F.col("p.lang").alias("pred")).toPandas().set_index("doc_id")
    clean = got[got.index < 300]
    assert (clean["pred"] == clean["lang"]).all() and clean["score"].between(0, 1).all()
    assert (got.loc[300:, "pred"] == "und").all()
    empty = langid.train(df.limit(0), training=F.lit(True))
    assert empty.predict(["a", ""])[0] == ["und", "und"]


def test_languages_of_one_key_are_all_learned(spark):
    """Rows are drawn each on its own: with one key (or null) for all, copies included, each language has about `max_rows` of them."""
    rows = [(None if i % 2 else 7, sentence(i % 50), "en", "x", 1) for i in range(2000)] + [(7, "le chat noir dort dans la maison", "fr", "y", 2)] * 2000 + [(7, "der hund " * 20_000, "de", "z", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, chance string, docs int").repartition(4)
    model = langid.train(df, training=F.lit(True), max_rows=40)
    got = df.select("lang", langid.predict(F.col("text"), model).alias("p")).select("lang", "p.lang", "p.score").distinct().toDF("lang", "pred", "score").toPandas()
    assert model.languages == ["de", "en", "fr"] and (got["lang"] == got["pred"]).all() and (got["score"] > 0.5).all()


def brute_languages(texts: list[str], train: list[tuple[str, str]], least: float) -> list[dict[str, float]]:
    """Of each text the share of its n-grams that each language's set holds, by plain sets."""
    count: dict = {}

    def each(text: str, n: int) -> list[bytes]:
        raw = re.sub(rb"[^a-z\x80-\xff]+", b" ", f" {text.lower()} ".encode("utf-8", "replace"))
        return [raw[i : i + n] for i in range(len(raw) - n + 1)]

    for lang, text in train:
        for n in (3, 4):
            count.setdefault((lang, n), Counter()).update(each(text, n))
    held = {key: {g for g, n in c.items() if n >= least * c.total()} for key, c in count.items()}
    out = []
    for text in texts:
        grams = [(n, g) for n in (3, 4) for g in each(text, n)]
        out.append({lang: sum(g in held[lang, n] for n, g in grams) / max(1, len(grams)) for lang, _ in held})
    return out


def test_languages_are_those_of_plain_sets(spark):
    """Filters against sets on the given documents: shares differ by the filters' doubt only; n-grams below SHARE decide no text."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    use = df.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2).where("lang IS NOT NULL AND text IS NOT NULL")
    model = langid.train(df, training=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2, max_rows=10**9)
    texts = [r[0] for r in df.where("text RLIKE '[A-Za-z]'").select("text").collect()]
    pred, score = model.predict(texts)
    train = [(r["lang"], r["text"]) for r in use.select("lang", "text").collect()]
    exact, whole = (brute_languages(texts, train, least) for least in (langid.SHARE, 0))
    for lang, s, e, w in zip(pred, score, exact, whole):
        assert abs(s - e[lang]) < 0.02 and e[lang] > max(e.values()) - 0.02
        assert w[lang] == max(w.values())


def test_filters_return_every_language_that_holds_an_n_gram():
    held = pd.DataFrame({"lang": ["a", "b", "b", "a", "b"], "size": [3, 3, 3, 0, 0], "gram": [7, 7, 9, 0, 0], "n": [1, 1, 1, 5, 9]})
    model = langid.build(held)
    assert model.hits(np.array([7, 9], np.uint64))[:, 0].tolist() == [3, 2]


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""),
        ("", ""),
        ("<nav><a href=x>Home</a></nav><article><h1>T &amp; é</h1><p>One\n two <b>three</b>.<br><p>Short.</article><footer>f</footer>", "T & é\nOne two three.\nShort."),
        ('<div class="ad">Buy the thing of it</div><article><script>var a="</p>";</script><p>Text</p><div id="comments"><p>said the reader</p></div></article>', "Text"),
        ('<body class="with-sidebar"><header>Site</header><main><header><h1>Head</h1></header><p>Body</p><aside>x</aside></main></body>', "Head\nBody"),
        ("<p>a < b and c > d</p><form>Name <input></form>", "a < b and c > d"),
        ("<div>The text of it is in a long way and that is for the good of it all.</div><div>Near</div><p>And this is the way that it was for all of us in the end, so to say it.</p><ul><li><a>x y z</a></li></ul>", "The text of it is in a long way and that is for the good of it all.\nNear\nAnd this is the way that it was for all of us in the end, so to say it."),
        ("<!-- open", ""),
        ('<article><a href="/x">More</a> news today</article><div>The story of the town is long and it is told here to all of them at the end.</div><div>And it is that of the river, as it was in the old days for all that live by it.</div>', "The story of the town is long and it is told here to all of them at the end.\nAnd it is that of the river, as it was in the old days for all that live by it."),
        ('<article><h1>Head</h1><p class="social-science">A study of the people.</p><p class="search-results">What was found.</p></article>', "Head\nA study of the people.\nWhat was found."),
        ('<div class="site-header">S</div><div id="cookie-notice">C</div><article><p>Text</p><div class="comments-area"><p>R</p></div><ul class="share-buttons"><li>t</li></ul></article><div class="side-bar">x</div>', "Text"),
        ('<main><article><p>The long story of it and of all that is in it for us to read.</p><p>Short one.</p><ul><li><a href="/a">link one</a></li></ul></article><article><a href="/b">Next</a> one</article></main>', "The long story of it and of all that is in it for us to read.\nShort one."),
        ("<article><p>a<script>x<svg></script>b <svg><p>no</p></svg>c</p><TextArea>q</textarea></article>", "a b c"),
        ('<article><p title="a > b">One</p><p title="never closed>Two</p><p>Three</p></article>', "One\nTwo\nThree"),
    ],
)
def test_main_text(page, want):
    assert html.main_text(page) == want


BODY = "<h1>Rain over the hills</h1>" + "".join(f"<p>It was the {w} day of the year and the rain fell on all of the hills by the river, as it had done before.</p>" for w in "first second third fourth".split())
SAID = "<p>This is what one of the readers of the page had to say about it, and it is not of the article.</p>"


@pytest.mark.parametrize("whole", ["<article>{}</article>", "<div class='content'>{}</div>", "<form id='aspnetForm'><div>{}</div></form>", "<div class='content-sidebar-wrap has-sidebar'>{}</div>", "<div class='social-science'>{}</div>"])
@pytest.mark.parametrize(
    "name",
    """post-comments reader-comments user-comments entry-comments comment-thread discussion responses commentlist blog-sidebar article-footer related-articles related-stories share-tools
    advert-300x250 adsbygoogle comments sidebar footer postComments ad-slot""".split(),
)
def test_containers_are_told_by_a_word_in_their_name(whole, name):
    text = "\n".join(html.main_text(BODY).split("\n"))
    assert text.count("\n") == 4 and html.main_text("<body>" + whole.format(BODY + f"<div class='{name}'>{SAID}</div>") + "</body>") == text


def test_long_comments_are_no_article():
    assert html.main_text(f"<body><div class='post'>{BODY}</div><div id='reader-comments'>{SAID * 30}</div></body>") == html.main_text(BODY)


def test_names_of_paragraphs_and_of_what_is_absent_do_not_count():
    page = f"<body><article>{BODY}<p class='reply'>{SAID[3:-4]}</p><p class='side'>{SAID[3:-4]}</p></article></body>"
    assert html.main_text(page).count("\n") == 6
    assert html.main_text(f"<body><div class='no-sidebar comments-closed'>{BODY}</div></body>") == html.main_text(BODY)


def test_a_small_form_is_no_text():
    assert html.main_text(f"<body><div>{BODY}<form><p>Write to us of all that you have to say on this, and we will be in touch with you.</p></form></div></body>") == html.main_text(BODY)


@pytest.mark.parametrize("unit", ['<a "', "<a b='>' ", "<a b=\"x", "<p>x", "<div><", "<!", "&amp", "</p", "<script>x", "<b class=ad>"])
def test_faulty_pages_are_read_once(unit):
    import time

    began = time.process_time()
    html.main_text(unit * ((1 << 20) // len(unit)))
    assert time.process_time() - began < 5


def test_pages_keep_their_rows(spark):
    rows = [(1, "<p>a</p>"), (1, "<p>a</p>"), (None, None), (2, ""), (3, "<article>" + "<p>word of it</p>" * 20_000)]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("mine")).select("page_id", "text", html.extract(F.col("html")).alias("x"))
    got = df.collect()
    assert sorted((str(r[0]), r[1], len(r["x"])) for r in got) == [("1", "mine", 1), ("1", "mine", 1), ("2", "mine", 0), ("3", "mine", 20_000 * 11 - 1), ("None", "mine", 0)]
    assert df.limit(0).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8))
    x[100:150] = x[99]  # one common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (1060, [1.0] * 3), (1080, [None] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, queries="key % 20 = 0", k=5).toPandas().sort_values(["query_id", "rank"])
    hits = 0
    for q in range(0, 600, 20):
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(600), -s)) if i != q][:5]
        own = got[got["query_id"] == q]
        hits += len(set(order) & set(own["key"]))
        assert own["rank"].tolist() == [1, 2, 3, 4, 5] and np.allclose(own["score"], s[own["key"]])
    assert hits >= 0.9 * 150 and not set(got["query_id"]) & {1000, 1020, 1040, 1080}
    assert ann.nearest(df.limit(0), queries="key % 20 = 0").count() == 0


def test_recall_on_vectors_of_any_norm():
    """One shard of unit vectors, and one of the upper third of Gaussian ones."""
    rng = np.random.default_rng(2)
    gauss = rng.normal(size=(6000, 32))
    norm = np.sqrt((gauss**2).sum(axis=1))
    for x in (gauss[:2000] / norm[:2000, None], gauss[norm >= np.quantile(norm, 2 / 3)]):
        links, start = ann.build(ann._lifted(x, np.sqrt((x * x).sum(axis=1).max())))
        shard = {"x": x, "lifted": ann._lifted(x, np.sqrt((x * x).sum(axis=1).max())), "links": links, "start": start, "least": np.arange(len(x))}
        q = gauss[:100]
        r, node, _ = ann._found(shard, q, 19, ann.SEARCH)
        hits = sum(len(set(np.argsort(-x @ q[i])[:20]) & set(node[r == i])) for i in range(100))
        assert hits >= 0.9 * 2000


def test_a_shard_is_indexed_and_searched_in_little_time():
    """4000 unit vectors of 64 components, the hardest kind, half of them in clusters; queries that are rows of it and such that are not."""
    import time

    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 64))
    x[2000:] = np.repeat(x[:40], 50, axis=0) + 0.1 * x[2000:]
    x /= np.sqrt((x**2).sum(axis=1, keepdims=True))
    q = np.concatenate([x[::20], rng.normal(size=(300, 64))])
    began = time.thread_time()
    lifted = ann._lifted(x, 1.0)
    links, start = ann.build(lifted)
    shard = {"x": x, "lifted": lifted, "links": links, "start": start, "least": np.arange(len(x))}
    r, node, score = ann._found(shard, q, 19, ann._width(len(x), ann.SEARCH))
    assert time.thread_time() - began < 4
    assert np.bincount(links[links >= 0], minlength=len(x)).min() > 0  # every vector can be reached
    assert np.allclose(score, (q[r] * x[node]).sum(axis=1), rtol=0, atol=1e-12)
    assert sum(len(set(np.argsort(-x @ v)[:20]) & set(node[r == i])) for i, v in enumerate(q)) >= 0.95 * 20 * len(q)


def test_nearest_rows_of_one_key_count_each(spark):
    rows = [(0, [1.0, 0.0]), (5, [2.0, 0.0]), (5, [-3.0, 1.0]), (7, [0.5, 0.0]), (7, [0.5, -0.0]), (20, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit("mine")).withColumn("node", F.lit(1))
    got = ann.nearest(df, queries="key % 5 = 0", k=4).collect()
    of = lambda q: sorted((r["rank"], r["key"], r["score"]) for r in got if r["query_id"] == q)
    assert of(0) == [(1, 5, 2.0), (2, 20, 1.0), (3, 7, 0.5), (4, 7, 0.5)]
    assert of(20) == [(1, 5, 2.0), (2, 0, 1.0), (3, 7, 0.5), (4, 7, 0.5)]
    assert of(5) == sorted([(1, 0, 2.0), (2, 20, 2.0), (3, 7, 1.0), (4, 7, 1.0), (1, 7, -1.5), (2, 7, -1.5), (3, 20, -2.0), (4, 0, -3.0)])


def test_elias_fano():
    for values in ([0], [0, 0, 3, 3, 9, 500, 500, 70_000], list(range(0, 9000, 7))):
        v = np.array(values)
        assert ef_get(elias_fano(v), np.arange(len(v))).tolist() == values


def test_language_model(spark, docs):
    df = docs.where("doc_id IS NULL OR doc_id <> 44")
    train = F.coalesce(F.col("doc_id"), F.lit(1)) % 4 != 0
    got = lm.score(df, training=train, order=3).toPandas()
    assert len(got) == df.count()
    rows = [(r[0], r[1] or "") for r in df.select("doc_id", "text").collect()]
    words = {r: [w.lower() for w in r[1].split()] + [None] for r in rows}
    seen = [w for r in rows if (1 if r[0] is None else r[0]) % 4 != 0 for w in words[r]]
    count = pd.Series([str(w) for w in seen]).value_counts()
    n, v = len(seen), len(count)
    base = {r: sum(np.log10((count.get(str(w), 0) + 1) / (n + v + 1)) for w in words[r]) for r in rows}
    for r in got.itertuples():
        key = next(k for k in rows if (k[0] == r.doc_id or (k[0] is None and pd.isna(r.doc_id))))
        assert r.train_tokens == n and r.n_tokens == len(words[key]) and abs(r.base_score - base[key]) < 1e-6 * max(1, abs(base[key]))
        assert r.score < 0
    held = got[~got["train"]]
    assert held["score"].sum() > held["base_score"].sum()
    assert lm.score(df.limit(0), training=train).count() == 0


@pytest.mark.parametrize("words,span", [(3000, 200), (3000, 1 << 20), (20, 60), (300, 500)])
def test_scores_are_those_of_brute_force(spark, monkeypatch, words, span):
    """Probabilities of one byte are off by 4 % at most, and by less for frequent kinds; ranges and splits change nothing."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, rng.integers(0, 60)) % words) for _ in range(120)]
    texts += [texts[3], "one two three four five six", "one two three four five six", "", "w1 never seen"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string").repartition(5)
    monkeypatch.setattr(lm, "SPAN", span)
    got = {r["doc_id"]: r["score"] for r in lm.score(df, training=F.col("doc_id") % 5 != 0).collect()}
    seen = counted(texts, range(0, len(texts), 5))
    for i, x in enumerate(texts):
        line = ["<", "<", *x.split(), ">"]
        want = sum(np.log10(witten_bell(seen, tuple(line[j - 2 : j]), line[j])) for j in range(2, len(line)))
        assert abs(got[i] - want) < 0.016 * (len(line) - 2), i
    assert len(got) == len(texts)


def counted(texts, held=()):
    """Counts of what follows each context of up to two words in the texts outside `held`."""
    seen = [{} for _ in range(3)]
    for i, x in enumerate(texts):
        line = ["<", "<", *x.split(), ">"]
        for j in range(2, len(line)) if i not in held else ():
            for n in range(3):
                after = seen[n].setdefault(tuple(line[j - n : j]), {})
                after[line[j]] = after.get(line[j], 0) + 1
    return seen


def witten_bell(seen, context, word):
    after = seen[len(context)].get(context, {})
    lower = witten_bell(seen, context[1:], word) if context else 1 / (len(seen[0][()]) + 1)
    return (after.get(word, 0) + len(after) * lower) / (sum(after.values()) + len(after)) if after else lower


@pytest.mark.parametrize("symbols", [20, 300, 2000, 70_000])
def test_trie_finds_what_was_counted(tmp_path, symbols):
    from citegrain.llm import trie

    rng = np.random.default_rng(symbols)
    w = np.sort(rng.choice(1 << 62, symbols, replace=False)).astype(np.uint64)
    a, b, c = rng.zipf(1.2, (3, 30_000)) % symbols
    b[:70_000] = np.where(rng.random(len(b)) < 0.5, 3, b)
    gram, n = np.unique((a * symbols + b) * symbols + c, return_counts=True)
    a, b, c = gram // symbols**2, gram // symbols % symbols, gram % symbols
    arrays = trie.build(w, a, b, c, n)
    trie.save(arrays, str(tmp_path / "t"))
    t = trie.Trie(trie.mapped(str(tmp_path / "t")))
    asked = np.concatenate([np.stack([a, b, c]), rng.integers(0, symbols, (3, 5000))], axis=1)
    word = t.word(w[asked])
    assert (word == asked).all() and (t.word(w + np.uint64(1)) < 0).mean() > 0.5
    node = t.pair(word[0], word[1])
    leaf = t.trigram(node, word[1], word[2])
    df = pd.DataFrame({"a": a, "b": b, "c": c, "n": n})
    pairs, whole = df.groupby(["a", "b"])["n"].agg(["sum", "size"]), df.groupby("a")["n"].sum().reindex(range(symbols), fill_value=0)
    kinds = pairs.reset_index().groupby("a").size().reindex(range(symbols), fill_value=0)
    followed, others = t.counts(np.arange(symbols))
    assert (followed == whole).all() and (others == kinds).all()
    place = {(x, y, z): k for x, y, z, k in zip(a.tolist(), b.tolist(), c.tolist(), n.tolist())}
    total, different = pairs["sum"].to_dict(), pairs["size"].to_dict()
    p3, p2, left = trie.VALUES[t.codes("p3", leaf)], trie.VALUES[t.codes("p2", node)], trie.VALUES[t.codes("left2", node, 0)]
    near = lambda x, y: x == y == 0 or abs(np.log10(x / y)) < 0.05
    for k, (x, y, z) in enumerate(asked.T.tolist()):
        s, d = total.get((x, y), 0), different.get((x, y), 0)
        assert near(p3[k], place.get((x, y, z), 0) / (s + d) if s else 0), k
        assert near(p2[k], s / (whole[x] + kinds[x]) if s else 0) and near(left[k], d / (s + d) if s else 1)
    assert trie.Trie(trie.build(np.zeros(0, np.uint64), *(np.zeros(0, int),) * 4)).pair(np.array([-1]), np.array([-1])).tolist() == [-1]


def test_quality(spark):
    good = [(i, sentence(i, 80)) for i in range(200)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in sentence(i, 80).split())) for i in range(60)]
    df = spark.createDataFrame(good + bad + [(5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good[::2]] + [(i, 0) for i, _ in bad[::2]] + [(None, 1), (1, None), (9999, 1)], "doc_id long, quality int")
    model = quality.train(df, labels, training=F.col("doc_id") % 5 != 0)
    got = df.select("doc_id", quality.score(F.col("text"), model).alias("s")).toPandas().set_index("doc_id")["s"]
    assert got.between(0, 1).all() and got.loc[:999].min() > 0.5 and got.loc[1000:4999].max() < 0.3
    assert quality.train(df.limit(0), labels, training=F.lit(True)).score(np.zeros((1, len(quality.measures(""))))).shape == (1,)


@pytest.mark.parametrize("hot", [3, None])
def test_quality_draws_rows_not_keys(spark, monkeypatch, hot):
    """A key (or null) with nearly all rows, copies and a long text among them, gives bounded samples; names that clash don't matter."""
    rows = [(hot, sentence(i % 7), "a", 1) for i in range(3000)] + [(i, sentence(i), "b", 2) for i in range(10, 40)] + [(hot, "WIN!! " * 40_000, "c", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string, quality int").repartition(4)
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(None, 1)], "doc_id long, quality int")
    seen, fit = [], quality.fit

    def watched(positive, unlabelled, prior, **more):
        seen.append((len(positive), len(unlabelled)))
        return fit(positive, unlabelled, prior, **more)

    monkeypatch.setattr(quality, "fit", watched)
    model = quality.train(df, labels, training=F.lit(True), max_rows=200)
    positive, unlabelled = seen[-1]
    assert 120 < unlabelled < 300 and positive == 30 if hot is None else 120 < positive < 300 and 120 < unlabelled < 300
    got = df.select("text", quality.score(F.col("text"), model).alias("s")).distinct().toPandas()
    assert got["text"].is_unique and got["s"].between(0, 1).all()


@pytest.mark.parametrize("share", [0.2, 0.5, 0.85])
def test_prior_is_estimated_from_positives_and_unlabelled(share):
    rng = np.random.default_rng(3)
    good, bad = rng.normal(0, 1, (6000, 4)), rng.normal(2.5, 1, (6000, 4))
    n = int(4000 * share)
    assert abs(quality.estimated_prior(good[:2000], np.concatenate([good[2000 : 2000 + n], bad[: 4000 - n]])) - share) < 0.08


def test_non_negative_risk_is_the_least_there_is():
    """The fitted risk against that of Newton's method, where the risk's bracket is positive and the risk convex."""
    rng = np.random.default_rng(6)
    p, u, prior = rng.normal(0, 1, (2000, 3)), np.concatenate([rng.normal(0, 1, (2000, 3)), rng.normal(1, 1, (2000, 3))]), 0.5
    model = quality.fit(p, u, prior, steps=3000)

    def rows(x: np.ndarray) -> np.ndarray:
        one = np.zeros((len(x), len(model.weights)))
        np.put_along_axis(one, model.bins(x), 1, axis=1)
        one[:, -4:-1], one[:, -1] = model.standard(x), 1
        return one

    xp, xu = rows(p), rows(u)

    def bracket(w: np.ndarray) -> float:
        return np.logaddexp(0, xu @ w).mean() - prior * np.logaddexp(0, xp @ w).mean()

    def risk(w: np.ndarray) -> float:
        return prior * np.logaddexp(0, -xp @ w).mean() + max(0, bracket(w)) + quality.DECAY / 2 * (w * w).sum()

    w = np.zeros(len(model.weights))
    for _ in range(100):
        s = 1 / (1 + np.exp(-(xu @ w)))
        g = xu.T @ s / len(xu) - prior * xp.mean(axis=0) + quality.DECAY * w
        step = np.linalg.solve((xu * (s * (1 - s))[:, None]).T @ xu / len(xu) + quality.DECAY * np.eye(len(w)), g)
        size = 1.0
        while risk(w - size * step) > risk(w) and size > 1e-6:
            size /= 2
        w = w - size * step
    assert bracket(w) > 0.01 and abs(g).max() < 1e-6
    assert risk(w) - 1e-9 <= risk(model.weights) < risk(w) + 1e-3


def test_quality_is_told_from_positives_alone():
    """The fitted scores against the labels that fitting never saw."""
    rng = np.random.default_rng(4)
    x, y = rng.normal(0, 1, (3000, 3)), np.ones(3000, int)
    x[2000:] += 2.5
    y[2000:] = 0
    model = quality.fit(x[:1000], x[1000:], 0.5)
    s = model.score(x)
    order = np.argsort(-s)
    auc = 1 - (np.cumsum(y[order] == 0)[y[order] == 1]).sum() / (2000 * 1000)
    assert auc > 0.98 and (s[y == 1] > 0.5).mean() > 0.9 and (s[y == 0] < 0.5).mean() > 0.9


def test_bit_sliced_links_are_exact():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 120).astype(np.uint64)) for _ in range(4))]))
    for radius in (1, 2, 4):
        near = np.bitwise_count(fps[:, None] ^ fps[None]) <= radius
        root = np.arange(len(fps))
        while True:
            new = np.array([root[row].min() for row in near])
            if (new == root).all():
                break
            root = new
        for tile in (4096, 50):
            got = dict(simhash.links(fps, radius, tile=tile))
            assert [got.get(int(x), int(x)) for x in fps] == fps[root].tolist()


def test_near_duplicates(spark, docs):
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert {(1, 1), (42, 1), (40, 40), (41, 40)} <= got
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0 != simhash.fingerprint("one")
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 30)], "a long, b long")
    assert {r["root"] for r in simhash.components(chain).collect()} == {1}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_are_those_of_brute_force(spark):
    """Fingerprints by plain counting, links by all pairs, whatever the split of large meetings."""
    import xxhash

    rng = np.random.default_rng(7)
    texts = [None, "", " \t", "one", "One Two", "a b c"]
    for i in range(12):
        w = [f"v{x}" for x in rng.integers(0, 60, 150)]
        texts += [" ".join(w), " ".join(w[:70] + ["x"] + w[71:]), " ".join(w[:-1]).upper()]

    def print_of(text):
        w = (text or "").lower().split()
        grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        ones = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
        return sum(1 << b for b in range(64) if grams and 2 * ones[b] > len(grams))

    prints = [print_of(x) for x in texts]
    flips = [prints[6] ^ (1 << int(b)) for b in rng.integers(0, 64, 9)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    df = spark.createDataFrame([(i, x, 1, 2) for i, x in enumerate(texts)], "doc_id long, text string, fp int, node int")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id").collect()}
    assert got == {i: (f"{prints[i]:016x}", root[i]) for i in range(len(texts))}
    fps = sorted({int(np.uint64(x).view(np.int64)) for x in prints + flips})
    nodes = spark.createDataFrame([(x,) for x in fps], "fp long")
    pairs = {tuple(sorted((int(x), int(y)))) for x in fps for y in fps if x != y and ((x ^ y) & (2**64 - 1)).bit_count() <= 2}
    want = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(list(pairs), "a long, b long")).collect()}
    for tile in (8192, 2):
        assert {r["node"]: r["root"] for r in simhash.components(simhash.candidates(nodes, 2, tile)).collect()} == want


def test_rules(spark, docs):
    repeated = "a b c d " + "x y z " * 2 + " ".join(f"w{i}" for i in range(60))
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100, repeated), (101, "same\nsame\n\n \nsame\nother"), (102, "#a* b$")], "doc_id long, text string"))
    got = rules.judge(df).toPandas().set_index("doc_id")
    assert got.loc[100, "n_repeat_words"] == 6 and got.loc[101, "n_dup_lines"] == 2 and got.loc[102, "n_symbols"] == 3
    assert got.loc[43, "n_repeat_words"] == 9000 and got.loc[43, "base_failed"] and not got.loc[40, "kept"] and got.loc[3, "kept"]
    assert rules.judge(df.limit(0)).count() == 0


def test_crc_digest(spark):
    got = spark.createDataFrame([(bytearray(b"abc"),)], "ids binary").select(binary.crc32_of("ids")).first()[0]
    assert got == zlib.crc32(b"abc")


def test_pipeline_keeps_one_of_each_group(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, sentence(i, 90), "en", f"s{i % 3}", 1) for i in range(60)] + [(100, sentence(7, 90), "en", "s0", 1), (101, "12345 67890", "en", "s0", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert 100 not in set(got["doc_id"]) and 101 not in set(got["doc_id"]) and len(set(got["doc_id"])) > 50
    assert got.groupby("sequence_id")["length"].sum().max() <= packing.SIZE


def test_near_duplicates_stage_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    a, b, c, d = (sentence(i, 90) for i in range(4))
    rows = [(None, a), (5, b), (5, b), (None, b), (7, b), (None, c), (None, c), (8, d), (8, d + " more"), (8, a.upper())]
    docs = spark.createDataFrame([(k, x, "en", "s", 1) for k, x in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [tuple(r) for r in corpus_pipeline.one_of_each(spark, docs, "").select("doc_id", "text").collect()]
    assert sorted(got, key=str) == sorted([(8, a.upper()), (5, b), (None, c), (8, got_d := next(x for k, x in got if k == 8 and x.startswith(d)))], key=str)
    assert got_d in (d, d + " more")


def test_ids_of_many_documents_are_counted_together(monkeypatch):
    """Each count fills a row as long as the vocabulary, which took longer than the ids of a document."""
    r = np.random.default_rng(3)
    held = [r.integers(0, 500, r.integers(0, 40)).astype("<u2").tobytes() for _ in range(1000)]
    calls, plain = [], np.bincount
    monkeypatch.setattr(binary.np, "bincount", lambda *a, **k: calls.append(1) or plain(*a, **k))
    found = binary.counted(held, 500, 2)
    assert len(calls) <= 1 + 1000 // binary.TOGETHER
    assert found.tolist() == plain(np.frombuffer(b"".join(held), "<u2"), minlength=500).tolist()
    assert binary.counted([], 5, 4).tolist() == [0] * 5
