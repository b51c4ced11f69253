"""Sort-means, the content-addressed archive and phrase collocations against plain versions, on odd rows too."""

import gzip
import hashlib
import math
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from citegrain.llm import collocations, sortmeans, warc

# --- sort-means ------------------------------------------------------------------------------------------------------------


def plain_means(rows, k=8, rounds=10, dim=64):
    kept = [(i, [math.floor(1024 * x) for x in map(float, v)]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((square(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        of = assign()
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, of) if c == j]
            centroids[j] = [sum(x) // len(mine) for x in zip(*mine)] if mine else centroids[j]
    of = assign()
    inertia = Counter()
    for d, c in of:
        inertia[c] += d
    fit = lambda n: n if n < 2**63 else None
    return [(i, c, fit(d), fit(inertia[c]), fit(sum(inertia.values())), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, of)]


def vectors(n, seed=0, dim=64):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in rng.normal(i % 5, 0.5, dim)]) for i in range(n)]


ODD = [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 63 + [None]), (904, [math.nan] + [0.0] * 63), (905, [math.inf] + [0.0] * 63), (None, [0.25] * 64), (3, [0.5] * 64), (3, [0.5] * 64), (906, [-0.0001] * 64)]
HUGE = [(907, [1e30] * 64), (908, [-2e12] + [1.5] * 63)]


@pytest.mark.parametrize("rows", [[], vectors(3), [(i, [0.1] * 64) for i in range(20)], vectors(120) + ODD, vectors(40) + ODD + HUGE], ids=["none", "few", "equal", "odd", "huge"])
def test_sort_means_is_exact(spark, rows):
    table = [(i, v, "x", 7, 1.0) for i, v in rows]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, cluster string, distance int, keys double").repartition(3)
    want = plain_means([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    assert sorted(map(tuple, sortmeans.cluster(df).collect()), key=str) == sorted(want, key=str)


def test_scan_stops_only_strictly_beyond():
    centroids = np.array([[0, 0], [4, 0], [0, 40], [2, 0]])
    x = np.array([[2, 0], [3, 0], [1, 0], [0, 20], [0, 0]])
    for start in range(4):
        cluster, square = sortmeans.nearest(x, np.full(len(x), start, np.int32), centroids)
        assert cluster.tolist() == [3, 1, 0, 0, 0] and square.tolist() == [0, 1, 1, 400, 0]


def test_digits_add_up():
    for v in (0, -1, 2**32, -(2**32), 2**31 - 5, -(2**90) + 17, 3**80):
        d = sortmeans.digits(v)
        assert sum(x << (32 * i) for i, x in enumerate(d)) == v and all(abs(x) <= 2**32 for x in d)


# --- archive ---------------------------------------------------------------------------------------------------------------

LONG = "<p>é" + "word " * 300
PAGES = [(1, "http://a/1", LONG), (2, "http://a/2", LONG), (5, "http://a/5", LONG), (5, "http://a/5", LONG), (3, "u\r\nWARC-Type: x", "short"), (4, None, "short"), (6, "u", None), (7, "u", ""), (None, "u", LONG), (8, "u", "WARC/1.1\r\n\r\n" * 90), (9, "u", "z" * 300_000), (10, "u", "z" * 300_000), (None, "v", "only" * 300)]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "archive")
    warc.write(spark.createDataFrame([(*r, "a", 1, b"z") for r in PAGES], "page_id long, url string, html string, digest string, row int, headers binary").repartition(4), path)
    return path


def bytes_of(html):
    return (html or "").encode()


def test_archive_reads_what_was_written(spark, archive):
    got = sorted(map(tuple, warc.read(spark, archive).select("key", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    want, groups = [], defaultdict(list)
    for i, _, h in PAGES:
        groups[bytes_of(h)].append(i)
    for b, ids in groups.items():
        first = max(ids, key=lambda i: -1 if i is None else i)
        for n, i in enumerate(sorted(ids, key=lambda i: -1 if i is None else i, reverse=True)):
            again = n > 0 and len(b) >= 1000
            want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=str)


def test_payloads_are_stored_once(spark, archive):
    rows = spark.read.parquet(f"{archive}/payloads").collect()
    assert sorted(r["payload"] for r in rows) == sorted({bytes_of(h) for _, _, h in PAGES})
    assert all(hashlib.sha256(r["payload"]).hexdigest() == r["digest"] for r in rows)


def test_archive_of_nothing(spark, tmp_path):
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "a"))
    assert warc.read(spark, str(tmp_path / "a")).count() == 0 and warc.restore(spark, str(tmp_path / "a")).count() == 0


def records_of(stream):
    while stream:
        head, _, rest = stream.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines)
        n = int(fields["Content-Length"])
        assert version == "WARC/1.1" and rest[n : n + 4] == b"\r\n\r\n"
        yield fields, rest[:n]
        stream = rest[n + 4 :]


def test_exported_files_are_warc(spark, archive, tmp_path):
    warc.export(spark, archive, str(tmp_path / "out"))
    found = [r for f in Path(tmp_path / "out").glob("*.gz") for r in records_of(gzip.decompress(f.read_bytes()))]
    assert len(found) == len(PAGES)
    ids = {f["WARC-Record-ID"] for f, _ in found}
    assert len(ids) == len(PAGES)
    for fields, block in found:
        head, _, body = block.partition(b"\r\n\r\n")
        assert f"Content-Length: {len(body)}".encode() in head or fields["WARC-Type"] == "revisit" and not body
        if fields["WARC-Type"] == "response":
            assert fields["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(body).hexdigest()
        else:
            assert fields["WARC-Refers-To"] in ids
    assert Counter(b.partition(b"\r\n\r\n")[2] for f, b in found if f["WARC-Type"] == "response")[bytes_of(LONG)] == 1


def test_restored_records_have_their_payload(spark, archive):
    got = warc.restore(spark, archive).collect()
    assert sorted(bytes(r["payload"]) for r in got) == sorted(bytes_of(h) for _, _, h in PAGES)


def test_changed_payload_is_refused(spark, tmp_path):
    path = str(tmp_path / "a")
    warc.write(spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string"), path)
    table = spark.read.parquet(f"{path}/payloads").selectExpr("digest", "sha1", "n", "CAST('abd' AS BINARY) AS payload").collect()
    spark.createDataFrame(table, "digest string, sha1 string, n long, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="does not match"):
        warc.read(spark, path).collect()


# --- phrases ---------------------------------------------------------------------------------------------------------------


def plain_phrases(rows, least, share=100, most=None):
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, total = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for m in range(1, 6):
                counts.update((lang or "und", tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    frequent = {k: a for k, a in counts.items() if a >= least}
    longer = Counter()
    for (g, p), a in frequent.items():
        for i in range(len(p)):
            for j in range(i + 1, len(p) + 1):
                if j - i < len(p):
                    longer[g, p[i:j]] = max(longer[g, p[i:j]], a)
    out = defaultdict(list)
    for (g, p), a in frequent.items():
        if len(p) > 1 and not 100 * longer[g, p] >= share * a:
            score, _, l, r = min((1000 * a * total[g] // (frequent[g, p[:k]] * frequent[g, p[k:]]), k, frequent[g, p[:k]], frequent[g, p[k:]]) for k in range(1, len(p)))
            out[g].append((-score, -a, " ".join(p).encode(), l, r))
    return [(g, i, p.decode(), -a, l, r, total[g], -s) for g, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:most], 1)]


def texts(n):
    rng = np.random.default_rng(5)
    words = "The the of New York city machine learning É é a.b c,d x\x1cy   z! river\tstone river\nstone \x0b tie tied".split(" ")
    rows = [(" ".join(words[i] for i in rng.integers(0, len(words), 50)), ("en", "fr", None)[k % 3]) for k in range(n)]
    return rows + [(None, "en"), ("", "fr"), ("  \t ", None), ("new york " * 5000, "en"), ("deep blue sea, " * 40, "de"), ("deep blue sea, " * 40, "de"), ("...", "xx")]


@pytest.mark.parametrize("share,most", [(100, 2000), (60, 30)])
def test_phrases_are_those_of_brute_force(spark, share, most):
    rows = texts(400)
    df = spark.createDataFrame([(t, g, 1, "p", 0.5) for t, g in rows], "text string, lang string, n int, phrase string, a double").repartition(5)
    got = collocations.mine(df, least=12, share=share, most=most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    want = plain_phrases(rows, 12, share, most)
    assert len(want) > 40 and sorted(map(tuple, got)) == sorted(want)


def test_phrases_of_nothing(spark):
    assert collocations.mine(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert collocations.mine(spark.createDataFrame([(None, None)], "text string, lang string")).count() == 0


def test_scores_pass_64_bits(spark):
    counts = spark.createDataFrame([("en", "a", 1, 4 * 10**15), ("en", "b", 1, 5 * 10**15), ("en", "a b", 2, 3 * 10**15)], "lang string, phrase string, size int, a long")
    totals = spark.createDataFrame([("en", 9 * 10**16)], "lang string, n long")
    assert collocations.scored(counts, totals).first()["score"] == 1000 * 3 * 10**15 * 9 * 10**16 // (4 * 10**15 * 5 * 10**15)


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 50)
    text = "One two, three. " * 30 + "no end " * 30 + "!last"
    whole = text.encode().translate(collocations._TABLE)
    parts = list(collocations.pieces(text))
    assert len(parts) > 5 and b"\n".join(parts) == whole


@pytest.mark.parametrize("bits,held", [(16, 1 << 30), (17, 1000)])
def test_sketches_never_count_too_little(monkeypatch, bits, held):
    monkeypatch.setattr(collocations, "WHOLE", 16)
    monkeypatch.setattr(collocations, "HELD", held)
    rng = np.random.default_rng(1)
    h = collocations._mix(rng.zipf(1.3, 200_000).astype(np.uint64))
    size = min(collocations.BLOCK, 1 << bits)
    total = defaultdict(lambda: np.zeros(size, np.uint8))
    for part in np.array_split(h, 7):
        sketch = collocations.Sketch(bits)
        for some in np.array_split(part, 9):
            sketch.add(some)
            if sketch.full():
                for row, block, data in sketch.blocks():
                    collocations.add_packed(total[row, block], data)
        for row, block, data in sketch.blocks():
            collocations.add_packed(total[row, block], data)
    values, n = np.unique(h, return_counts=True)
    for row, c in enumerate(collocations.cells(values, bits)):
        exact = np.bincount(c, n, 1 << bits)
        got = np.concatenate([total[row, b] for b in range((1 << bits) // size)])
        assert (got == np.minimum(exact, 255)).all() and (got[c] >= np.minimum(n, 255)).all()
