"""Each pipeline stage on odd rows, against plain versions."""

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and river stone quiet garden window mountain paper letter music winter".split()


def sentence(seed: int, n: int = 60) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n)) + f" end{seed}."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)] + [(None, 1, 0), (1, None, 0), (7777, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, sentence(i, 90), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100, None, None, None, None), (101, "", "en", "s0", 0), (None, sentence(200, 90), None, None, 1), (102, "!!! ??? 12345", "en", "s0", 1), (103, sentence(9, 4000), "en", "s1", 1)]
    rows += [(7, sentence(7, 90), "en", "s1", 1)] * 2 + [(104, sentence(8, 90).upper(), "en", "s2", 1)]
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS n", "'y' AS row", "1 AS node", "2 AS task", "3 AS part").repartition(3)


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()), key=str)


def test_language_keeps_what_has_letters(spark, docs, folder):
    import corpus_pipeline

    got = corpus_pipeline.language(spark, docs, folder)
    assert got.columns == list(corpus_pipeline.COLUMNS)
    assert rows(got) == [r for r in rows(docs) if r[0] not in (100, 101, 102)]
    assert corpus_pipeline.language(spark, docs.limit(0), folder).count() == 0


def test_quality_judges_each_row_by_its_text(spark, docs, folder):
    import corpus_pipeline
    from citegrain.llm import quality
    from pyspark.sql import functions as F

    got = corpus_pipeline.good_quality(spark, docs, folder)
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"), training=F.lit(True))
    want = [r for r in rows(docs) if model.score(np.array([quality.measures(r[1])]))[0] >= corpus_pipeline.GOOD]
    assert rows(got) == want and len(want) > 50 and got.columns == list(corpus_pipeline.COLUMNS)
    assert corpus_pipeline.good_quality(spark, docs.limit(0), folder).count() == 0


def test_near_duplicates_keeps_one_row_of_each_group(spark, docs, folder):
    import corpus_pipeline

    got = corpus_pipeline.one_of_each(spark, docs, folder)
    kept = rows(got)
    assert got.columns == list(corpus_pipeline.COLUMNS) and len(kept) == len({(r[1] or "").lower() for r in kept})
    assert [r[0] for r in kept].count(7) == 1 and 104 not in [r[0] for r in kept] and (100 in [r[0] for r in kept]) != (101 in [r[0] for r in kept])
    assert set((r[1] or "").lower() for r in rows(docs)) == {(r[1] or "").lower() for r in kept}  # sentences are apart
    assert corpus_pipeline.one_of_each(spark, docs.limit(0), folder).count() == 0


def test_mixture_takes_whole_epochs_or_parts(spark, docs, folder):
    import corpus_pipeline

    got, all_ = rows(corpus_pipeline.mixture(spark, docs, folder)), rows(docs)
    assert set(got) <= set(all_) and not [r for r in got if not (r[1] or "").split()]
    times = lambda data: {s: sum(len(r[1].split()) for r in data if r[3] == s and r[1]) for s in ("s0", "s1", "s2", None)}
    assert abs(sum(times(got).values()) - sum(times(all_).values())) <= 4001  # the budget, up to a document
    assert corpus_pipeline.mixture(spark, docs.limit(0), folder).count() == 0


def test_packed_holds_every_token_once(spark, docs, folder):
    import zlib

    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = corpus_pipeline.packed(spark, docs, folder).toPandas()
    want = []
    for r in rows(docs):
        ids = tool.encode(r[1] or "", add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % 2048 + 1
        for p, (i, j) in enumerate([(0, first), *((k, k + 2048) for k in range(first, len(ids), 2048))]):
            want.append((-1 if r[0] is None else r[0], p, i, j - i, zlib.crc32(np.array(ids[i:j], "<u4").tobytes())))
    assert sorted(zip(got["doc_id"].fillna(-1).astype(int), got["piece"], got["start"], got["length"], got["ids_crc32"])) == sorted(want)
    s = got.sort_values(["sequence_id", "offset"])
    assert (s["offset"] == s.groupby("sequence_id")["length"].cumsum() - s["length"]).all() and s.groupby("sequence_id")["length"].sum().max() <= 2048
    assert corpus_pipeline.packed(spark, docs.limit(0), folder).count() == 0
