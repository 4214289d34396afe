"""What the join of near-duplicates and the pipeline's tables leave or send, as texts come to share more."""

import os
import time
from urllib.parse import urlparse

import numpy as np
import pytest

pytest.importorskip("wearstream.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tests.llm import brute  # noqa: E402
from wearstream.llm import common, jaccard_join  # noqa: E402

RNG = np.random.default_rng(11)
PASSAGES = [[f"p{i}_{j}" for j in range(40)] for i in range(3)]


def prose(n):
    return [f"w{x}" for x in RNG.integers(0, 10**7, n)]


@pytest.fixture
def tables(monkeypatch):
    """What jaccard_join writes: names and tables."""
    out = []

    def kept(df, name):
        out.append((name, common.written(df, name)))
        return out[-1][1]

    monkeypatch.setattr(jaccard_join, "written", kept)
    return out


def test_passages_in_common_make_no_large_block(spark, tables):
    texts = [prose(60) + PASSAGES[i % 3][:20] + prose(60) for i in range(900)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(1000 + i, " ".join([*t, "end"])) for i, t in enumerate(texts[:40])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard_join.jaccard_groups(docs).collect()}
    assert got == {i: (i % 1000, int(i % 1000 < 40)) for i, _ in rows}
    assert dict(tables)["dealt"].groupBy("block").count().agg({"count": "max"}).first()[0] <= 20


def test_tiles_of_a_large_block_take_turns(spark, tables):
    text = prose(200)
    rows = [(i, " ".join([*text[:i], f"x{i}", *text[i + 1 :]])) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id: (r.component_id, r.n_links) for r in jaccard_join.jaccard_groups(docs).collect()}
    assert want[29] == (0, 29) and [n for n, _ in tables].count("links") == 1
    tables.clear()
    assert {r.doc_id: (r.component_id, r.n_links) for r in jaccard_join.jaccard_groups(docs, tile=5, round_sets=1).collect()} == want
    assert [n for n, _ in tables].count("links") > 3
    assert not os.path.exists(os.path.dirname(urlparse(dict(tables)["links"].inputFiles()[0]).path).replace("links", "block-texts"))


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_meet_whatever_is_frequent(percent):
    for n in (1, 2, 5, 9, 20, 60, 200):
        for share in (0.0, 0.3, 0.8, 1.0):
            for _ in range(20):
                a = np.unique(RNG.integers(0, 1 << 63, n).astype(np.uint64))
                most = jaccard_join.unlike(len(a), percent)
                lost, new = (most // 2, most - most // 2) if len(a) > 1 else (0, 0)
                b = np.unique(np.r_[a[lost:], RNG.integers(0, 1 << 63, new).astype(np.uint64)])
                if 100 * (len(a) - lost) < percent * (len(a) + new):
                    continue
                both = np.union1d(a, b)
                frequent = common.Held(both[RNG.random(len(both)) < share])
                x, y = (jaccard_join.signatures(s, percent, frequent) for s in (a, b))
                c = jaccard_join.class_of(min(len(a), len(b)))
                assert len(np.intersect1d(x[c], y[c]))


@pytest.mark.parametrize("size,percent", [(5, 80), (1, 60)])
def test_groups_are_the_same_whatever_is_frequent(spark, size, percent):
    texts = [prose(8) + PASSAGES[i % 3] * (i % 4) for i in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(100 + i, " ".join([*t, "end"])) for i, t in enumerate(texts[:30])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(docs, size=size, percent=percent, one_in=1, least=2).collect()}
    assert got == brute.jaccard_components(rows, size, percent)


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {blocks.apply(i).getName() for i in range(blocks.size()) if blocks.apply(i).getName().startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(common.FILES_GO)
    table = common.written(spark.range(1000).groupBy("id").count(), "counts")
    assert spark.conf.get(common.FILES_GO) == setting
    for _ in range(25):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    assert not left and table.count() == 1000


def test_only_the_last_stage_is_left(spark, tmp_path, monkeypatch):
    spark.range(5).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(str(i), lambda s, d, _, i=i: seen.append(d) or d) for i in range(3)])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 5
    there = [os.path.exists(urlparse(d.inputFiles()[0]).path) for d in seen]
    assert there == [True, False, False]
