"""The pipeline's stages against plain versions, on a table of awkward rows."""

from collections import Counter

import numpy as np
import pytest

pytest.importorskip("wearstream.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tests.llm import brute  # noqa: E402
from wearstream.llm import tokens  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, id long, gone boolean"
RNG = np.random.default_rng(5)


def prose(n):
    return " ".join(f"w{x}" for x in RNG.integers(0, 10**5, n))


def rows_of(texts):
    return [(i, t, "en", f"s{(i or 0) % 3}" if (i or 0) % 7 else None, len(t or ""), "x", 1, True) for i, t in texts]


BASE = [prose(60) for _ in range(8)]
PASSAGE = prose(20)
TEXTS = [(i, t) for i, t in enumerate(BASE)]
TEXTS += [(20, BASE[0]), (21, BASE[1] + " end"), (21, BASE[1] + " end"), (2, BASE[2]), (3, prose(50)), (22, BASE[3].upper())]
TEXTS += [(30, f"{prose(9)}\n\n{PASSAGE}\n\tcode  {prose(9)}\n"), (31, f"\n {prose(9)} {PASSAGE}\n"), (32, PASSAGE), (33, None), (34, ""), (34, ""), (35, " \n"), (None, BASE[4]), (36, prose(3000))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(TEXTS), COLUMNS).repartition(4).persist()


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows_of(TEXTS), COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 30), 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_quality_keeps_what_the_classifier_accepts(spark, docs, sf_dir):
    kept = corpus_pipeline.quality(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    from wearstream.llm.quality_model import score_quality

    scored = score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)
    assert kept.count() == scored.where("predicted = 1").count()
    assert corpus_pipeline.quality(spark, docs.where("false"), sf_dir).count() == 0


def test_near_duplicates_keeps_one_of_each_group(spark, docs, sf_dir):
    kept = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    gone = {(20, BASE[0]), (21, BASE[1] + " end"), (22, BASE[3].upper())}
    want = [(i, t) for i, t in TEXTS if (i, t) not in gone]
    want.remove((2, BASE[2]))  # one of two equal rows; id 3's other text stays, as do wordless rows and null ids
    assert pairs(kept) == sorted(want, key=str)
    alone = {i: c for i, (_, c) in brute.jaccard_components([(i, t) for i, t in TEXTS if i not in (None, 2, 3, 21, 22)], 5, 80).items()}
    assert {i for i, _ in pairs(kept)} - {None, 2, 3} == {i for i, c in alone.items() if i == c}
    assert corpus_pipeline.near_duplicates(spark, docs.where("false"), sf_dir).count() == 0


def test_passages_cuts_repeats_and_keeps_the_layout(spark, docs, sf_dir):
    some = [(i, t) for i, t in TEXTS if i is not None and (i >= 30 or i in (5, 6))]
    got = corpus_pipeline.passages(spark, spark.createDataFrame(rows_of(some), COLUMNS), sf_dir)
    assert got.columns == docs.columns
    plain = brute.repeats_removed([(i, t) for i, t in some if i != 34])
    found = {r.doc_id: r for r in got.collect()}
    assert set(found) == {i for i, (n, cut, _) in plain.items() if not n or cut < n} | {34}
    for i, t in some:
        if i in found and i in plain:
            assert len((found[i].text or "").split()) == plain[i][0] - plain[i][1] and found[i].n_chars == len(found[i].text or "")
            if not plain[i][1]:
                assert found[i].text == t
    assert found[31].text == some[[i for i, _ in some].index(31)][1].replace(PASSAGE + "\n", "")
    assert corpus_pipeline.passages(spark, docs.where("false"), sf_dir).count() == 0


def test_mixture_keeps_all_rows_and_columns(spark, docs, sf_dir):
    got = corpus_pipeline.mixture(spark, docs, sf_dir)
    assert got.columns == [*docs.columns, "mix_slot", "mix_place"] and pairs(got) == sorted(((i, t) for i, t in TEXTS), key=str)
    assert corpus_pipeline.mixture(spark, docs.where("false"), sf_dir).count() == 0


def test_packing_follows_the_mixture(spark, sf_dir):
    texts = [(i, prose(40)) for i in range(400)]
    docs = corpus_pipeline.mixture(spark, spark.createDataFrame(rows_of(texts), COLUMNS), sf_dir)
    docs.repartition(7).write.mode("overwrite").parquet(f"{sf_dir}/mixed")
    mixed = spark.read.parquet(f"{sf_dir}/mixed")
    place = {r.doc_id: (r.mix_slot, r.mix_place) for r in mixed.collect()}
    pieces = corpus_pipeline.packed(spark, mixed, sf_dir).collect()
    tasks: dict = {}
    for p in pieces:
        tasks.setdefault(p.sequence_id >> 32, []).append(place[p.doc_id])
    spans = [(min(x), max(x)) for _, x in sorted(tasks.items())]
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) and len({p.doc_id for p in pieces}) == 400


def test_run_passes_every_stage(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "passages", "mixture", "packing"]
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    left = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = corpus_pipeline.written(stage(spark, left, sf_dir), f"again-{name}")
    rows = [(r.doc_id, r.text) for r in left.collect()]
    assert 0 < len(rows) < len(TEXTS)
    assert Counter(p.doc_id for p in pieces if p.start == 0) == Counter(i for i, _ in rows)  # what four stages keep is packed
    encoder = tokens.Encoder()
    assert sum(p.length for p in pieces) == sum(encoder.count(t or "") + 1 for _, t in rows)
    filled = Counter()
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == filled[p.sequence_id]
        filled[p.sequence_id] += p.length
    assert max(filled.values()) <= 2048
