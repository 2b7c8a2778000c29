"""The pipeline's stages in turn, each compared with a brute-force version on its own input."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from peerlens.llm import decontamination
from peerlens.llm.common import write_scratch

from .test_operators import WORD, brute_components, edit_distance_within

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs = write_scratch(stage(spark, docs, SF), name)
        out.append(docs)
    return [(d.columns, d.collect()) for d in out]


def test_columns_and_registration(stages):
    assert all(columns == stages[0][0] for columns, _ in stages[:-1])
    assert stages[-1][0] == [*stages[0][0], "shard", "slot"]
    assert entry.queries()["pipeline"] is corpus_pipeline.run


def test_language_stage_keeps_what_has_letters(stages):
    before, after = (Counter(r.doc_id for r in rows) for _, rows in stages[:2])
    lettered = {r.doc_id for r in stages[0][1] if any(c.isalpha() for c in r.text or "")}
    assert set(after) <= lettered and len(after) >= 0.97 * len(lettered) and not after - before


def test_one_of_each_component_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1][1]]
    want = {i for i, (_, root) in brute_components(rows).items() if i == root}
    assert {r.doc_id for r in stages[2][1]} == want and len(stages[2][1]) == len(want) < len(rows)


def test_contaminated_documents_go(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    exact = {r.doc_id for r in stages[2][1] if any(t.lower() in r.text.lower() for _, t in items)}
    gone = {r.doc_id for r in stages[2][1]} - {r.doc_id for r in stages[3][1]}
    assert exact <= gone
    index = decontamination.PassageIndex.build(items)
    fold = lambda t: decontamination._FOLD[np.frombuffer(t.encode(), np.uint8)].tobytes()
    for r in stages[2][1]:
        if r.doc_id in gone - exact:
            text = fold(r.text)
            assert any(edit_distance_within(p.tobytes(), text) <= k for p, k in zip(index.text, index.budget))


def test_mixing_and_sharding(stages):
    before, mixed = stages[3][1], stages[4][1]
    copies = Counter(r.doc_id for r in mixed)
    assert set(copies) <= {r.doc_id for r in before} and max(copies.values()) <= 3
    words = {r.doc_id: len(WORD.findall(r.text)) for r in before}
    total, got = sum(words.values()), sum(words[r.doc_id] for r in mixed)
    # Targets add up to all words unless every source is at its limit.
    assert abs(got - total) < 0.1 * total
    slots = {}
    for r in stages[5][1]:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter(r.doc_id for r in stages[5][1]) == copies


def test_python_workers_get_batches_of_bounded_bytes(spark, monkeypatch):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(spark, docs, sf_dir):
        wide = docs.select(F.repeat(F.lit("x"), 1 << 16).alias("text"))
        return wide.mapInArrow(lambda batches: (pa.record_batch([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("sizes", sizes), ("all", lambda spark, docs, sf_dir: docs)])
    before = spark.conf.get(limit, None)
    got = [r.n for r in corpus_pipeline.run(spark, SF).collect()]
    assert sum(got) >= 3 * corpus_pipeline.BATCH_BYTES and max(got) <= corpus_pipeline.BATCH_BYTES + (1 << 17)
    assert spark.conf.get(limit, None) == before


def test_common_grams_of_a_benchmark_take_bounded_memory():
    """Every item ends with one common passage; a text that repeats it hits all items everywhere."""
    rng = np.random.default_rng(5)
    common = "all items of this benchmark end with these very same words"
    items = [(i, "".join(map(chr, rng.integers(97, 123, 200))) + common) for i in range(300)]
    index = decontamination.PassageIndex.build(items)
    noise = ["".join(map(chr, rng.integers(65, 91, 3000))) for _ in range(40)]
    texts = [x[:1500] + common[:30] + x[1500:] for x in noise] + [items[7][1]]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    tracemalloc.start()
    found = decontamination.find_passages(index, data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 7 in [h[0] for h in found[-1]]
    assert peak < 64 << 20


def test_a_lonely_gram_of_an_item_leaves_a_document_alone(spark):
    """All that is searched at once shares eight bytes with an item, too few for any passage."""
    item = "".join(map(chr, np.random.default_rng(6).integers(97, 123, 200)))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, "ZZ" + item[50:58] + "ZZ"), (2, item[50:58] + " and " + item[90:98]), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    assert {r.doc_id for r in decontamination.decontaminate(docs, bench).collect()} == {1, 2, 3}
