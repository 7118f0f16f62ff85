"""The stages of the corpus pipeline, each against what its operator says of its own input."""

import zlib

import corpus_pipeline as pipeline
import numpy as np
from pyspark.sql import functions as F

from weftline.llm import quality
from weftline.llm.common import read_table
from weftline.llm.simhash import near_texts
from test_sequences import _plain, check_pieces, words
from test_texts import without_later_windows


def test_stages(spark, sf, tmp_path):
    docs = read_table(spark, sf, "documents")
    found = [docs]
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, found[-1], sf).write.parquet(f"{tmp_path}/{i}")
        found.append(spark.read.parquet(f"{tmp_path}/{i}"))
    raw, good, deduped, single, mixed, packed = found
    assert all(f.columns == docs.columns for f in found[:-1])
    assert all(r.n_chars == len(r.text) for f in (good, deduped, mixed) for r in f.collect())
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.quality(raw).where("kept").collect()}
    texts = sorted((r.doc_id, r.text) for r in good.collect())
    assert [r.text for r in deduped.orderBy("doc_id").collect()] == without_later_windows([t for _, t in texts])
    assert sorted(r.doc_id for r in single.collect()) == sorted({r.component_id for r in near_texts(deduped).collect()})
    sizes = {r.doc_id: len(words(r.text)) for r in single.collect()}
    taken = dict.fromkeys(sizes, 0)
    for r in mixed.collect():
        taken[r.doc_id] += len(words(r.text))
    assert all(taken[i] <= 2 * sizes[i] for i in sizes) and 1.4 * sum(sizes.values()) < sum(taken.values()) < 1.6 * sum(sizes.values())
    rows = mixed.collect()
    tokens = [[*_plain().encode(r.text, add_special_tokens=False).ids, 1] for r in rows]
    expected = sorted((r.doc_id, at, len(own := t[at : at + 2048]), zlib.crc32(np.array(own, "<u4").tobytes()), len(t)) for r, t in zip(rows, tokens, strict=True) for at in range(0, len(t), 2048))
    piece = lambda f: sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in f.collect())
    assert piece(packed) == expected
    assert piece(pipeline.run(spark, sf)) == expected  # the stages in one go come to the same


def test_packing_of_mixed_documents(spark, sf, tmp_path):
    mixed = pipeline.mixing(spark, read_table(spark, sf, "documents"), sf)
    mixed.withColumn("doc_id", F.monotonically_increasing_id()).write.parquet(f"{tmp_path}/m")  # each row a name of its own
    docs = spark.read.parquet(f"{tmp_path}/m")
    assert check_pieces({r.doc_id: r.text for r in docs.collect()}, pipeline.packing(spark, docs, sf).collect()) < 0.02


def test_stages_on_odd_and_empty_tables(spark, sf, tmp_path, odd_documents, no_documents):
    clean = odd_documents.where("doc_id = 7").withColumns({"doc_id": F.lit(50).cast("long"), "text": F.lit(" ".join(f"word{i}" for i in range(40)))})
    odd_documents = odd_documents.unionByName(clean).unionByName(clean.withColumn("doc_id", F.lit(None).cast("long")))
    for k, docs in enumerate((odd_documents, odd_documents.withColumnRenamed("n_chars", "N_Chars"), no_documents)):
        found = docs
        for i, (_, stage) in enumerate(pipeline.STAGES):
            stage(spark, found, sf).write.parquet(f"{tmp_path}/{k}-{i}")
            after = spark.read.parquet(f"{tmp_path}/{k}-{i}")
            if i < len(pipeline.STAGES) - 1:
                assert after.columns == docs.columns and after.where("text IS NOT NULL AND n_chars <> length(text)").count() == 0
                assert [f.dataType for f in after.schema] == [f.dataType for f in docs.schema]
            found = after
        for i, (_, stage) in enumerate(pipeline.STAGES):  # each on the odd table itself
            rows = stage(spark, docs, sf).count()
            assert rows == 0 if k == 2 else rows > 0


def test_registration():
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is pipeline.run and "pipeline" not in entry.oracle_sql()
    assert 4 <= len(pipeline.STAGES) <= 5
