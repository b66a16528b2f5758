"""The pipeline against its operators said in plain Python."""

import re
import zlib
from array import array
from collections import Counter

import corpus_pipeline
from barlight.llm import mixing, ngram_join, packing, pii, quality

from .conftest import DOCS, rows
from .test_operators import frame, linked


def test_stages_keep_the_columns_and_run_agrees_with_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        seen[name] = frame(docs)
        if name != "pack":
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    source = frame(spark.read.parquet(f"{sf}/documents.parquet"))
    verdict = quality.learn(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    import numpy as np

    stats = np.array([quality.stats_of(t) for t in source.text])
    good = source[~quality.base_failed(stats[:, 0], stats[:, 4]) & verdict.keep(stats)]
    assert set(seen["quality_rules"].doc_id) == set(good.doc_id)
    roots = linked([(r.doc_id, r.text, r.source) for r in good.itertuples()])
    assert sorted(seen["near_duplicates"].doc_id) == sorted({c for _, c in roots.values()})
    weights, texts = pii.train(), dict(zip(source.doc_id, source.text, strict=True))
    masked = {r.doc_id: r.text for r in seen["personal_data"].itertuples()}
    assert masked == {i: pii.masked(texts[i], weights) for i in set(seen["near_duplicates"].doc_id)}
    assert all(r.n_chars == len(r.text) for r in seen["personal_data"].itertuples())
    mixed = seen["mix_sources"]
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    before, after = (sum(map(words, x.text)) for x in (seen["personal_data"], mixed))
    assert abs(before - after) < 0.05 * before
    assert max(Counter(mixed.doc_id).values()) <= 3
    enc = packing.Encoder(packing.default_vocabulary())
    want = Counter()
    for i, ids in zip(mixed.doc_id, enc.encode(mixed.text.tolist()), strict=True):
        ids += array("I", [1]).tobytes()
        for k in range(0, len(ids), 4 * 4096):
            want[(i, k // (4 * 4096), zlib.crc32(ids[k : k + 4 * 4096]))] += 1
    packed = seen["pack"]
    assert Counter(zip(packed.doc_id, packed.piece, packed.ids_crc32, strict=True)) == want
    assert packed.sequence_id.nunique() <= -(-packed.length.sum() // 4096) + 1
    run = frame(corpus_pipeline.run(spark, sf))
    assert Counter(zip(run.doc_id, run.piece, run.ids_crc32, strict=True)) == want


LABELS = "doc_id long, quality int, toxic int"


def test_stages_on_odd_rows(spark, odd, documents):
    """Nulls in every column, repeated rows, clashing further columns: each stage keeps what its docstring says."""
    labels = spark.createDataFrame([(None, 1, 0), (20, None, 0)], LABELS)
    docs = documents([*odd, (None, None, None), (None, "", "a")])
    want = rows([*odd, (None, None, None), (None, "", "a")])
    failed = lambda t: (n := quality.stats_of(t))[0] < 10 or 100 * n[4] > 20 * n[0]
    kept = quality.keep(docs, labels)
    assert Counter(map(tuple, kept.collect())) == Counter(r for r in want if not failed(r[1]))
    assert kept.columns == docs.columns
    some = ngram_join.representatives(docs)
    assert some.columns == docs.columns
    roots = linked([r[:2] + (None,) for r in {(r[0], r[1]): r for r in want if r[0] is not None}.values()])
    assert {r.doc_id for r in some.collect()} == {c for _, c in roots.values()} | {None}
    assert sum(r.doc_id is None and not (r.text or "").split() for r in some.collect()) == 2
    masked, weights = pii.mask(docs), pii.train()
    assert Counter(map(tuple, masked.collect())) == Counter((r[0], pii.masked(r[1], weights), *r[2:]) for r in want)
    mixed = Counter(map(tuple, mixing.repeated(docs).collect()))
    assert set(mixed) <= set(want)
    assert all(n <= 3 * Counter(want)[r] for r, n in mixed.items())
    packed = frame(packing.pack(docs))
    enc = packing.Encoder(packing.default_vocabulary())
    assert packed.length.sum() == sum(len(ids) // 4 + 1 for ids in enc.encode([r[1] or "" for r in want]))


def test_run_on_odd_and_empty_tables(spark, odd, tmp_path):
    spark.createDataFrame([(7, 1, 0)], LABELS).write.parquet(f"{tmp_path}/odd/labels.parquet")
    spark.createDataFrame(rows(odd), DOCS).write.parquet(f"{tmp_path}/odd/documents.parquet")
    out = frame(corpus_pipeline.run(spark, f"{tmp_path}/odd"))
    assert len(out) > 10
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/none/labels.parquet")
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
