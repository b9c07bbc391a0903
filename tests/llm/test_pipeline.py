"""The pipeline against a brute-force version of its decisions."""

import corpus_pipeline
from newsflow.llm import byte_bpe, decontamination, quality_rules, secret_scans
from tests.llm.test_operators import jaccard_groups

D = "/root/testdata/sf0.001"


def test_run(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    kept = {r.doc_id: r.cleaned_text for r in quality_rules.clean_lines(docs).collect() if r.kept}
    root = jaccard_groups(kept)
    kept = {k: t for k, t in kept.items() if root[k] == k}
    df = spark.createDataFrame(list(kept.items()), "doc_id long, text string")
    leaked = {r.doc_id for r in decontamination.leaks(df, spark.read.parquet(f"{D}/benchmark.parquet")).collect()}
    kept = {k: t for k, t in kept.items() if k not in leaked}
    found = {r.doc_id: r.spans for r in secret_scans.scan(df).collect()}
    for k, t in kept.items():
        out, at = "", 0
        for s in found[k]:
            if s.start >= at:
                out += t[at : s.start] + f"[{secret_scans.KINDS[s.rank]}]"
            at = max(at, s.end)
        kept[k] = out + t[at:]
    bpe = byte_bpe.codec(*byte_bpe.public_vocabulary())
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, D).collect()}
    assert {k: list(r.ids) for k, r in got.items()} == dict(zip(kept, bpe.encode_many(list(kept.values())), strict=True))
    assert all(r.intact and r.n_tokens == len(r.ids) for r in got.values())


def test_awkward_rows_pass(spark):
    rows = [(None, None, "en", "s", None), (1, "", "en", "s", 0), (2, "some words " * 3, None, None, 5), (2, "some words " * 3, None, None, 5)]
    rows += [(k, "A clean sentence with quite enough different words to be kept here today, and nothing else.", "en", "s", 9) for k in (5, 5, 7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as kept", "'x' as _key", "2 as fp")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("false"), D).count() == 0
        out = stage(spark, docs, D)
        assert out.columns == docs.columns
        docs = out.checkpoint()
    assert [(r.doc_id, r.kept) for r in docs.collect()] == [(5, 1)]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, D).count() == 1
