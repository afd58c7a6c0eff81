"""The pipeline's stages against brute force, and its registration."""

import collections

import corpus_pipeline
from corpusmill.llm import decontamination, mixing, packing, quality_rules

from test_documents import SF, fingerprint, grouped, measures, words


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    out = docs
    for _, stage in corpus_pipeline.STAGES[:1]:
        out = stage(spark, out, SF)
    kept = {r.doc_id for r in out.collect()}
    for i, r in rows.items():
        m = measures(r.text)
        if m[0] < 20 or 100 * m[4] > 30 * m[0]:
            assert i not in kept
    assert out.columns == docs.columns
    deduped = corpus_pipeline.near_dedup(spark, out, SF)
    ids = sorted(kept)
    root = grouped([fingerprint(rows[i].text) for i in ids], lambda a, b: (a ^ b).bit_count() <= 2)
    assert {r.doc_id for r in deduped.collect()} == {ids[g] for g in set(root)} and deduped.columns == docs.columns
    clean = corpus_pipeline.decontaminate(spark, deduped, SF)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {i for i in (ids[g] for g in set(root)) if not any(t in rows[i].text for t in items)}
    assert {r.doc_id for r in clean.collect()} == want and clean.columns == docs.columns
    mixed = corpus_pipeline.mix(spark, clean, SF)
    taken = {r.doc_id: r.taken for r in mixing.decide(mixing.sized(clean)).collect()}
    got = collections.Counter()
    for r in mixed.collect():
        got[r.doc_id] += len(words(r.text))
    assert mixed.columns == docs.columns and {k: v for k, v in taken.items() if v} == dict(got)
    packed = corpus_pipeline.pack(spark, mixed, SF).collect()
    e = packing.encoding(packing.VOCABULARY)
    assert sum(r.n_tokens for r in packed) == sum(len(e.encode_ordinary(r.text)) for r in mixed.collect())


def test_run_and_registration(spark):
    import __spark_entry__ as entry

    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] and "pipeline" in entry.queries() and "pipeline" not in entry.oracle_sql()
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in entry.queries()}
    assert decontamination and quality_rules


def test_empty(spark, empty):
    docs = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_odd(spark, odd):
    docs, kept = odd, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == odd.columns
        kept.append(sorted(str(r.doc_id) for r in docs.select("doc_id").distinct().collect()))
    # few words and repeated lines or windows go; of the copies 1, 2 and None the smallest id stays
    assert kept[0] == ["1", "2", "3", "None"] and set(kept[1]) == set(kept[2]) == set(kept[3]) >= {"1"} and "2" not in kept[1] and "None" not in kept[1]
    assert corpus_pipeline.pack(spark, docs, SF).count() >= 1


def test_run_reads_its_source_once(spark, monkeypatch):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    def table(session, sf_dir, name):
        df = session.read.parquet(f"{sf_dir}/{name}.parquet")
        return df.mapInArrow(counted, df.schema) if name == "documents" else df

    monkeypatch.setattr(corpus_pipeline, "table", table)
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert read.value == spark.read.parquet(f"{SF}/documents.parquet").count()
