"""The registered queries on the given tables: round trips, held-out accuracy and brute force."""

import brute
import duckdb
import pytest

from sparkveil.llm import entry

SF = "/root/testdata/sf0.001"


def table(name, columns):
    return duckdb.sql(f"select {columns} from '{SF}/{name}.parquet'").fetchall()


def test_language_held_out(spark):
    lang = dict(table("documents", "doc_id, lang"))
    rows = [r for r in entry.QUERIES["op1_language_id"](spark, SF).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) >= 0.95 * len(rows)


def test_quality_held_out(spark):
    label = dict(table("labels", "doc_id, quality"))
    rows = [r for r in entry.QUERIES["op4_quality"](spark, SF).collect() if r.held_out and r.doc_id in label]
    assert sum(r.predicted == label[r.doc_id] for r in rows) >= 0.8 * len(rows)


def test_decontamination_brute(spark):
    expected = brute.decontaminate(table("documents", "doc_id, text"), table("benchmark", "item_id, text"))
    rows = entry.QUERIES["op7_decontamination"](spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows} == expected


def test_jaccard_brute(spark):
    rows = entry.QUERIES["op8_jaccard_join"](spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute.jaccard(table("documents", "doc_id, text"))


def test_suffix_brute(spark):
    rows = entry.QUERIES["op9_suffix_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == brute.repeated(table("documents", "doc_id, text"))


def test_fingerprints_estimate_jaccard(spark):
    texts = dict(table("documents", "doc_id, text"))
    ids = sorted(texts)
    rows = {r.doc_id: r for r in entry.QUERIES["op10_fingerprints"](spark, SF).collect()}
    error = []
    for a, b in zip(ids, [*ids[1:], ids[0]]):
        half = len(texts[a]) // 2
        edited = texts[a][: len(texts[a]) - half] + texts[b][:half]
        s, t = brute.shingles(texts[a].lower()), brute.shingles(edited.lower())
        if s and t:
            error.append(rows[a].near_edited - len(s & t) / len(s | t))
    assert abs(sum(error) / len(error)) < 0.03 and sum(e * e for e in error) / len(error) < 0.06**2


def test_chat_roles(spark):
    rows = entry.QUERIES["op3_chat_format"](spark, SF).collect()
    assert sum(r.roles_right for r in rows) >= 0.85 * len(rows)


@pytest.mark.parametrize("name", ["op2_sharding", "op5_packing", "op6_token_counts"])
def test_every_document(spark, name):
    rows = entry.QUERIES[name](spark, SF).collect()
    assert {r.doc_id for r in rows} == {d for (d,) in table("documents", "doc_id")}


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs.count()
    for name, stage in p.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = stage(spark, docs, SF).cache()
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and len(after) <= kept
        if name == "ngram_jaccard_join":
            assert set(after) == {c for _, c in brute.jaccard(before).values()}
        if name == "suffix_array_dedup":
            removed = {d: v[1] for d, v in brute.repeated(before, 250).items()}
            assert all(len(dict(before)[d].encode()) - len(t.encode()) >= removed[d] for d, t in after.items())
            assert all((removed[d] > 0) or t == dict(before)[d] for d, t in after.items())
        if name == "benchmark_decontamination":
            hits = brute.decontaminate(before, table("benchmark", "item_id, text"))
            assert set(after) == {d for d, v in hits.items() if not v[4]}
        kept = len(after)
    pieces = p.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == set(after)


def test_stage_handles_odd_rows(spark, docs, none):
    import corpus_pipeline as p

    for _, stage in p.STAGES:
        assert stage(spark, docs, SF).count() > 0
        stage(spark, none, SF).count()
