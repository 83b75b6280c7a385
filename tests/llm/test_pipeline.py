import pytest
from test_dedup import any_earlier, brute_components
from test_matching import brute

import corpus_pipeline
from cairnmap.llm import decontaminate, mixing, toxicity

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def chain(spark, sf_dir):
    """(name, rows before, rows after) of each stage, one after the other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out, before, schema = {}, docs.collect(), docs.schema
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, spark.createDataFrame(before, schema), sf_dir)
        assert after.columns == ([*docs.columns, "copy"] if name == "mix" else docs.columns)
        out[name] = before, after.collect()
        before = out[name][1]
    return out


def test_toxicity_drops_what_the_operator_rejects(spark, sf_dir, chain):
    before, after = chain["toxicity"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scores = {r.doc_id: r.score for r in toxicity.scored(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).collect()}
    assert sorted(after) == sorted(r for r in before if scores[r.doc_id] < 0.5)


def test_line_dedup_equals_brute_force(chain):
    before, after = chain["line_dedup"]
    want = any_earlier([(r.doc_id, r.text) for r in before], 25)
    assert {r.doc_id: r.text for r in after} == want and len(after) == len(before)
    texts = {r.doc_id: r.text for r in before}
    assert all(r.n_chars == len(r.text) for r in after if r.text != texts[r.doc_id]) and any(r.text != texts[r.doc_id] for r in after)


def test_near_dedup_equals_brute_force(chain):
    before, after = chain["near_dedup"]
    groups = brute_components([(r.doc_id, r.text) for r in before], 5)
    assert sorted(after) == sorted(r for r in before if groups[r.doc_id][1] == r.doc_id)


def test_decontamination_against_brute_force(spark, sf_dir, chain):
    before, after = chain["decontaminate"]
    items = [r.text.lower().split() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in after}
    for r in before:
        words, common = r.text.lower().split(), set(r.text.lower().split())
        holds = any(brute(i, words) <= decontaminate.allowed(len(i)) for i in items if sum(w in common for w in i) >= len(i) - decontaminate.allowed(len(i)))
        assert (r.doc_id in kept) == (not holds)


def test_mix_comes_near_its_targets(spark, chain, work):
    before, after = chain["mix"]
    sizes, own = {}, {}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
        own[r.doc_id] = len(r.text.split())
    goals = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    taken, copies = dict.fromkeys(sizes, 0), {}
    for r in after:
        taken[r.source] += own[r.doc_id]
        copies.setdefault(r.doc_id, []).append(r.copy)
    assert all(abs(taken[s] - goals[s]) <= max(own.values()) for s in sizes)
    assert all(sorted(c) == list(range(len(c))) and len(c) <= 3 for c in copies.values())


def test_run(spark, sf_dir, chain):
    assert sorted(corpus_pipeline.run(spark, sf_dir).collect()) == sorted(chain["mix"][1])


@pytest.mark.parametrize("name", STAGES)
def test_odd_rows(spark, odd, sf_dir, name):
    from pyspark.sql import functions as F

    taken = ("_toxicity", "_gone", "_bad", "_own", "_plan", "_d", "_cut", "n_lines", "lines_deleted", "mix_size", "a.b", "copy")
    docs = odd.withColumnRenamed("n", "n_chars").select("*", *(F.lit(7).alias(c) for c in taken))
    got = STAGES[name](spark, docs, sf_dir)
    assert got.columns == (docs.columns if name != "mix" else [*(c for c in docs.columns if c != "copy"), "copy"])
    rows = got.collect()
    assert all(r[c] == 7 for r in rows for c in taken if c != "copy")
    assert name == "mix" or {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()} - ({2} if name == "near_dedup" else set())
    assert STAGES[name](spark, docs.limit(0), sf_dir).count() == 0


def test_clean_rows_stay_beside_contaminated_ones_of_their_id(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    docs = spark.createDataFrame([(None, "clean"), (None, item), (1, item), (1, "clean, too"), (2, None)], "doc_id long, text string")
    got = STAGES["decontaminate"](spark, docs, sf_dir).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, "clean"), (1, "clean, too"), (2, "")]
