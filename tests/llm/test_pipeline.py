"""The pipeline: every stage over what the one before kept, against brute force, and on awkward rows; the twins of the queries."""

import os
import re
import sys
from types import SimpleNamespace

import corpus_pipeline
import pytest
from palisade.llm import decontaminate, mixing
from palisade.llm.common import cut_lineage
from palisade.llm.queries import QUERIES, TWINS
from pyspark.sql import functions as F

from tests.llm.conftest import texts
from tests.llm.test_native import without_repeats

sys.path.insert(0, os.path.join(os.path.dirname(corpus_pipeline.__file__), "tools"))

import compare  # noqa: E402

DATA = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage on the smallest tables."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = cut_lineage(stage(spark, docs, DATA))
        out[name] = (docs, after)
        docs = after
    return out


def rows(frame):
    return {r.doc_id: r for r in frame.collect()}


def words(text):
    return (text or "").encode().lower().split()


def test_stages_keep_the_columns(stages):
    assert list(stages) == ["quality_classifier", "line_dedup", "near_dedup", "decontamination", "mixing"]
    assert all(after.columns == COLUMNS for name, (_, after) in stages.items() if name != "mixing")
    assert stages["mixing"][1].columns == [*COLUMNS, "copy"]


def test_classifier_drops_documents_and_changes_none(spark, stages):
    before, after = map(rows, stages["quality_classifier"])
    assert set(after.items()) <= set(before.items()) and 0.5 * len(before) < len(after) < len(before)
    labels = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    clean = [d for d, r in labels.items() if r.quality == 1 and r.toxic == 0]
    assert sum(d in after for d in clean) >= 0.9 * len(clean)


def test_lines_equal_brute_force(stages):
    before, after = map(rows, stages["line_dedup"])
    expected = without_repeats([(d, r.text) for d, r in before.items()])
    kept = {d: expected[(d, r.text or "")] for d, r in before.items()}
    assert {d: r.text for d, r in after.items()} == {d: t for d, t in kept.items() if words(t) or t == before[d].text}
    assert all(r.n_chars == len(r.text) for d, r in after.items() if r.text != before[d].text)


def test_one_of_each_group_stays(stages):
    before, after = map(rows, stages["near_dedup"])
    found = {d: {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in ((d, words(r.text)) for d, r in before.items())}
    root = {d: d for d in found}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(found)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if len(found[a] & found[b]) >= 0.8 * len(found[a] | found[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert set(after) == {d for d in ids if find(d) == d} and all(after[d] == before[d] for d in after)


def test_passages_of_the_benchmark_go(spark, stages):
    before, after = stages["decontamination"]
    benchmark = spark.read.parquet(f"{DATA}/benchmark.parquet")
    found = {r.doc_id: r for r in decontaminate.contamination(before, benchmark).collect()}
    old, new = rows(before), rows(after)
    assert decontaminate.contamination(after, benchmark).filter("contaminated").isEmpty()
    assert set(old) - set(new) == {d for d, r in found.items() if r.contaminated and r.n_hit >= 0.5 * r.n_words}
    assert all(new[d] == old[d] for d, r in found.items() if not r.contaminated)


def test_the_mix_repeats_documents_to_the_targets(stages):
    before, after = stages["mixing"]
    size = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    total = sum(size(r.text) for r in before.collect())
    copies = {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()}
    taken = sum(size(r.text) for r in after.collect())
    assert max(copies.values()) == 2 and abs(taken - 1.5 * total) < 0.05 * total
    assert after.select(*COLUMNS).distinct().exceptAll(before.select(*COLUMNS).distinct()).isEmpty()


def test_runs_agree(spark, stages):
    again = corpus_pipeline.run(spark, DATA)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, stages["mixing"][1].collect()))


def test_awkward_rows_and_no_rows(spark, awkward, no_documents, labels, benchmark, tmp_path):
    for name, frame in (("labels", labels), ("benchmark", benchmark)):
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    for start in (awkward, no_documents):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = cut_lineage(stage(spark, docs, str(tmp_path)))
            assert docs.columns == awkward.columns + (["copy_"] if name == "mixing" else [])
        assert docs.count() <= 2 * len(texts())
        if start is no_documents:
            assert docs.isEmpty()
    assert docs.isEmpty()


def test_decontamination_returns_clean_rows_as_they_are(spark, awkward, benchmark):
    """Row by row, null texts and a column named like one of the operator's own included."""
    key = lambda r: (r.doc_id, r.text, r.lang, r.source)
    after = {key(r): r for r in decontaminate.decontaminated(awkward.fillna(7, ["n_chars"]), benchmark).collect()}
    before = {key(r): r for r in awkward.fillna(7, ["n_chars"]).collect()}
    clean = {k for k, r in before.items() if not re.search("nothing of note", r.text or "") and (r.text or "") != "one"}
    assert {k for k in after if k in before} == clean and all(after[k] == before[k] for k in clean)
    assert after[(1, None, "en", "a")].n_chars == 7
    cut = [r for k, r in after.items() if k not in before]
    assert cut and all(r.n_chars == len(r.text) and "line 3 of" not in r.text for r in cut)


def test_words_in_spans_are_cut_in_time_in_proportion(spark):
    import time

    def seconds(n):
        text = " ".join(f"w{i}" for i in range(n)) + "."
        spans = [(i, 2) for i in range(0, n - 2, 3)]
        rows = spark.createDataFrame([(text, spans)], "text string, spans array<struct<start:bigint,length:bigint>>")
        begin = time.perf_counter()
        (found,) = rows.select(decontaminate.without_spans(F.col("text"), F.col("spans"))).first()
        hit = {i for a, k in spans for i in range(a, a + k)}
        assert found == "".join(f"w{i}" + (" " if i < n - 1 else ".") for i in range(n) if i not in hit)
        return time.perf_counter() - begin

    seconds(3000)
    assert seconds(60_000) < 20


@pytest.mark.parametrize("spans, left", [([], "(a b-c d)e"), ([(0, 1)], "(b-c d)e"), ([(4, 1)], "(a b-c d)"), ([(1, 2), (2, 2)], "(a e"), ([(0, 5)], "("), ([(3, 1), (0, 1)], "(b-c e")])
def test_words_in_spans_are_cut(spark, spans, left):
    rows = spark.createDataFrame([("(a b-c d)e", spans)], "text string, spans array<struct<start:bigint,length:bigint>>")
    assert rows.select(decontaminate.without_spans(F.col("text"), F.col("spans"))).first()[0] == left


def test_repeated_rows_share_what_is_taken(spark):
    docs = spark.createDataFrame([(d, " ".join(["w"] * (3 + d % 5)), "en", s, 1) for d in range(60) for s in ("a", "b") for _ in range(1 + 2 * (d % 3 == 0))], "doc_id long, text string, lang string, source string, n_chars long")
    taken = {r.source: r.n for r in corpus_pipeline.mix_sources(spark, docs, DATA).groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    targets = {r.source: r.target for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    assert all(abs(taken[s] - targets[s]) <= 8 for s in targets)


@pytest.mark.parametrize("name", list(TWINS))
def test_query_equals_its_twin(spark, name):
    good, note = compare.compare(SimpleNamespace(build=QUERIES[name], oracle=TWINS[name]), spark, compare.connect(SMALL), SMALL)
    assert good, note


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(TWINS) - {"pipeline"}))
def test_query_returns_a_row_for_every_input_row(spark, name):
    table = "pages" if name.startswith("op2_") else "documents"
    frame = QUERIES[name](spark, SMALL)
    key = "page_id" if table == "pages" else "doc_id"
    assert frame.count() == spark.read.parquet(f"{SMALL}/{table}.parquet").count() == frame.select(F.col(key)).distinct().count()
