"""The pipeline, stage by stage, against brute force on whole tables, with awkward rows among the documents."""

import re

import pytest

import corpus_pipeline
from tests.llm.test_operators_llm import ASSIGN, SCHEMA, WORD, awkward, frame, water
from trackframe.llm import decontaminate, quality, simhash
from trackframe.llm.common import cut

DATA = "/root/testdata/sf0.01"
TOXIC = "you are an idiot and a moron , worthless scum , stupid pathetic clown"


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def similar(a, b):
    shared = len(a & b)
    return shared / (len(a) + len(b) - shared)


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage got and gave, as pandas frames by name."""
    real = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    docs, out = frame(spark, real + awkward()), {}
    for name, stage in corpus_pipeline.STAGES:
        after = cut(stage(spark, docs, DATA), name)
        out[name] = (docs.toPandas(), after.toPandas(), docs.columns, after.columns)
        docs = after
    return out


def test_order_and_columns(stages):
    assert list(stages) == ["quality", "near_copies", "decontamination", "secrets", "mixing"]
    assert all(before == after for name, (_, _, before, after) in stages.items() if name != "mixing")


def test_quality_keeps_what_the_classifier_keeps(spark, stages):
    before, after, *_ = stages["quality"]
    docs = spark.createDataFrame([(None if i != i else int(i), t) for i, t in zip(before.doc_id, before.text, strict=True)], "doc_id long, text string")
    kept = quality.classify(docs, spark.read.parquet(f"{DATA}/labels.parquet")).filter("keep").toPandas()
    assert sorted(map(str, kept.doc_id)) == sorted(map(str, after.doc_id)) and len(after) < len(before)
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas().merge(before[["doc_id"]], on="doc_id")
    good = labels[(labels.quality == 1) & (labels.toxic == 0)].doc_id
    assert good.isin(after.doc_id).mean() > 0.85


def test_near_copies_leave_one_of_each_group(stages):
    before, after, *_ = stages["near_copies"]
    rows = [(i, shingles(t)) for i, t in zip(before.doc_id, before.text, strict=True) if i == i]
    kept, close = set(after.doc_id), []
    by = {}
    for i, s in rows:
        for x in s:
            by.setdefault(x, set()).add(i)
    sets = dict(rows)
    for i, s in rows:
        for j in {j for x in s for j in by[x]}:
            if j < i:
                v = similar(s, sets[j])
                if v >= 0.8:
                    close.append((i, j))
    assert close and sum(i in kept and j in kept for i, j in close) <= 0.01 * len(close)
    gone = {i for i, _ in rows} - kept
    by_kept = {i: max((similar(sets[i], sets[j]) for j in {j for x in sets[i] for j in by[x]} if j in kept and j < i), default=0) for i in gone}
    assert gone and all(v >= 0.8 for v in by_kept.values())


def test_leaks_go_and_only_they(spark, stages):
    before, after, *_ = stages["decontamination"]
    clean = lambda t: f" {' '.join(re.findall(r'[^\W_]+', (t or '').lower()))} "
    items = [clean(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    whole = {i for i, t in zip(before.doc_id, before.text, strict=True) if i == i and any(x in clean(t) for x in items)}
    gone = {i for i in before.doc_id if i == i} - set(after.doc_id)
    assert whole and whole <= gone and len(gone) <= len(whole) + max(2, 0.1 * len(whole))
    assert decontaminate.LEAST == 0.5


def test_secrets_are_masked_and_nothing_else_changes(stages):
    before, after, *_ = stages["secrets"]
    assert len(before) == len(after)
    old = sorted(((str(i), str(s), t or "") for i, s, t in zip(before.doc_id, before.source, before.text, strict=True)), key=lambda r: r[:2])
    new = sorted(((str(i), str(s), t or "") for i, s, t in zip(after.doc_id, after.source, after.text, strict=True)), key=lambda r: r[:2])
    masked = 0
    for (i, _, a), (j, _, b) in zip(old, new, strict=True):
        assert i == j
        secret = [m for m in ASSIGN.finditer(a) if len(m[2]) >= 6] or re.search("AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", a)
        masked += bool(secret)
        assert "[SECRET]" in b if secret else a == b or "[SECRET]" in b
        parts = b.split("[SECRET]")
        assert a.startswith(parts[0]) and a.endswith(parts[-1])
        assert not re.search("AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", b)
    assert masked


def test_mix_comes_near_its_targets(stages):
    before, after, *_ = stages["mixing"]
    assert len(before) == len(after)
    total = {}
    for t, s in zip(before.text, before.source, strict=True):
        s = None if s != s else s
        total[s] = total.get(s, 0) + len(WORD.findall(t or ""))
    names = sorted(total, key=lambda s: (s is None, s))
    target = dict(zip(names, water([total[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))], 3.0), strict=True))
    for s, part in after.groupby("source", dropna=False):
        s = None if s is None or s != s else s
        assert abs(part.taken.sum() - target[s]) <= max(0.02 * target[s], part["size"].max())


def test_run_is_the_stages_and_reruns_agree(spark, tmp_path):
    spark.read.parquet(f"{DATA}/documents.parquet").limit(300).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    one, two = (sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) for _ in range(2))
    assert one == two and one


def test_toxic_goes_and_empty_tables_pass(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    weights, cut_points = quality.train(docs, spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    clean = docs.filter("doc_id = 0").first().text
    planted = spark.createDataFrame([(1, f"{clean} {TOXIC}"), (2, clean)], "doc_id long, text string")
    assert {r.doc_id: r.keep for r in quality.score(planted, weights, cut_points).collect()} == {1: False, 2: True}
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0
    assert simhash.NEAR_COPIES.shingle == 5
