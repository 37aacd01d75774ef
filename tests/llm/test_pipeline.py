"""Each stage of the pipeline against a brute-force version on its own input, and empty tables."""

import itertools
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from splatloom.llm import decontaminate, language_id, licences, line_quality, mixing, near_dedup, quality_model, secrets, token_counts
from test_operators import FOLD, SCHEMA, SF, WORD7, _entropy_spans, _set

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input of each stage and the output of the last, as written."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(P.STAGES):
        out.append(docs)
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
    return [*out, docs]


def _texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns(stages):
    assert all(df.columns == DOCUMENT for df in stages[:-1])
    assert stages[-1].columns == [*DOCUMENT, "mix_size", "mix_source_size", "mix_target", "mix_taken"]


def test_classifier(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_model.train(stages[0], quality_model.ratings_of(labels))
    want = {r["doc_id"] for r in quality_model.grades(stages[0], model).collect() if r["top_probability"] >= quality_model.TAIL}
    assert set(_texts(stages[1])) == want


def test_dedup(stages):
    sets = {i: _set(t, 5) for i, t in _texts(stages[1]).items()}
    label = {i: i for i in sets}
    for _ in range(3):
        for a, b in itertools.combinations(sorted(sets), 2):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                label[a] = label[b] = min(label[a], label[b])
    assert set(_texts(stages[2])) == set(label.values())


def test_decontamination(spark, stages):
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = WORD7.findall(r["text"].translate(FOLD))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    clean, changed = _texts(stages[3]), 0
    for i, t in _texts(stages[2]).items():
        spots = list(WORD7.finditer(t.translate(FOLD)))
        w = [m[0] for m in spots]
        hit = {k + j for n in {len(x) for x in windows} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for j in range(n)}
        out, at = [], 0
        for _, run in itertools.groupby(enumerate(sorted(hit)), lambda p: p[1] - p[0]):
            run = [k for _, k in run]
            out.append(t[at : spots[run[0]].start()])
            at = spots[run[-1]].end()
        assert clean[i] == "".join([*out, t[at:]])
        changed += bool(hit)
    assert changed and len(clean) == stages[2].count()


def test_masking(stages):
    patterns = [(re.compile(secrets.ASSIGN), 6), (re.compile("AKIA[A-Z0-9]+"), 20), (re.compile("[0-9a-f]+"), 24)]
    masked = _texts(stages[4])
    for i, t in _texts(stages[3]).items():
        base = [(m.start(), k, m.end()) for k, (p, n) in enumerate(patterns) for m in p.finditer(t) if len(m[m.lastindex or 0]) >= n]
        out, at = [], 0
        for a, _, b in sorted(base + _entropy_spans(t, base)):
            if a >= at:
                out += [t[at:a], "[SECRET]"]
            at = max(at, b)
        assert masked[i] == "".join([*out, t[at:]])


def test_mixing(stages, tmp_path):
    stages[4].toPandas().to_parquet(tmp_path / "documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet')")
    want = sorted((i, size, source, target, taken) for i, size, source, target, taken in c.execute(mixing.SQL).fetchall() if taken > 0)
    got = sorted((r["doc_id"], r["mix_size"], r["mix_source_size"], r["mix_target"], r["mix_taken"]) for r in stages[5].collect())
    assert got == want


def test_run_is_all_stages(spark, stages):
    key = lambda df: sorted((r["doc_id"], r["mix_taken"], r["text"]) for r in df.collect())
    assert key(P.run(spark, SF)) == key(stages[5])


def test_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    benchmark = spark.createDataFrame([], "item_id long, text string")
    model = language_id.train(spark.read.parquet(f"{SF}/documents.parquet"))
    for df in (
        near_dedup.near_duplicates(empty), near_dedup.deduplicated(empty), licences.scan(empty), line_quality.quality(empty), language_id.identify(empty, model), language_id.identify(empty, None),
        decontaminate.contamination(empty, benchmark), decontaminate.decontaminated(empty, benchmark), mixing.mix(empty), mixing.mixed(empty), secrets.scan(empty), secrets.masked(empty),
    ):
        assert df.count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert decontaminate.contamination(docs, benchmark).where("n_hit > 0").count() == 0
    assert decontaminate.decontaminated(docs, benchmark).count() == docs.count()
    ledger = token_counts.Ledger(spark, f"file://{tmp_path}/ledger")
    assert ledger.commit("x", empty.withColumn("op", F.lit("insert"))) and ledger.totals().count() == 0


def test_columns_of_clashing_names_stay(spark):
    rows = spark.createDataFrame([(1, "a key xK9v2Lq8Zt4Rw7Yp3Mn6Bc5D end", "s", "mine", "too", "third", "fourth", 7)], "doc_id long, text string, source string, __all string, __base string, __mixed string, __dropped string, mix_size long")
    kept = ["__all", "__base", "__mixed", "__dropped"]
    for df in (secrets.masked(rows), mixing.mixed(rows), near_dedup.deduplicated(rows)):
        assert df.select(*kept).first() == ("mine", "too", "third", "fourth")
