"""The pipeline's stages one after the other, each against a plain version of what it must do."""

import collections
import os
import shutil
import subprocess
import sys

import corpus_pipeline
from plumbline.llm import quality_classifier
from tests.llm import brute
from tests.llm.test_rules import components_by

FOLDER = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    kept = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        result = stage(spark, docs, FOLDER)
        result.write.parquet(f"{tmp_path}/{number}")
        found = spark.read.parquet(f"{tmp_path}/{number}")
        if number < 4:
            assert found.columns == list(corpus_pipeline.COLUMNS)
            assert dict(found.dtypes) == dict(docs.dtypes)
        kept.append((docs.collect(), found.collect()))
        docs = found

    given, left = kept[0]
    judged = quality_classifier.classify(spark.read.parquet(f"{FOLDER}/documents.parquet"), labels).collect()
    assert {r.doc_id for r in left} == {r.doc_id for r in judged if r.predicted}
    texts = {r.doc_id: r.text for r in given}
    assert all(r.text == texts[r.doc_id] for r in left)

    given, left = kept[1]
    found = components_by([(r.doc_id, r.text) for r in given], corpus_pipeline.NEAR_COPIES)
    assert {r.doc_id for r in left} == {c if n else k for k, n, c in found}

    given, left = kept[2]
    wanted = {k: (n, gone) for k, n, gone, _ in brute.substring_dedup([(r.doc_id, r.text) for r in given], 50)}
    for r in left:
        n, gone = wanted[r.doc_id]
        assert len(r.text.split()) == n - gone
    assert {r.doc_id for r in left} == {k for k, (n, gone) in wanted.items() if gone == 0 or gone < n}

    given, left = kept[3]
    copies = collections.Counter(r.doc_id for r in left)
    assert set(copies) <= {r.doc_id for r in given} and max(copies.values()) <= 2

    given, left = kept[4]
    pieces = collections.Counter((r.doc_id, r.piece) for r in left)
    times = collections.Counter(r.doc_id for r in given)
    assert all(n == times[doc] for (doc, _), n in pieces.items())
    assert {d for d, _ in pieces} == set(times)


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, FOLDER)
    assert "sequence_id" in got.columns and got.count() > 0


def test_the_library_stands_without_this_package(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; n = list(e.queries()); assert 'dq_issues' in n and 'pipeline' not in n"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, env=env, check=True, timeout=120)
