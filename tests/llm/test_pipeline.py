"""Each stage of the pipeline on its own input, against brute force, and the whole run."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm import test_operators as brute  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def of(df):
    return [tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect()]


@pytest.fixture(scope="module")
def runs(spark, awkward, tmp_path_factory):
    """The input and output of every stage."""
    at = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{awkward}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, awkward).write.parquet(str(at / name))
        after = spark.read.parquet(str(at / name))
        out[name] = (docs, after)
        docs = after
    return out


def test_stages_return_the_columns_of_their_input(runs):
    for name, (before, after) in runs.items():
        if name != "token_output":
            assert after.columns == before.columns


def test_language_stage(spark, runs):
    before, after = runs["language_id"]
    want = Counter(key for key, lang, score in brute.brute_predictions(before) if lang != "und" and score >= corpus_pipeline.LEAST_SCORE)
    assert Counter(d[:2] for d in of(after)) == want and set(of(after)) <= set(of(before))
    kept = {r[0] for r in of(after)}
    assert set(range(150)) <= kept and not kept & {200, 201, 202, 203}


def test_dedup_stage(runs):
    before, after = runs["near_dedup"]
    docs = sorted(of(before), key=lambda d: (d[0] is None, d[0] or 0, d[1] or ""))
    label = brute.brute_components(np.array([brute.brute_fingerprint(d[1]) for d in docs], np.uint64))
    assert Counter(d[0] for d in of(after)) == Counter(docs[k][0] for k in set(label.tolist()))


def test_decontamination_stage(spark, awkward, runs):
    before, after = runs["decontaminate"]
    bench = [(r[0], r[1]) for r in spark.read.parquet(f"{awkward}/benchmark.parquet").collect()]
    clean = [d for d in of(before) if not next(iter(brute.brute_decontamination([d[:2]], bench)))[5]]
    assert Counter(of(after)) == Counter(clean) and len(clean) < before.count()


def test_mixing_stage(runs):
    before, after = runs["mix_sources"]
    want = Counter()
    for (d, source, _), n in brute.brute_copies([(r[0], r[1], r[3]) for r in of(before)]).items():
        want[(d, source)] += n
    assert Counter((r[0], r[3]) for r in of(after)) == want and set(of(after)) <= set(of(before))


def test_token_stage_and_run(spark, awkward, runs):
    from tokenizers import Tokenizer

    before, after = runs["token_output"]
    model, want = Tokenizer.from_file(corpus_pipeline.tokenizer_path()), Counter()
    for d, t, *_ in of(before):
        ids = model.encode(t or "", add_special_tokens=False).ids + [0]
        want[(d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    found = after.collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == want
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    whole = corpus_pipeline.run(spark, awkward)
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, found))


def test_empty(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []


def test_repeated_and_null_ids_leave_one_of_a_group(spark):
    rows = [(None, "same words in here", "en", "s", 1), (None, "same words in here", "en", "s", 1), (7, "other words in there", "en", "s", 1), (7, "other words in there", "en", "s", 1), (9, "other words in there", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter({(None, "same words in here"): 1, (7, "other words in there"): 1})
