"""What a Python worker holds: one codec of a file, numbers of one slice of bytes, one stage."""

import tracemalloc

import corpus_pipeline
import numpy as np
import public_tokenizers
from llm_cases import documents, prose

from legnet.llm import bpe, words

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_runs_of_one_file_share_a_codec(spark, tmp_path):
    first, second = bpe.Shared(spark, PATH), bpe.Shared(spark, PATH)
    assert first.codec() is second.codec()
    other = tmp_path / "other.json"
    other.write_text(open(PATH, encoding="utf-8").read() + "\n", encoding="utf-8")
    third, held = bpe.Shared(spark, str(other)), first.codec()
    assert third.codec() is not held and third.codec() is third.codec()


def test_word_hashes_by_slices(monkeypatch):
    text = prose(5, 20_000)
    whole = words.split_words([*[text] * 20, None, "", "x" * 400_000, "end"])
    tracemalloc.start()
    found = words.word_hashes(whole)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 15 * len(whole.data)
    n = len(text.split())
    assert np.array_equal(found[: 20 * n], np.tile(words.word_hashes(words.split_words([text])), 20))
    monkeypatch.setattr(words, "SLICE", 3)
    assert np.array_equal(found, words.word_hashes(whole))


def test_a_task_of_tokens_has_one_worker(spark):
    out = corpus_pipeline.tokens(spark, documents(spark, [(1, "One text"), (2, None)]), "")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert [r.n_tokens for r in out.orderBy("doc_id").collect()] == [2, 0]
