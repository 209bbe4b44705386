"""The pipeline's stages against plain Python."""

from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from helpers import empty_documents, odd_documents, with_clashes
from test_mixing import check
from test_quality import expected as quality_counts
from test_secrets import spans
from test_simhash import expected as simhash_rows, fingerprint
from tokenizers import Tokenizer

from faregrid.llm import common, mixing, secrets


def test_stages_follow_each_other(spark, sf_dir):
    docs = common.read_table(spark, sf_dir, "documents")
    steps, stages = [docs], dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES:
        out = common.stored(stage(spark, steps[-1], sf_dir), name)
        assert name == "tokens" or out.columns == docs.columns
        steps.append(out)
    first, kept, single, masked, mix, tokens = ([*s.collect()] for s in steps)
    assert 0 < len(kept) < len(first) and all(not quality_counts(r.text)[-1] for r in kept)
    want = simhash_rows([(r.doc_id, fingerprint(r.text)) for r in kept])
    assert sorted(r.doc_id for r in single) == sorted({c for _, _, c in want})
    texts = {r.doc_id: r.text for r in single}
    for r in masked:
        assert (r.text == texts[r.doc_id]) == (not spans(texts[r.doc_id])) and r.n_chars == len(r.text)
        assert not spans(r.text) and (secrets.MASK in r.text or r.text == texts[r.doc_id])
    taken = mixing.taken(steps[3]).collect()
    check(taken, steps[3])
    assert Counter(r.doc_id for r in mix) == Counter({r.doc_id: r.taken // r.size for r in taken if r.taken})
    library, texts = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {r.doc_id: r.text for r in masked}
    assert len(tokens) == len(mix) and all(r.round_trip for r in tokens)
    assert all(list(r.ids) == library.encode(texts[r.doc_id], add_special_tokens=False).ids for r in tokens)
    assert list(stages) == ["quality_rules", "near_duplicates", "secret_scan", "source_mix", "tokens"]


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).where("round_trip").count() > 100


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_odd_and_empty_documents(spark, sf_dir, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, empty_documents(spark), sf_dir).count() == 0
    docs = with_clashes(odd_documents(spark, 40), "kept", "fp", "row_key", "shard", "ids")
    out = stage(spark, docs, sf_dir)
    assert name == "tokens" or out.columns == docs.columns
    assert out.count() > 0
