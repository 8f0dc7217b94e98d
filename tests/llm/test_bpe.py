import hashlib
import random

import numpy as np
import pytest
from docquery.llm import bpe
from tokenizers import Tokenizer

ODD = ["", "  ", "<|endoftext|>", "a<|startoftext|>b <|endoftext|>", " don't I'LL 'S", "ΣΑΣ Σ İstanbul", "é café", "x" * 5000, "ab" * 3000 + " c", "\x1c\x1d a\x1eb", "漢字かな 😀😀👩‍👩‍👧 ١٢٣", "a\u0085b", "<|endoftext|", "<|ENDOFTEXT|>", "12345 1,2.3", "…—!?!?", "Ⅷ ² ½"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


def expected(library, text):
    e = library.encode(text or "", add_special_tokens=False)
    return np.array(e.ids, "<u4").tobytes(), library.decode(e.ids, skip_special_tokens=False)


def test_odd_and_random_texts(library):
    coder = bpe.Encoder(open(bpe.default_vocabulary(), encoding="utf-8").read())
    rng = random.Random(3)
    # letters of the first planes that both libraries' Unicode tables know
    texts = ODD + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x250), rng.randrange(0x391, 0x3A1), rng.randrange(0x4E00, 0x9000)])) for _ in range(rng.randrange(1, 80))) for _ in range(1500)]
    for t, got in zip(texts, coder.batch(texts), strict=True):
        assert got == expected(library, t), t[:80]


def test_short_and_long_merging_agree():
    coder = bpe.Encoder(open(bpe.default_vocabulary(), encoding="utf-8").read())
    rng = random.Random(4)
    for _ in range(300):
        ids = [coder.inner[rng.choice("abcdefinorstuh")] for _ in range(rng.randrange(1, 60))]
        assert coder.merged_short(list(ids)) == coder.merged_long(list(ids))


def test_caches_forget_without_changing_results(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHED", 50)
    monkeypatch.setattr(bpe, "CACHED_WORDS", 50)
    coder = bpe.Encoder(open(bpe.default_vocabulary(), encoding="utf-8").read())
    rng = random.Random(5)
    for _ in range(20):
        texts = [" ".join("".join(rng.choice("etaoin") for _ in range(rng.randrange(1, 9))) for _ in range(40)) for _ in range(5)]
        assert coder.batch(texts) == [expected(library, t) for t in texts]


def test_query_against_the_library(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = bpe.query(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids, decoded = expected(library, texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_edge_cases(spark, library):
    rows = [(1, None, 5), (1, None, 5), (None, "", 6), (2, "word " * 50_000, 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, decoded long")
    got = bpe.encode(frame).collect()
    assert sorted(len(r.token_ids) for r in got) == [0, 0, 0, 50_000] and [r.decoded for r in got if r.doc_id == 1] == ["", ""]
    assert bpe.encode(frame.limit(0)).count() == 0
