"""Each stage against a brute-force version of it, on its own input."""

from collections import Counter

import corpus_pipeline
import numpy as np
from docquery.llm import bpe, mixing
from tokenizers import Tokenizer

from tests.llm import test_jaccard, test_pii, test_quality

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frames[-1], SF)
        if k < 4:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        frames.append(spark.read.parquet(str(tmp_path / str(k))))
    raw, clean, alone, redacted, mixed, coded = [f.collect() for f in frames]

    kept = {r.doc_id for r in clean}
    for r in raw:
        n, _, _, _, repeated = test_quality.brute(r.text)
        if n < 20 or 100 * repeated > 30 * n:
            assert r.doc_id not in kept
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    assert {r.doc_id for r in raw if r.doc_id in good and len((r.text or "").split()) >= 20} - kept <= {r.doc_id for r in raw if 100 * test_quality.brute(r.text)[4] > 30 * len(r.text.split())}

    assert sorted(r.doc_id for r in alone) == test_jaccard.brute_kept([(r.doc_id, r.text) for r in clean])

    before = {r.doc_id: r.text for r in alone}
    assert len(redacted) == len(alone)
    for r in redacted:
        assert r.n_chars == len(r.text) and (r.text == before[r.doc_id]) == (not test_pii.brute(before[r.doc_id]) and "[" not in r.text)

    assert Counter(r.doc_id for r in mixed) == Counter({r.doc_id: r.copies for r in mixing.plan(frames[3]).collect() if r.copies})

    library = Tokenizer.from_file(bpe.default_vocabulary())
    assert Counter(r.doc_id for r in coded) == Counter(r.doc_id for r in mixed)
    for r in coded:
        assert np.array_equal(r.token_ids, library.encode(r.text, add_special_tokens=False).ids)


def test_run_and_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 0
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_edge_cases_of_a_whole_run(spark, tmp_path):
    prose = " ".join(f"word{i} and then, some more of it;" for i in range(40)) + "."
    rows = [(1, prose, "en", "a", 1), (1, prose, "en", "a", 1), (2, prose + " more", None, None, None), (None, "x " + prose[::-1], "de", "a", 2), (3, None, None, "b", 0), (4, "", "", "", 0), (5, ". ".join(f"sentence {i} tells of thing{i * 7} in place{i * 3}" for i in range(20_000)) + ".", "en", "b", 9)]
    spark.createDataFrame([(*r, "c", 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, size string, decoded_text int").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {1, None, 5} and 5 in {r.doc_id for r in out}
    assert all(len(r.token_ids) > 0 and r.size == "c" and r.decoded_text == 7 for r in out)
