import hashlib
import random

import pytest
import sentencepiece
from docquery.llm import pieces

ODD = ["", " ", "   ", "a", " a  b ", "\n", "a\nb\n\n c", "\ttab\t", "▁", "a▁b ▁▁ c", "<s> </s> <unk> <0x41>", "éàü ñ ß", "漢字かな 😀👩‍👩‍👧", "x" * 5000, "ab" * 3000 + " c", "\x00\x01", "12345 1,2.3", "é ﬁ ① ｱ 　 x​", "  \u0085", "don't", "·" * 200]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


@pytest.fixture(scope="module")
def coder():
    return pieces.Encoder(pieces.read_model(None)[1])


def random_texts(n, seed):
    rng = random.Random(seed)
    picks = [lambda: rng.choice("etaoin  srh"), lambda: chr(rng.randrange(1, 0x250)), lambda: chr(rng.randrange(0x300, 0x2100)), lambda: chr(rng.randrange(0x3000, 0xA000)), lambda: chr(rng.randrange(0x1F300, 0x1F700)), lambda: rng.choice("é ①ﬁ　ｶﾞ▁")]
    return ["".join(rng.choice(picks)() for _ in range(rng.randrange(1, 80))) for _ in range(n)]


def test_equals_the_library_with_spans(library, coder):
    texts = ODD + random_texts(800, 1)
    for t, (ids, starts, ends) in zip(texts, coder.batch(texts), strict=True):
        want = library.encode(t, return_type="proto")
        assert ids.tolist() == [p.id for p in want.pieces], t[:60]
        assert [*zip(starts.tolist(), ends.tolist(), strict=True)] == [(p.begin, p.end) for p in want.pieces], t[:60]
        assert coder.decode(ids.tolist()) == library.decode(ids.tolist()), t[:60]


def test_decoding_any_ids(library, coder):
    rng = random.Random(2)
    for _ in range(500):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000), rng.randrange(3)]) for _ in range(rng.randrange(1, 12))]
        assert coder.decode(ids) == library.decode(ids), ids


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "nmt_nfkc_cf"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_compiled_map_and_alignment(rule, squeeze):
    """Longest prefixes and the record of places equal the library's own normaliser with a map that isn't empty."""
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, remove_extra_whitespaces=squeeze, escape_whitespaces=True)
    m = pieces.proto.ModelProto()
    m.ParseFromString(library.serialized_model_proto())
    own = pieces.Encoder(pieces.read_model(None)[1])
    own.map, own.prefix, own.squeeze = pieces.CharacterMap(m.normalizer_spec.precompiled_charsmap), True, squeeze
    for t in ODD + random_texts(600, 3):
        if "\x00" in t:
            continue
        want, places = library.normalize(t, with_offsets=True)
        got, align = own.normalise(t)
        assert got == want, ascii(t)
        at = [len(got[:k].encode()) for k in range(len(got) + 1)]
        bytes_of = [len(t[:k].encode()) for k in range(len(t) + 1)]
        assert [align[k] for k in at] == [bytes_of[p] for p in places], ascii(t)


def test_short_and_long_merging_agree(coder):
    rng = random.Random(4)
    for _ in range(300):
        symbols = [rng.choice("▁abcdefinorstuh") for _ in range(rng.randrange(1, 90))]
        long = coder.merged_long(list(symbols))
        assert long == coder.merged(list(symbols))
        assert "".join(long) == "".join(symbols)


def test_ordinary_stretches_are_merged_together(monkeypatch, library):
    """New words of characters that are pieces cost no Python call each."""
    rng = random.Random(6)
    words = ["".join(rng.choice(["th", "on", "er", "in", "qu", "é", "ß", "W", "7"]) for _ in range(rng.randrange(1, 20))) for _ in range(3000)]
    coder = pieces.Encoder(pieces.read_model(None)[1])
    monkeypatch.setattr(coder, "encoded", lambda s: pytest.fail(s))
    monkeypatch.setattr(pieces, "TOGETHER", (1, 700), raising=False)
    text = " ".join(words)
    assert coder.batch([text, "a"])[0][0].tolist() == library.encode(text)
    assert coder.batch([" ".join(words[::-1])])[0][0].tolist() == library.encode(" ".join(words[::-1]))


@pytest.mark.parametrize("width", [1, 7, 500, 40_000])
def test_equal_scores_together_and_alone(width):
    """Of pairs of one score the leftmost goes first, as in the library; odd and long stretches between ordinary ones keep their places."""
    m = pieces.proto.ModelProto.FromString(pieces.read_model(None)[1])
    for i, p in enumerate(m.pieces):
        p.score = -(i // width)
    library, coder = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString()), pieces.Encoder(m.SerializeToString())
    rng = random.Random(7)
    texts = ODD + random_texts(200, 8) + ["".join(rng.choice("abeinorst   ") for _ in range(2000)), " ".join("aab"[: k % 4] * k for k in range(120))]
    for t, (ids, starts, ends) in zip(texts, coder.batch(texts), strict=True):
        want = library.encode(t, return_type="proto").pieces
        assert [*zip(ids.tolist(), starts.tolist(), ends.tolist(), strict=True)] == [(p.id, p.begin, p.end) for p in want], t[:60]
    words = [w[:40] for t in texts for w in t.split() if all(c in coder.piece for c in w)]
    symbols = pieces.np.array([coder.piece[c][1] for w in words for c in w[:40]], pieces.np.int32)
    ids, counts = coder.pairs.merged(symbols, pieces.np.array([*map(len, words)]))
    alone = [coder.merged(list(w)) for w in words]
    assert [coder.names[i] for i in ids] == [s for a in alone for s in a] and counts.tolist() == [*map(len, alone)]


def test_caches_forget_without_changing_results(monkeypatch, library):
    monkeypatch.setattr(pieces, "CACHED", 20)
    coder = pieces.Encoder(pieces.read_model(None)[1])
    for t in random_texts(20, 5):
        assert [i.tolist() for i, _, _ in coder.batch([t, t + " end"])] == [library.encode(t), library.encode(t + " end")]


def test_query_against_the_library(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = pieces.query(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.covered_bytes) == (len(ids), len(texts[r.doc_id].encode()))
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_edge_cases(spark, library):
    rows = [(1, None, 5, "x"), (1, None, 5, "x"), (None, "", 6, None), (2, "word " * 50_000, 7, ""), (3, "é", 8, "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, decoded long, `a.b` string")
    got = pieces.encode(frame).collect()
    assert sorted(len(r.piece_ids) for r in got) == sorted([0, 0, 0, len(library.encode("word " * 50_000)), len(library.encode("é"))])
    assert [r.decoded for r in got if r.doc_id == 1] == ["", ""] and {r["a.b"] for r in got} == {"x", "y", "", None}
    assert pieces.encode(frame.limit(0)).count() == 0
