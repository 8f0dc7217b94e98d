import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from docquery.llm import alignment, pieces
from tokenizers import Tokenizer

ODD = ["", " ", "a", "  a  b ", "\n", "a\nb\n\n c\n d", "end.\nThe  \n  x", "\ttab\t x", "a▁b", "<|endoftext|> x <s>", "éàü ñ", "漢字かな 😀👩‍👩‍👧", "x" * 3000, "ab" * 2000 + " c", "\x00\x1c \x1cb", "don't I'LL 12345", "\xa0a \xa0 b　 c", "  \n x"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(alignment.default_vocabulary())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def brute(libraries, texts):
    """Groups, links and counts by the definitions, over the libraries' tokens of whole texts."""
    a, b = libraries
    back = {c: i for i, c in enumerate(alignment.byte_alphabet())}
    groups = []
    for t in texts:
        if not t:
            groups.append([])
            continue
        ai, bi = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        ab = [bytes(back[c] for c in a.id_to_token(i)) for i in ai]
        bb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in bi for p in [b.id_to_piece(i)]]
        if not b"".join(ab) == b"".join(bb) == (" " + t).encode():
            groups.append([])
            continue
        ae, be = np.cumsum([*map(len, ab)]).tolist(), np.cumsum([*map(len, bb)]).tolist()
        found, x, y = [], 0, 0
        for cut in sorted(set(ae) & set(be)):
            x2, y2 = ae.index(cut, x) + 1, be.index(cut, y) + 1
            found.append((ai[x:x2], bi[y:y2]))
            x, y = x2, y2
        groups.append(found)
    links = [Counter((i, j) for ga, gb in g for i in ga for j in gb) for g in groups]
    count = Counter(p for found in links for p in found)
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    out = []
    for g, found in zip(groups, links, strict=True):
        text = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in g)
        n_best = sum(n for (i, j), n in found.items() if count[i, j] == best[i])
        out.append((sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(found.values()), hashlib.sha256(text.encode()).hexdigest() if g else "", n_best, sum(n * count[p] for p, n in found.items())))
    return out


def test_groups_of_random_ends():
    rng = random.Random(1)
    for _ in range(300):
        last = rng.randrange(1, 40)
        a, b = ([*sorted(rng.sample(range(1, last), rng.randrange(last))), last] for _ in range(2))
        cuts = np.array(sorted(set(a) & set(b)))
        ga, gb = alignment.groups_of(np.array(a), np.array(b))
        assert ga.tolist() == np.searchsorted(cuts, a).tolist() and gb.tolist() == np.searchsorted(cuts, b).tolist()


def test_query_against_brute_force(spark, sf_dir, libraries):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: w for r, w in zip(rows, brute(libraries, [r.text for r in rows]), strict=True)}
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) for r in alignment.query(spark, sf_dir).collect()}
    assert got == want


def test_odd_texts_in_small_blocks(spark, libraries, monkeypatch, tmp_path):
    rng = random.Random(2)
    chars = " \n\t.,'abcdesté漢▁\xa0"
    texts = ODD + ["".join(rng.choice(chars[: rng.choice([9, 16, 18])]) for _ in range(rng.randrange(1, 60))) for _ in range(300)] + [None, "same text", "same text"]
    (tmp_path / "documents.parquet").mkdir()
    frame = spark.createDataFrame([(k, t, "n", 1) for k, t in enumerate(texts)], "doc_id long, text string, `a.b` string, docs int")
    frame.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) for r in alignment.query(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(brute(libraries, texts)))


def test_blocks_and_caches_do_not_change_results(libraries, monkeypatch):
    monkeypatch.setattr(alignment, "CACHED", 10)
    aligner = alignment.Aligner(open(alignment.default_vocabulary(), encoding="utf-8").read(), pieces.read_model(None)[1])
    texts = [f"word {k % 7} other{k % 5} x" for k in range(60)]
    want = brute(libraries, texts)
    for part in range(0, 60, 6):
        for w, (sizes, groups, _, _) in zip(want[part : part + 6], aligner.batch(texts[part : part + 6]), strict=True):
            assert (*sizes.tolist(), hashlib.sha256(groups.encode()).hexdigest()) == w[:5]


def test_edge_cases(spark):
    frame = spark.createDataFrame([(None, None, "x"), (None, "", "x"), (1, "word " * 20_000, None), (1, "word " * 20_000, None)], "doc_id long, text string, `a.b` string")
    aligned = alignment.align(frame).cache()
    got = alignment.scored(aligned, ["doc_id", "a.b", "n_a"]).collect()
    assert sorted((r.doc_id or 0, r.n_a) for r in got) == [(0, 0), (0, 0), (1, 20001), (1, 20001)] and {r["a.b"] for r in got} == {"x", None}
    assert alignment.scored(alignment.align(frame.limit(0)), ["doc_id"]).count() == 0
