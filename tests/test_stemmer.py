"""The stemmer against the examples of the published algorithm, and ROUGE on stems."""

from collections import Counter

import pytest
from docquery.functions import stemmer
from docquery.operators import metrics
from docquery.plans import text_plans
from pyspark.sql import functions as F

#: Words of the paper's examples and their stems after all steps.
PUBLISHED = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky
relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ
vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous
formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good
revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust
dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler
probate probat rate rate cease ceas controll control roll roll generalizations gener oscillators oscil""".split()
PAIRS = [*zip(PUBLISHED[::2], PUBLISHED[1::2], strict=True)]


@pytest.mark.parametrize("extended", [False, True])
def test_published_pairs(extended):
    differ = {"ties": "tie"} if extended else {}
    assert {w: stemmer.stem(w, extended) for w, _ in PAIRS} == dict(PAIRS) | differ


def test_extended_words():
    pairs = {"dying": "die", "skies": "sky", "news": "news", "dies": "die", "died": "die", "spied": "spi", "enjoy": "enjoy", "say": "say", "by": "by", "flies": "fli", "denied": "deni", "biology": "biolog", "owned": "own", "itemization": "item", "traditional": "tradit", "reference": "refer", "colonizer": "colon", "plotted": "plot", "humbled": "humbl", "meeting": "meet"}
    assert {w: stemmer.stem(w) for w in pairs} == pairs


def rouge(r, h, kind):
    """The score by its definition."""
    import re

    r, h = (stemmer.stems(re.findall("[a-z0-9]+", t.lower())) for t in (r or "", h or ""))
    if kind == "l":
        table = [[0] * (len(h) + 1) for _ in range(len(r) + 1)]
        for i, x in enumerate(r):
            for j, y in enumerate(h):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        match, n, m = table[-1][-1], len(h), len(r)
    else:
        a, b = (Counter(zip(*[t[k:] for k in range(kind)])) for t in (r, h))
        match, n, m = sum((a & b).values()), sum(b.values()), sum(a.values())
    return 2 * match / (n + m) if match else 0.0


def test_rouge_on_stems(spark):
    rows = [("The cats were running quickly", "a cat runs quick"), ("relational databases", "Relate the database"), ("", "x"), (None, "x"), ("same same", "same")]
    rows += [(r.reference[:600], r.answer[:600]) for r in text_plans.pairs(spark, "/root/testdata/sf0.001").limit(25).collect()]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, r string, h string").coalesce(2)
    got = frame.select("k", *[metrics.rouge_n(F.col("r"), F.col("h"), n, stems=True).alias(f"r{n}") for n in (1, 2)], metrics.rouge_l(F.col("r"), F.col("h"), stems=True).alias("rl")).collect()
    for g in got:
        r, h = rows[g.k]
        assert (g.r1, g.r2, g.rl) == tuple(pytest.approx(rouge(r, h, kind)) for kind in (1, 2, "l")), rows[g.k]
    assert got[0].r1 > 0.4 and frame.select(metrics.rouge_n(F.col("r"), F.col("h"), 1).alias("x")).collect()[0].x == 0
