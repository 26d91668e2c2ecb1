import random
from collections import Counter

from filament.llm import reading

EASY = "the cat sat on a mat and saw the dog".split()
PLAIN = "samples were stored before release because several donors agreed with the protocol".split()
HARD = "chromatin accessibility measurements were normalised against reference assemblies under stringent conditions".split()
DENSE = "notwithstanding heteroscedastic residuals the parameterisation precludes unequivocal inference regarding regulatory architecture".split()
LEVELS = {1: (EASY, 6), 2: (PLAIN, 14), 3: (HARD, 22), 4: (DENSE, 35)}


def text(level, r):
    out = []
    for _ in range(r.randint(3, 9)):
        words, n = LEVELS[level if r.random() < 0.75 else r.choice([1, 2, 3, 4])]
        out.append(" ".join(r.choices(words, k=n)).capitalize() + ".")
    return " ".join(out) + "\n| a | b |\n>X1\nACGT ACGT\n"


def tables(spark, n=200, seed=1):
    r = random.Random(seed)
    levels = [r.choice([1, 2, 3, 4]) for _ in range(n)]
    docs = spark.createDataFrame([(i, text(v, r), 0) for i, v in enumerate(levels)], "doc_id long, text string, reading_level int")
    return docs, levels


def test_held_out_levels(spark):
    docs, levels = tables(spark)
    labels = spark.createDataFrame([(i, v) for i, v in enumerate(levels) if i % 2], "doc_id long, reading_level int")
    got = {r.doc_id: r.reading_level for r in reading.reading_levels(docs, labels, docs, step=3).collect()}
    assert set(got) == {i for i in range(len(levels)) if i % 2 == 0}
    assert sum(got[i] == levels[i] for i in got) / len(got) >= 0.9


def test_document_frequencies(spark):
    texts = ["The cat, the dog", "a Cat", None, " ", "dog's cat"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    expected = Counter()
    for t in texts:
        expected.update(set(reading._WORD.findall((t or "").lower())))
    assert {r.word: r.df for r in reading.document_frequencies(df, "text").collect()} == {**expected, "": 3}


def test_edges(spark):
    docs, levels = tables(spark, 60)
    labels = spark.createDataFrame([(i, v) for i, v in enumerate(levels)] + [(3, None), (None, 2), (7, 9)], "doc_id long, reading_level int")
    more = spark.createDataFrame([(1000, None, 0), (1001, "", 0), (1002, "| a | b |", 0), (1003, "one", 0), (1004, "the cat sat on a mat. " * 3000, 0), (1004, "the cat sat on a mat.", 0)], docs.schema)
    got = sorted((r.doc_id, r.reading_level) for r in reading.reading_levels(docs.unionByName(more), labels, docs).collect())
    assert got == [(1002, 2), (1003, 2), (1004, 1), (1004, 1)]
    assert reading.reading_levels(docs, labels.limit(0), docs).count() == 0
    assert reading.reading_levels(docs.limit(0), labels, docs).count() == 0


def test_sentences():
    assert reading.sentences("A b c. D e!\n| x | y |\n$ run it\n>seq\nOne\nf g") == [["a", "b", "c"], ["d", "e"], ["f", "g"]]


def test_formula_against_brute_force():
    import numpy as np

    r = random.Random(5)
    sentences = [[r.choice([r.randrange(45), 45]) for _ in range(r.randint(1, 9))] for _ in range(50)]
    got = reading.formula(np.array([w for s in sentences for w in s]), np.array(list(map(len, sentences))), 45, 10)
    expected = [[sum(w >= min(cut, 45) for w in s) / len(s) for cut in (10, 20, 30, 40, 45)] + [np.log(len(s))] for s in sentences]
    assert np.allclose(got, expected, atol=1e-6)
