import numpy as np

from ionloom.llm import subjects as S


def make(spark, n=240):
    rng = np.random.default_rng(0)
    terms = {"law": ["licence clause", "court ruling", "patent claim"], "sport": ["league table", "goalkeeper", "relay team"]}
    frame = ["The old {} was replaced.", "Why does the {} change?", "Most trouble came from the {}, as agreed on day 7."]
    docs, labels = [], []
    for i in range(n):
        s = ["law", "sport"][i % 2]
        sents = [frame[rng.integers(3)].format(terms[s][rng.integers(3)]) for _ in range(6)] + ["See the table for details."]
        docs.append((i, ("\n" if i % 3 else " ").join(sents) + ("\nThis page may be copied under the licence clause." if i % 4 == 0 else ""), "clash"))
        if i % 4 < 2:
            labels.append((i, s, "a"))
            labels.append((i, s, "a"))
            if i % 10 == 0:
                labels.append((i, "sport", "b"))
    d = spark.createDataFrame(docs, "doc_id long, text string, subject string")
    lab = spark.createDataFrame([*labels, (None, "law", "a"), (1, None, None), (5, "nonsense", "a")], "doc_id long, subject string, annotator string")
    areas = spark.createDataFrame([("law", "x"), ("sport", "y"), (None, "z")], "subject string, description string")
    return d, lab, areas


def test_held_out_accuracy(spark):
    d, lab, areas = make(spark)
    got = {}
    for r in S.subjects(d, lab, areas).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(got.get(i) == {["law", "sport"][i % 2]} for i in range(240))
    assert right >= 0.95 * 240


def test_quotes_do_not_count():
    class Always:
        def subjects(self, sentences):
            return [0 if "claim" in words else -1 for words in sentences]

    quoted = frozenset(S.shape("the claim stands for 12 years")[j : j + 5] for j in range(2))
    read = lambda text, quoted: list(S.read_documents([text], Always(), quoted, {}))[0][1]
    text = "Nothing here. The claim stands. The claim stands for 9 years."
    assert read(text, frozenset()) == [-1, 0, 0]
    assert read(text, quoted) == [-1, 0, -1]
    assert read("1 2 3. No end", quoted) == []


def test_footers_and_shares(spark):
    row = lambda i, hashes, found: (i, hashes, found)
    read = spark.createDataFrame([row(i, [1, 7], [0, 1]) for i in range(9)] + [row(20 + i, [8, 9 + i], [0, 0]) for i in range(5)] + [row(30, [7, 2], [1, 0])] + [row(40 + i, [8], [0]) for i in range(6)], "doc_id long, hashes array<long>, found array<byte>")
    assert [r.last for r in S.page_footers(read).collect()] == [7]


def test_gradients_do_not_depend_on_the_partitions():
    words = [["ab", "cd"], ["ab"], ["ef", "ab", "ab"]]
    y = np.array([[1.0, 0.0], [0.5, 0.5], [0.0, 1.0]], np.float32)
    rng = np.random.default_rng(1)
    weights = (rng.normal(size=(S.SLOTS, S.DIM)).astype(np.float32), rng.normal(size=(S.DIM, 2)).astype(np.float32), np.zeros(2, np.float32))

    def total(parts):
        out = [np.zeros((S.SLOTS, S.DIM)), np.zeros((S.DIM, 2)), np.zeros(2)]
        for ids in parts:
            x = S.packed_examples([words[i] for i in ids], [y[i] for i in ids])
            used, *g = S.gradient(weights, x, np.ones(len(ids), np.float32))
            out[0][used] += g[0]
            out[1] += g[1]
            out[2] += g[2]
        return out

    def loss(w):
        e, o, b = w
        vec = {x: e[S.features(x)].mean(axis=0) for x in ("ab", "cd", "ef")}
        z = np.array([np.mean([vec[x] for x in ws], axis=0) for ws in words]) @ o + b
        return float((np.logaddexp(0, z) - y * z).sum())

    one, three = total([[0, 1, 2]]), total([[2], [0], [1]])
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(one, three))
    k, h = S.features("cd")[0], 1e-2
    up, down = (tuple(x.astype(float).copy() for x in weights) for _ in range(2))
    up[0][k, 3] += h
    down[0][k, 3] -= h
    assert abs((loss(up) - loss(down)) / (2 * h) - one[0][k, 3]) < 1e-3


def test_sentences():
    text = "# Title\n\n08:10  First one. user_a: no\n- Second \"one\". Third?\nuser_b: Fourth!\n```\nx = 1. y\n```\n--\n1.5 2.5\nNo end"
    assert S.sentences(text) == ["First one.", 'Second "one".', "Third?", "Fourth!"]


def test_dirt_and_empty(spark):
    d, lab, areas = make(spark, 40)
    odd = spark.createDataFrame([(900, None, ""), (901, "", ""), (902, "1 2 3.", ""), (None, "The court ruling.", ""), (903, "word " * 200_000 + ".", "")], d.schema)
    got = S.subjects(d.unionByName(odd), lab, areas)
    assert not {900, 901, 902, None} & {r.doc_id for r in got.select("doc_id").collect()}
    assert S.subjects(d, lab.limit(0), areas).count() == 0
    assert S.subjects(d.limit(0), lab, areas).count() == 0
    assert S.subjects(d, lab, areas.limit(0)).count() == 0
