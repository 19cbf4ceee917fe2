import random

from ionloom.llm.leaks import build_index, leaks, search, term_of, words

ITEM = "Given 8367 replicates and a holdout set measured 9229 times, estimate how far the boosted tree may differ from 8592 once every fold is excluded"


def found(spark, texts, items=((1, ITEM),), **kw):
    docs = spark.createDataFrame([(i, t, "x", 9) for i, t in enumerate(texts)], "doc_id long, text string, item_id string, terms int")
    its = spark.createDataFrame(list(items), "item_id long, text string")
    return sorted((r.doc_id, r.item_id) for r in leaks(docs, its, **kw).collect())


def test_forms(spark):
    w = ITEM.split()
    shy, zwsp = chr(0xAD), chr(0x200B)
    texts = [
        "x " + ITEM, ITEM.upper(), " ".join(w[3:15]), " ".join(w[3:14]), "> " + "\n> ".join(" ".join(w[i : i + 4]) for i in range(0, len(w), 4)),
        ITEM.replace("replicates", "repli-\n  cates"), ITEM.replace("holdout", f"hold{shy}out").replace("measured", f"mea{zwsp}sured"), ITEM.replace("8367", "".join(chr(0xFF10 + int(c)) for c in "8367")),
        ITEM.replace("holdout set", "<b>holdout</b>&nbsp;**set**"), " ".join(x + (" perhaps" if i % 5 == 4 else "") for i, x in enumerate(w)), None, "", ITEM + " " + ITEM, ITEM.replace("fold", "fo-\n> ld"), ITEM.replace("differ", "di" + chr(0xFB00) + "er"),
    ]
    assert [d for d, _ in found(spark, texts)] == [0, 1, 2, 4, 5, 6, 7, 8, 12, 13, 14]
    assert 9 in [d for d, _ in found(spark, texts, slack=3)]


def test_short_items_null_items_and_empty_tables(spark):
    assert found(spark, [ITEM], [(1, "two words"), (2, None), (None, ITEM), (3, ""), (4, ITEM)]) == [(0, 4)]
    assert found(spark, []) == [] and found(spark, [ITEM], [(1, "a")]) == []


def test_matches_do_not_cross_documents(spark):
    w = ITEM.split()
    assert found(spark, [" ".join(w[:8]), " ".join(w[8:])]) == [(1, 1)]
    assert found(spark, [" ".join(w[:11]), " ".join(w[11:22])]) == []


def test_natural_hyphen_at_line_end(spark):
    item = "the half-marathon of batch 6402 is raised to 8563 units while its flow holds near 4"
    assert found(spark, [item.replace("half-marathon", "half-\nmarathon")], [(1, item)]) == [(0, 1)]


def test_against_brute_force_with_common_words(spark):
    rng = random.Random(2)
    vocab = ["the", "of", "a", "to", "ion"]
    items = [(i, " ".join(rng.choices(vocab, k=16))) for i in range(8)]
    texts = [" ".join(rng.choices(vocab, k=300)) for _ in range(40)] + [" ".join(rng.choices(vocab, k=5) + items[3][1].split()[2:14]), items[5][1] * 3]
    grams = {}
    for i, t in items:
        ws = words(t)
        for k in range(len(ws) - 4):
            grams.setdefault(tuple(ws[k : k + 5]), set()).add(i)
    want = set()
    for d, t in enumerate(texts):
        ws = words(t)
        for k in range(len(ws) - 4):
            want |= {(d, i) for i in grams.get(tuple(ws[k : k + 5]), ())}
    assert found(spark, texts, items, min_words=5) == sorted(want)
    assert found(spark, texts, items, min_words=5, blocks=3) == sorted(want)


def test_long_text(spark):
    assert found(spark, ["word " * 400_000 + ITEM, "a" * 2_000_000]) == [(0, 1)]


def test_one_index_for_any_items(spark, monkeypatch):
    w = ITEM.split()
    other = "a second held out passage of fourteen plain words that nobody has seen before today"
    docs = spark.createDataFrame([(1, ITEM), (2, other.upper()), (3, "x " * 40)], "doc_id long, text string")
    index = build_index(docs)
    monkeypatch.setattr("ionloom.llm.leaks.build_index", None)
    ask = lambda text, **kw: [(r.doc_id, r.item_id) for r in search(index, docs, spark.createDataFrame([(9, text)], "item_id long, text string"), **kw).collect()]
    assert ask(ITEM) == [(1, 9)] and ask(other) == [(2, 9)] and ask(" ".join(w[:8] + ["new"] + w[8:16])) == []
    assert ask(" ".join(w[:8] + w[9:16]), slack=1) == [(1, 9)]
    terms = {r.term for r in index.select("term").collect()}
    assert {term_of(x) for x in words(ITEM) + other.split() + ["x"]} == terms


def test_split_words_in_both_readings(spark):
    """A passage in which one split word is a single word of the item and another is two."""
    item = "the half-marathon of batch 6402 is raised to 8563 units while its flow holds near 4"
    text = item.replace("half-marathon", "half-\nmarathon").replace("raised", "rai-\n sed").replace("units", "un-\nits")
    assert found(spark, ["word " * 50 + text + " and so on" * 20], [(1, item)]) == [(0, 1)]
