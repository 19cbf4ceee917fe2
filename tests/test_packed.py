from ionloom.operators import packed
from ionloom.operators.packed import unpack


def items(spark, texts):
    df = spark.createDataFrame([(i, t, "other") for i, t in enumerate(texts)], "lib_row_id long, genes string, text string")
    out = {}
    for r in unpack(df, "lib_row_id", ["genes"]).orderBy("row_id", "item_pos").collect():
        assert r.item_pos == len(out.setdefault(r.row_id, []))
        out[r.row_id].append(r.item_value)
    return [out.get(i, []) for i in range(len(texts))]


def test_dialects(spark):
    got = items(spark, ["A;B;;C;", "A, B|C D", '"Zinc, x; y";Q-1', '["A", "B.2"]', "sp|X1|Y_Z/tr|P2|Q_W", '"the ""J"" one" , K', '["the \\"J\\" one"]', "A\tB", " A ", "X|Y", '"A"|"B C"'])
    assert got == [["A", "B", "C"], ["A", "B", "C", "D"], ["Zinc, x; y", "Q-1"], ["A", "B.2"], ["sp|X1|Y_Z", "tr|P2|Q_W"], ['the "J" one', "K"], ['the "J" one'], ["A", "B"], ["A"], ["X", "Y"], ["A", "B C"]]


def test_dirt(spark):
    got = items(spark, [None, "", " ; , ", '""', '"  "', '"open; A', "A;A", "[]"])
    assert got == [[], [], [], [], [], ["open; A"], ["A", "A"], []]
    assert items(spark, []) == []


def test_long_field(spark):
    n = 20_000
    assert [len(x) for x in items(spark, [";".join(f"V{i}" for i in range(n)), '"' + 'a""' * n + '"'])] == [n, 1]


def test_accessions_joined_by_bars_and_rare_separators(spark):
    got = items(spark, ["sp|A1|B_C|sp|D2|E_F", "A#B~C", '"x (y), z"+Q', "tr|X1-2|Y_Z,G.1", "sp|A"])
    assert got == [["sp|A1|B_C", "sp|D2|E_F"], ["A", "B", "C"], ["x (y), z", "Q"], ["tr|X1-2|Y_Z", "G.1"], ["sp", "A"]]


def test_value_codes_decide(spark):
    """Names with a colon inside, each of parts that never stand alone: only the counts of values tell that it doesn't separate."""
    names = [f"{a}{b}:{c}{d}" for a, b, c, d in zip("ABCDEFGHIJ" * 2, "KLMNOPQRST" + "LMNOPQRSTK", "UVWXYZABCD" + "VWXYZABCDU", "0123456789" + "9876543210")]
    texts = [";".join(names[(i + k * step) % 20] for k in range(3)) for i in range(20) for step in range(1, 10)] + ["P/Q", "A-1/B-2", "P;Q/A-1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "lib_row_id long, genes string")
    whole = {r.row_id for r in unpack(df, "lib_row_id", ["genes"]).filter("item_value like '%:%'").collect()}
    flat = {r.row_id for r in unpack(df, "lib_row_id", ["genes"], value_codes=False).filter("item_value like '%:%'").collect()}
    assert whole == set(range(180)) and flat == set()
    got = {}
    for r in unpack(df, "lib_row_id", ["genes"]).collect():
        got.setdefault(r.row_id, {})[r.item_pos] = r.item_value
    assert [[got[k][i] for i in range(len(got[k]))] for k in (0, 180, 181, 182)] == [texts[0].split(";"), ["P", "Q"], ["A-1", "B-2"], ["P", "Q", "A-1"]]


def test_every_subset_of_separators_is_a_candidate():
    """Two of four marks separate; the other two stand inside the names."""
    n, got = packed.candidates("A:B/C;D:E/F,G:H/I;J:K/L")
    parses = [v for v, _, _ in got]
    assert ["A:B/C", "D:E/F", "G:H/I", "J:K/L"] in parses and n == len(parses) == 16


def test_many_marks(monkeypatch):
    text = 'A!B@C#D"x""y;z"'
    few = packed.candidates(text)
    few = few[0], list(few[1])
    monkeypatch.setattr(packed, "HELD", 0)
    many = packed.candidates(text)
    assert few == (many[0], list(many[1])) and few[0] == len(few[1])
    n, got = packed.candidates("A!B@C#D$E%F^G&H*I(J")
    assert n == 2**9 == len({tuple(v) for v, _, _ in got})
