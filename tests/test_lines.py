from ionloom.operators.lines import parse_lines, rejected, transitions

H = "ModifiedPeptide\tFragmentType\tFragmentCharge\tFragmentLossType\tProteinName"
SCHEMA = "line_id long, file_name string, line_no int, raw_line string, header string, status int"


def frame(spark, lines, header=H):
    rows = [(0, "f", 1, header, "x", 1)] if header is not None else []
    return spark.createDataFrame(rows + [(i + 1, "f", i + 2, x, None, None) for i, x in enumerate(lines)], SCHEMA)


def reasons(spark, lines, header=H):
    out = {}
    for r in rejected(frame(spark, lines, header)).collect():
        out.setdefault(r.line_id, []).append(r.reason)
    return out


def test_reasons(spark):
    good = "P\ty\t2\tnoloss\tx"
    lines = [
        good, good + "\r", "P\tyy\t2\tnoloss\tx", "P\tq\t0\tH20\tx", "P\ty\t1\tnoloss", good + "\tz",
        'P\ty\t1\tnoloss\t"a\tb\n""c"""', 'P\ty\t1\tnoloss\t"a"b', 'P\ty\t1\tnoloss\t"a', 'P"\ty\t1\tnoloss\ta"b', H, "﻿" + H + "\r", "   ", "", None,
        "P\ty\t127\tnoloss\tx", "P\ty\t128\tnoloss\tx", "P\ty \t１\t noloss\tx", '"P"x\tq\t1', "P\t\t\t\t",
    ]
    assert reasons(spark, lines) == {
        3: ["fragment_type"], 4: ["fragment_type", "fragment_charge", "fragment_loss_type"], 5: ["column_count"], 6: ["column_count"], 8: ["quoting"], 9: ["quoting"],
        17: ["fragment_charge"], 18: ["fragment_type", "fragment_charge", "fragment_loss_type"], 19: ["quoting"], 20: ["fragment_type", "fragment_charge", "fragment_loss_type"],
    }


def test_bom_and_carriage_return_header(spark):
    assert reasons(spark, ["P\ty\t1\tnoloss\tx", H + "\r"], "﻿" + H + "\r") == {}


def test_no_header_and_empty(spark):
    assert reasons(spark, ["a\tb"], None) == {1: ["column_count"]}
    assert parse_lines(frame(spark, [], None)).count() == 0


def test_long_fields_and_first_broken(spark):
    long = "P\ty\t1\tnoloss\t" + '"' + 'a""' * 200_000 + '"'
    assert reasons(spark, [long, long + "x"]) == {2: ["quoting"]}
    got = parse_lines(frame(spark, ["P\tq\t1\tnoloss\tx"]), ("rejected",)).first()
    assert got.first_broken == 1


def test_transitions_typed(spark):
    r = transitions(frame(spark, ['P\ty\t2\tnoloss\t"x ""y"""'])).first()
    assert (r.modified, r.frag_type, r.frag_charge, r.loss, r.precursor_mz) == ("P", "y", 2, "noloss", None)


def test_salted_join_equals_broadcast(spark, sf, monkeypatch):
    import ionloom.runtime as rt

    df = spark.read.parquet(f"{sf}/sample_lib_raw.parquet")
    a = sorted(map(tuple, rejected(df).collect()))
    monkeypatch.setattr(rt, "fits_broadcast", lambda *x: False)
    monkeypatch.setattr(rt, "HOT_ROWS", 10)
    assert sorted(map(tuple, rejected(df).collect())) == a
