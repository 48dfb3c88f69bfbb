"""Fill-in-the-middle against slicing, whatever the size of chunks; the automaton against regular expressions."""

import hashlib
import os
import random
import re

import numpy as np
import pytest

from lexmill.llm import fim

COLUMNS = "doc_id long, text string, output string, form int"


def expected(doc_id, text, units, plain_from=90, spm_below=20):
    """Units are the places where one begins."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    starts = units(text)
    n = len(starts)
    if n == 0 or re.search("<[PSM]>", text) or h3 % 100 >= plain_from:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    place = lambda k: 0 if k == 0 else len(text) if k == n else starts[k]
    prefix, middle, suffix = text[: place(a)], text[place(a) : place(b)], text[place(b) :]
    if h4 % 100 < spm_below:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


UNITS = {
    "chars": lambda t: list(range(len(t))),
    "words": lambda t: [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)],
    "lines": lambda t: [0] * bool(t) + [m.end() for m in re.finditer("\n", t) if m.end() < len(t)],
}


def sample():
    rng = random.Random(5)
    letters = ["a", "b", " ", "\n", "é", "漢", "😀", "<", "P", ">", "S", "\t", " "]
    rows = [(i, "".join(rng.choices(letters, k=rng.choice([0, 1, 5, 60, 300, 3000])))) for i in range(120)]
    rows += [(200, "x" * 5000 + "<M>"), (201, "<" * 700), (202, "<P"), (203, "P>" * 9), (204, None), (None, "no id " * 90), (None, "no id " * 90), (205, "é" * 2000), (206, "\n \n")]
    return rows + [rows[7], (7, "other text, same id")]


@pytest.mark.parametrize(("unit", "chunk"), [("chars", 1 << 20), ("chars", 64), ("words", 301), ("lines", 1000), ("words", 1 << 20)])
def test_same_as_slicing(spark, unit, chunk):
    rows = sample()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], COLUMNS)
    out = fim.fill_in_middle(docs, unit=unit, chunk=chunk)
    got = out.withColumn("back", fim.restored(out.output, out.form)).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[-1])
    have = sorted([(r.doc_id, r.n, r.form, r.prefix_units, r.middle_units, r.output) for r in got], key=order)
    assert have == sorted([(i, *expected(i, t, UNITS[unit])) for i, t in rows], key=order)
    assert sorted(r.back for r in got) == sorted(t or "" for _, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_functions_compose_whatever_the_cut():
    rng = random.Random(3)
    for unit, units in UNITS.items():
        automaton = fim.Automaton(unit)
        for _ in range(40):
            text = "".join(rng.choices("ab <PSM>\n\té漢", k=rng.randrange(1500)))
            whole = text.encode()
            cuts = sorted(rng.choices(range(len(whole) + 1), k=5))
            parts = [whole[a:b] for a, b in zip([0, *cuts], [*cuts, len(whole)], strict=True)]
            ends, n = fim.scanned(fim.Scan(automaton, parts).functions(), np.zeros(len(parts), int))
            assert n[-1, 0] == len(units(text)) and automaton.found[ends[-1, 0]] == bool(re.search("<[PSM]>", text))
            left = fim.Scan(automaton, parts[:3]).functions()
            left = fim.compose(fim.compose(*[tuple(f[i : i + 1] for f in left) for i in (0, 1)]), tuple(f[2:3] for f in left))
            assert (left[0] == ends[2:3]).all() and (left[1] == n[2:3]).all()


def test_empty_table(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], COLUMNS)).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_same_as_sql(spark):
    import duckdb

    from lexmill.llm import queries

    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    got = queries.op11_fim_automaton(spark, "/root/testdata/sf0.001")
    cursor = con.execute(queries.ORACLES["op11_fim_automaton"])
    assert [d[0] for d in cursor.description] == got.columns
    assert sorted(cursor.fetchall()) == sorted(map(tuple, got.collect()))
