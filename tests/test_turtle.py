"""Turtle read in parts: triples do not depend on where a file is cut."""

import hashlib
import json
import random
import re

import pandas as pd
import pytest

from quillgraph.sources import turtle
from quillgraph.sources.turtle_text import lines_of, parse


def document(seed, n):
    rnd = random.Random(seed)
    out = ["@prefix ex: <http://e/> .", "@base <http://b/> ."]
    for k in range(n):
        kind = rnd.random()
        if kind < 0.15:
            names = ["PREFIX ex:\n  <http://e{0}/>", "@prefix\nex: <http://f{0}/>\n.", "base <http://b{0}/>", "@base <sub{0}/> .", "PREFIX q: <http://q/>", "PREFIX\nex:\n<rel{0}>"]
            out.append(rnd.choice(names).format(k))
        elif kind < 0.35:
            lines = "\n".join(f"line . {j} '''" for j in range(rnd.randint(0, 9)))
            out.append(f'ex:s{k} ex:p """long . text\n@prefix ex: <no> .\n\'\'\' "" x \\" é\r\n\n{lines} end"""@en , \'\'\'a\n"""b\'\'\' .')
        elif kind < 0.55:
            out.append(f'ex:s{k} ex:p [ ex:q 1.5 ; ex:r ( 1 2\n "x.y" ) ] ;\n\n a ex:C , <rel> . [] ex:p [] .')
        elif kind < 0.65:
            out.append('# comment """ . \n')
        else:
            out.append(f'ex:s{k} ex:p ex:o{k} , "a . b" ; ex:q true . <x> ex:p _:n{k % 7} . ex:t a ex:T .')
    return "\n".join(out)


def in_parts(text, cuts):
    """What the two passes make of a file that is cut before the lines `cuts`."""
    lines = [x[:-1] for x in lines_of(text)]
    bounds = sorted({0, *cuts, len(lines)})
    parts = [(b, lines[b:e]) for b, e in zip(bounds, bounds[1:], strict=False)]
    frame = lambda start, part, **more: pd.DataFrame({"graph_id": "g", "start": start, "value": part, **more})
    scans = pd.concat(turtle._scanned(iter([frame(*p) for p in parts])))
    entries = turtle._entries(scans).set_index("start")
    told = [frame(b, part, whole=False, **{c: entries[c].get(b) for c in ("quote", "line", "opened", "names")}) for b, part in parts]
    own = [tuple(r) for f in turtle._own(iter(told)) for r in f.itertuples(index=False)]
    true = scans.merge(entries.drop(columns="graph_id").reset_index(), on=["start", "quote"])
    pieces = []
    for r in true.to_dict("records"):
        if r["opens"] and (r["ends"] or not r["opened"]):
            pieces.append(("g", r["start"], r["start"], r["tail"] or r["head"], r["line"] + r["tail_line"], r["tail_column"], r["names_after"]))
        if r["opened"]:
            pieces.append(("g", r["owner"], r["start"], r["head"], None, None, None))
    if pieces:
        table = pd.DataFrame(pieces, columns=["graph_id", "owner", "start", "piece", "line", "column", "names"])
        own += [tuple(r) for _, group in table.groupby("owner") for r in turtle._crossing(group).itertuples(index=False)]
    return {r[1:] for r in own}


@pytest.mark.parametrize("seed", range(6))
def test_any_cuts_give_the_same_triples(seed):
    text = document(seed, 40)
    whole, n = set(parse(text, "g")), text.count("\n") + 1
    rnd = random.Random(seed)
    assert in_parts(text, []) == whole
    assert in_parts(text, range(n)) == whole  # every line for itself
    for size in (1, 2, 5, 20):
        assert in_parts(text, rnd.sample(range(n), size)) == whole


def test_errors_keep_their_place_in_parts():
    text = document(1, 10) + "\nex:a ex:b ;;; ~ .\nex:a ex:b ex:c ."
    with pytest.raises(ValueError, match="unexpected '~"):
        parse(text)
    with pytest.raises(ValueError, match="g: unexpected '~"):
        in_parts(text, range(0, text.count("\n"), 3))
    for cuts in ([], [5], range(40)):
        with pytest.raises(ValueError, match="has no end"):
            in_parts(document(2, 8) + '\nex:a ex:b """never', cuts)
        with pytest.raises(ValueError, match="has no end"):
            in_parts(document(2, 8) + "\n<a> <b>\n<c>", cuts)
    with pytest.raises(ValueError, match="nested"):
        parse("<a> <b> " + "(" * 5000 + " .")


@pytest.mark.parametrize("most_parts", [turtle.MOST_PARTS, 0])
def test_files_in_splits(spark, tmp_path, monkeypatch, most_parts):
    monkeypatch.setattr(turtle, "MOST_PARTS", most_parts)
    text = document(9, 300)
    (tmp_path / "a.ttl").write_bytes(text.encode())
    (tmp_path / "b.ttl").write_text("@prefix z: <http://z/> . z:a z:b z:c .")
    (tmp_path / "c.ttl").write_text("")
    plain = lambda t: re.sub(r"^_:\w*?ttl", "_:", t)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        for size, least in ((1 << 27, 1), (4000, 5)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert len({r.start for r in turtle._lines(spark, str(tmp_path)).collect()}) >= least
            rows = turtle.read(spark, str(tmp_path)).collect()
            got = {tuple(map(plain, r[1:])) for r in rows if r.graph_id.endswith("a.ttl")}
            assert got == {tuple(map(plain, x)) for x in parse(text, "attl")}
            assert [tuple(r)[1:] for r in rows if r.graph_id.endswith("b.ttl")] == [("<http://z/a>", "<http://z/b>", "<http://z/c>")]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_written_files_read_back(spark, tmp_path):
    rows = [("g1", f"<http://e/{k}>", "<http://e/p>", json.dumps(f"text {k}\n. ü \"q\"", ensure_ascii=False)) for k in range(50)]
    rows += [("g2", "<http://e/1>", "<http://e/p>", "<http://e/2>"), ("g2", "_:x", "<http://e/p>", '"a"@en')]
    triples = spark.createDataFrame(rows, "graph_id string, s string, p string, o string")
    turtle.write(triples, str(tmp_path / "out"))
    got = turtle.read(spark, str(tmp_path / "out")).collect()
    assert not got  # text files of Spark do not end in .ttl
    back = turtle.read(spark, str(tmp_path / "out"), "*.txt").collect()
    strip = lambda t: "_:x" if t.startswith("_:") else t
    assert {("g1" if "graph_id=g1" in r.graph_id else "g2", strip(r.s), r.p, r.o) for r in back} == set(rows)


def test_scope_of_labels():
    a, b = parse("_:x <http://p> [] .", "f1"), parse("_:x <http://p> [] .", "f2")
    assert a[0][0] != b[0][0] and a[0][2] != b[0][2] and hashlib.md5(str(a).encode()).hexdigest() == hashlib.md5(str(parse("_:x <http://p> [] .", "f1")).encode()).hexdigest()
