"""Glyph dumps and labelled statements as a data source: round trips, commits, streams."""

from __future__ import annotations

import json
import pickle
import random
from datetime import date
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import geometry, importing
from tallyspark.operators.pages import Glyphs
from tallyspark.sources import document_files as files
from tallyspark.sources import glyph_json, statements

from .test_pages import SCHEMA, SIX, statement

NAMES = ["stmt.2026-01", "stmt.2026-02", "a/b c%", "_hidden", ".dot", "ünï ☃", "x" * 80, "..", "plain.json"]


def glyph_rows(names, seed=1):
    rng = random.Random(seed)
    return [(n, k, rng.choice(["a", "₹", "\"", "\\", "\n", "é", ""]), k // 4, rng.uniform(-5, 600), rng.random() * 800, 4.0, 8.25) for n in names for k in range(rng.randrange(1, 9))]


def rows_of(frame):
    return sorted(map(tuple, frame.collect()))


def test_documents_come_back_as_they_were(spark, tmp_path):
    rows = glyph_rows(NAMES)
    statements.write_glyphs(spark.createDataFrame(rows, SCHEMA).orderBy(F.rand(3)), str(tmp_path))
    assert rows_of(statements.read_glyphs(spark, str(tmp_path))) == sorted(rows)
    assert rows_of(statements.read_glyphs(spark, f"file://{tmp_path}")) == sorted(rows)
    assert len(list(tmp_path.glob("*.json"))) + len(list(tmp_path.glob(".*.json"))) == len(NAMES) and not list((tmp_path / files.STAGED).iterdir())
    assert all(files.document_of(files.file_of(n)) == n for n in NAMES)


def test_a_document_written_again_replaces_the_one_before(spark, tmp_path):
    first, again = glyph_rows(["one", "two"]), glyph_rows(["two", "three"], 2)
    statements.write_glyphs(spark.createDataFrame(first, SCHEMA), str(tmp_path))
    statements.write_glyphs(spark.createDataFrame(again, SCHEMA), str(tmp_path))
    assert rows_of(statements.read_glyphs(spark, str(tmp_path))) == sorted([r for r in first if r[0] == "one"] + again)
    statements.write_glyphs(spark.createDataFrame(first, SCHEMA), str(tmp_path), mode="overwrite")
    statements.write_glyphs(spark.createDataFrame(first, SCHEMA), str(tmp_path / "new"), mode="overwrite")
    assert rows_of(statements.read_glyphs(spark, str(tmp_path / "new"))) == sorted(first)
    assert rows_of(statements.read_glyphs(spark, str(tmp_path))) == sorted(first)


def test_dumps_made_elsewhere(spark, tmp_path):
    """Integers as numbers; errors name the file and the glyph."""
    (tmp_path / "stmt.2026-01.json").write_text(json.dumps([{"text": "05/08/26", "page": 0, "x": 40, "y": 200.0, "w": 34, "h": 8}]))
    (tmp_path / "empty.json").write_text("[]")
    assert rows_of(statements.read_glyphs(spark, str(tmp_path))) == [("stmt.2026-01", 0, "05/08/26", 0, 40.0, 200.0, 34.0, 8.0)]
    for bad, why in (({"text": "a"}, "is an array"), ([{"text": "a", "page": 0, "x": 1, "y": 2, "w": 3}], "glyph 0 needs"), ([{"text": "a", "page": 0, "x": "1", "y": 2, "w": 3, "h": 4}], "glyph 0 needs")):
        (tmp_path / "bad.json").write_text(json.dumps(bad))
        with pytest.raises(Exception, match=why):
            statements.read_glyphs(spark, str(tmp_path)).collect()
    (tmp_path / "bad.json").write_text("[{")
    with pytest.raises(Exception, match="bad.json"):
        statements.read_glyphs(spark, str(tmp_path)).collect()


def test_a_write_that_fails_leaves_nothing(spark, tmp_path):
    statements.write_glyphs(spark.createDataFrame(glyph_rows(["kept"]), SCHEMA), str(tmp_path))
    before = rows_of(statements.read_glyphs(spark, str(tmp_path)))
    rows = glyph_rows(["good", "other"])
    with pytest.raises(Exception, match="without a name"):
        statements.write_glyphs(spark.createDataFrame([*rows, (None, 0, "a", 0, 1.0, 1.0, 1.0, 1.0)], SCHEMA), str(tmp_path))
    with pytest.raises(Exception, match="one document lay in several tasks"):
        spark.createDataFrame([("d", k, "a", 0, 1.0, 1.0, 1.0, 1.0) for k in range(8)], SCHEMA).repartition(4).write.format(statements.GLYPHS).mode("append").save(str(tmp_path))
    with pytest.raises(Exception, match="JSON compliant|Out of range"):
        statements.write_glyphs(spark.createDataFrame([("n", 0, "a", 0, float("nan"), 1.0, 1.0, 1.0)], SCHEMA), str(tmp_path))
    assert rows_of(statements.read_glyphs(spark, str(tmp_path))) == before


def test_tasks_take_files_by_bytes():
    folder = files._Folder("/x")
    sizes = [("a", 20 << 20), ("b", 13 << 20), ("c", 40 << 20), ("d", 1), ("e", 1)]
    assert [p.paths for p in folder.split(sizes)] == [("a",), ("b",), ("c",), ("d", "e")]
    assert [p.paths for p in folder.split([])] == [()]


def test_labelled_statements_round_trip(spark, tmp_path):
    rows = [
        ("sbi.2026-01", "sbi", "fixtures/sbi.json", 0, date(2026, 1, 5), "SWIGGY  \"x\"", -80000), ("sbi.2026-01", "sbi", "fixtures/sbi.json", 1, date(2026, 1, 6), "REFUND", 123456789),
        ("sbi.2026-01", "sbi", "fixtures/sbi.json", 10, date(2026, 1, 6), "", 0), ("axis", "axis", "f", None, None, None, None),
    ]
    schema = "statement_id string, issuer string, glyph_fixture string, ord int, date date, description string, amount_paise long"
    statements.write_labelled(spark.createDataFrame(rows, schema), str(tmp_path))
    stored = json.loads((tmp_path / "sbi.2026-01.json").read_text())
    assert stored["statement_id"] == "sbi.2026-01" and stored["transactions"][0] == {"date": "2026-01-05", "description": "SWIGGY  \"x\"", "amount": "-800.00"}
    back = [r if r[3] != 10 else (*r[:3], 2, *r[4:]) for r in rows]  # places are counted again
    assert sorted(map(tuple, statements.read_labelled(spark, str(tmp_path)).collect()), key=str) == sorted(back, key=str)
    with pytest.raises(Exception, match="one issuer"):
        statements.write_labelled(spark.createDataFrame([rows[0], ("sbi.2026-01", "other", "f", 1, date(2026, 1, 1), "x", 1)], schema), str(tmp_path))
    (tmp_path / "bad.json").write_text(json.dumps(stored | {"transactions": [{"date": "2026-01-05", "description": "x", "amount": -800}]}))
    (tmp_path / files.LOG).rename(tmp_path / "_old")
    with pytest.raises(Exception, match="amount as text"):
        statements.read_labelled(spark, str(tmp_path)).collect()


def test_a_stream_follows_the_log_and_writes_once(spark, tmp_path):
    there, copy, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run():
        stream = statements.stream_glyphs(spark, there)
        query = stream.writeStream.format(statements.GLYPHS).option("path", copy).option("query", "copy").option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()

    first, second = glyph_rows(["a", "b"]), glyph_rows(["c"], 4)
    statements.write_glyphs(spark.createDataFrame(first, SCHEMA), there)
    run()
    assert rows_of(statements.read_glyphs(spark, copy)) == sorted(first)
    statements.write_glyphs(spark.createDataFrame(second, SCHEMA), there)
    run()
    run()
    assert rows_of(statements.read_glyphs(spark, copy)) == sorted(first + second)
    assert 2 <= len(files._Folder(copy).entries()) <= 3


def test_a_micro_batch_that_comes_again_is_written_once(tmp_path):
    folder = files._Folder(str(tmp_path))
    (tmp_path / files.STAGED).mkdir()
    for name in ("s1.json", "s2.json"):
        (tmp_path / files.STAGED / name).write_text("[]")
    folder.commit([files._Written([("a", "s1.json")]), None], name="q.0")
    folder.commit([files._Written([("a", "s2.json")])], name="q.0")
    assert len(folder.entries()) == 1 and not list(Path(tmp_path, files.STAGED).iterdir())


def test_imports_follow_a_folder_of_dumps(spark, tmp_path):
    there, done, told = str(tmp_path / "in"), [], []
    for k in range(2):
        glyphs = spark.createDataFrame(statement(random.Random(k), f"doc.{k}", SIX), SCHEMA)
        statements.write_glyphs(glyphs, there)
        query = importing.follow_imports(statements.stream_glyphs(spark, there), lambda r, n: done.append((n, r)), str(tmp_path / "state"), listen=lambda n, e: told.append((n, e.kind)))
        query.awaitTermination()
    assert [n for n, _ in done] == [0, 1] and [k for _, k in told].count("succeeded") == 2
    for k, (_, result) in enumerate(done):
        assert {r["doc_id"] for r in result.transactions.collect()} == {f"doc.{k}"} and result.events[-1].figures["transactions"] == 12
    whole = statements.read_glyphs(spark, there)
    assert geometry.extract_statements(whole).count() == 24


def test_pages_are_the_same_documents_in_fewer_bytes(spark, tmp_path):
    rows = glyph_rows(NAMES) + [("many", k, "a", 2 - k % 3, 5.0 * k, 90.0, 4.0, 8.0) for k in range(300)]
    made = spark.createDataFrame(rows, SCHEMA).groupBy("doc_id", "page").agg(F.collect_list(F.struct("glyph_ord", "text", "x", "y", "w", "h")).alias("glyphs"))
    plain, packed = str(tmp_path / "plain"), str(tmp_path / "packed")
    statements.write_glyphs(spark.createDataFrame(rows, SCHEMA), plain)
    statements.write_pages(made.coalesce(1).sortWithinPartitions("doc_id", "page"), packed)
    size = lambda p: sum(f.stat().st_size for f in Path(p).glob("many.json*"))
    assert size(packed) * 20 < size(plain) and not list(Path(packed).glob("*.json"))
    assert rows_of(statements.read_glyphs(spark, packed)) == rows_of(statements.read_glyphs(spark, plain)) == sorted(rows)
    flat = lambda p: rows_of(statements.read_pages(spark, p).select("doc_id", "page", F.inline("glyphs")).select("doc_id", "glyph_ord", "text", "page", "x", "y", "w", "h"))
    assert flat(packed) == flat(plain) == sorted(rows)
    with pytest.raises(Exception, match="one document lay in several tasks"):
        statements.write_pages(made.coalesce(1).orderBy("page"), packed)


def test_a_document_written_in_the_other_way_replaces_the_one_before(spark, tmp_path):
    first, again, path = glyph_rows(["one", "two"]), glyph_rows(["two"], 2), str(tmp_path)
    page = lambda rows: spark.createDataFrame(rows, SCHEMA).groupBy("doc_id", "page").agg(F.collect_list(F.struct("glyph_ord", "text", "x", "y", "w", "h")).alias("glyphs")).coalesce(1).sortWithinPartitions("doc_id")
    statements.write_glyphs(spark.createDataFrame(first, SCHEMA), path)
    statements.write_pages(page(again), path)
    assert rows_of(statements.read_glyphs(spark, path)) == sorted([r for r in first if r[0] == "one"] + again)
    statements.write_glyphs(spark.createDataFrame(first, SCHEMA), path)
    assert rows_of(statements.read_glyphs(spark, path)) == sorted(first)


def labelled_batch(names, amount="-1.00"):
    """Two transactions of each statement."""
    rows = [(n, "sbi", "f.json", k, "2026-01-05", "ATM", amount) for n in names for k in range(2)]
    return files.pa.RecordBatch.from_arrays([files.pa.array(c, f.type) for c, f in zip(zip(*rows), files._Labelled.fields)], schema=files._Labelled.fields)


def labelled_write(path, *tasks, amount="-1.00", overwrite=False, ending=files.ENDING):
    writer = files._BatchWriter(files._Labelled(), files._Folder(str(path)), ending, overwrite)
    told = [writer.write(iter([labelled_batch(names, amount)])) for names in tasks]
    writer.commit(told)
    return told


def labelled_read(path, start=0, stop=None):
    reader = files._BatchReader(files._Labelled(), files._Folder(str(path)))
    rows = [r for task in reader.folder.split(reader.folder.pieces(start, stop)) for b in reader.read(task) for r in b.to_pylist()]
    return sorted((r["statement_id"], r["ord"], r["amount"]) for r in rows)


def test_the_driver_holds_no_names(tmp_path, monkeypatch):
    """What tasks tell the driver, its log and what it hands to reading tasks don't grow with the documents."""
    monkeypatch.setattr(files, "CHECKED", 100)
    size = {}
    for n in (200, 2000):
        names, folder = [f"statement-{k:040d}" for k in range(n)], files._Folder(str(tmp_path / str(n)))
        told = labelled_write(folder.path, names[: n // 2], names[n // 2 :])
        size[n] = [len(pickle.dumps(x)) for x in (told, folder.split(folder.pieces()))] + [sum(Path(e).stat().st_size for e in folder.entries())]
        assert [s for s, _, _ in labelled_read(folder.path)] == sorted(2 * names)
    assert all(b < a + 100 for a, b in zip(size[200], size[2000]))


def test_lists_are_cut_into_shares(tmp_path, monkeypatch):
    monkeypatch.setattr(files, "TASK_BYTES", 20_000)
    names = [f"s{k}" for k in range(100)]
    labelled_write(tmp_path, names[:70], names[70:])
    folder = files._Folder(str(tmp_path))
    tasks = folder.split(folder.pieces())
    shares = [[files.document_of(p) for p in folder.paths(t)] for t in tasks]
    assert len(tasks) > 4 and [n for s in shares for n in s] == names and all(len(s) <= 20 for s in shares)


def test_documents_written_again_are_read_once_from_lists(tmp_path):
    labelled_write(tmp_path, ["a", "b"], ["c"])
    labelled_write(tmp_path, ["b", "d"], amount="-2.00")
    labelled_write(tmp_path, ["c"], amount="-3.00", ending=files.PACKED)
    want = {"a": "-1.00", "b": "-2.00", "c": "-3.00", "d": "-2.00"}
    assert labelled_read(tmp_path) == sorted((n, k, amount) for n, amount in want.items() for k in range(2))
    # a stream's batch has what its entries wrote and no later one replaced by another kind of file
    assert {n for n, _, _ in labelled_read(tmp_path, 0, 1)} == {"a", "b"} and {n for n, _, _ in labelled_read(tmp_path, 1, 2)} == {"b", "d"}
    labelled_write(tmp_path, ["e"], overwrite=True)
    assert {n for n, _, _ in labelled_read(tmp_path)} == {"e"}
    assert sorted(p.name for p in tmp_path.iterdir()) == [files.LISTS, files.LOG, files.STAGED, "e.json"] and len(list((tmp_path / files.LISTS).iterdir())) == 1


def test_documents_in_two_tasks_are_found_name_by_name(tmp_path, monkeypatch):
    monkeypatch.setattr(files, "CHECKED", 3)
    labelled_write(tmp_path, ["kept"])
    with pytest.raises(ValueError, match="lay in several tasks or apart from each other: d7$"):
        labelled_write(tmp_path, [f"d{k}" for k in range(10)], ["other", "d7"])
    assert {n for n, _, _ in labelled_read(tmp_path)} == {"kept"} and not list((tmp_path / files.STAGED).iterdir()) and len(list((tmp_path / files.LISTS).iterdir())) == 1


def test_logs_that_name_files_are_read(tmp_path):
    """Logs written before there were lists."""
    (tmp_path / files.LOG).mkdir()
    text = lambda name, amount: json.dumps({"statement_id": name, "issuer": "sbi", "glyph_fixture": "f", "transactions": [{"date": "2026-01-05", "description": "", "amount": amount}]})
    for k, names in enumerate((["a.json", "b.json"], ["b.json", "c.json"])):
        (tmp_path / files.LOG / f"{k:012d}-x.json").write_text(json.dumps({"files": names}))
    for name in "abc":
        (tmp_path / f"{name}.json").write_text(text(name, "-9.00"))
    assert labelled_read(tmp_path) == [(n, 0, "-9.00") for n in "abc"]
    labelled_write(tmp_path, ["a", "d"])
    assert labelled_read(tmp_path) == sorted([(n, 0, "-9.00") for n in "bc"] + [(n, k, "-1.00") for n in "ad" for k in range(2)])


GLYPH = '{"text":"a","page":0,"x":1,"y":2.5,"w":3,"h":4}'


def flat(batch):
    return sorted((r["doc_id"], g["glyph_ord"], g["text"], r["page"], *(repr(g[c]) for c in "xywh")) for r in batch.to_pylist() for g in r["glyphs"])


def test_glyphs_are_not_read_one_by_one(monkeypatch):
    """Of two thousand lines only what differs goes through json, and none glyph by glyph."""
    n, calls = 2000, []
    k = np.arange(n)
    g = Glyphs(np.zeros(n, np.int64), 20.0 + 5 * (k % 40), 92.0 + 18.0 * (k // 40), np.full(n, 4.0), np.full(n, -0.0), k, files.pa.array(["x\"\n", "é"] * (n // 2)))
    own = k // 1000
    texts = list(glyph_json.dumps(g, own * 3, own, 3))
    assert texts[2] == b"[]" and [json.loads(t)[7] for t in texts[:2]] == [{"text": "é", "page": p, "x": 55.0, "y": y, "w": 4.0, "h": -0.0} for p, y in ((0, 92.0), (3, 542.0))]
    read = glyph_json._PAIRS
    monkeypatch.setattr(glyph_json, "_PAIRS", lambda t: calls.append(t) or read(t))
    found = flat(glyph_json.pages(["a", "b", "c"], texts, None))
    assert len(calls) < 80 and found == sorted(("ab"[p], i % 1000, "é" if i % 2 else "x\"\n", 3 * int(p), *map(repr, (float(g.x[i]), float(g.y[i]), 4.0, -0.0))) for i, p in zip(k.tolist(), own))


@pytest.mark.parametrize("text", [
    "[]", " [ ] ", f"[{GLYPH}]", f"[{GLYPH}, {GLYPH}]", f"[{GLYPH},\n{GLYPH}]", f"[{GLYPH},\n{GLYPH.replace('"a"', '"x},"')}]", f"[{GLYPH.replace(':1,', ':1e2,')}]", f"[{GLYPH.replace(':0,', ':true,')}]", f"[{GLYPH.replace('}', ',"x":2}')}]",
    f"[{GLYPH.replace('}', ',"z":[1]}')}]", f"[{GLYPH.replace('"a"', '"a,\\"x\\":"')}]", f"[{GLYPH.replace(':1,', ':' + '9' * 30 + ',')}]", f"[{GLYPH.replace('"a"', '"\\ud83d\\ude00"')}]",
])
def test_dumps_of_any_form_are_read_alike(text):
    rows = lambda k: files.glyph_rows("d.json", text.encode())
    assert flat(glyph_json.pages(["d"], [text.encode()], rows)) == sorted((*r[:4], *map(repr, r[4:])) for r in rows(0))


@pytest.mark.parametrize("text", [f"[{GLYPH}null]", f"[null,\n{GLYPH}]", "[null]", f"[{GLYPH},\n]", f"[{GLYPH}\n{GLYPH}]", f"[{GLYPH.replace(':1,', ':NaN1,')}]", f"[{GLYPH.replace('4}', '4}}')}]", "[{", "", f"[{GLYPH.replace('"a"', 'null')}]"])
def test_what_is_no_dump_names_its_file(text):
    with pytest.raises(ValueError, match="d.json"):
        glyph_json.pages(["d"], [text.encode()], lambda k: files.glyph_rows("d.json", text.encode()))


def test_packed_dumps_are_shared_out_by_their_json(tmp_path, monkeypatch):
    monkeypatch.setattr(files, "TASK_BYTES", 1 << 18)
    text = f"[{','.join([GLYPH] * 2000)}]".encode()
    packed = glyph_json.packed(text)
    rows = [(f"d{d}", None, len(text), packed) for d in range(9)]
    batch = files.pa.RecordBatch.from_arrays([files.pa.array(c, f.type) for c, f in zip(zip(*rows), files._Texts.fields)], schema=files._Texts.fields)
    folder = files._Folder(str(tmp_path))
    writer = files._BatchWriter(files._Texts(), folder, files.PACKED, False)
    writer.commit([writer.write(iter([batch]))])
    tasks = folder.split(folder.pieces())
    assert [len(list(folder.read(t))) for t in tasks] == [3, 3, 3] and 9 * len(packed) < files.TASK_BYTES
    assert {data for t in tasks for _, data in folder.read(t)} == {packed}
