"""One JSON document of any length (S5, N1): cut into entries by many tasks, equal to parsing it whole."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from chainlens.schema import SCAM_FIELDS
from chainlens.sources.long_document import split_documents
from chainlens.sources.scam_list import read_long_scams, read_scams

ODD = ["", "}", "{", "}}{{", 'a "quoted\\" text', "\\", "\\\\}", "x\n}\ty", "é}日本", '{"k": "v"}', "[1]}", '"result":{', "\\\""]


def entry(rng, k):
    out = {
        "id": k,
        "name": rng.choice(ODD),
        "url": rng.choice(ODD),
        "coin": "ETH",
        "category": rng.choice(["Scam", "Phishing"]),
        "addresses": [f"0x{k}", rng.choice(ODD).replace(",", "")],
        "status": rng.choice(["Active", None]),
    }
    if k % 5 == 0:
        out["more"] = {"a": {"b": [{}, {"c": rng.choice(ODD)}]}, "d": []}
    return out


def document(rng, first, n, **members):
    entries = {rng.choice(ODD) + str(first + k): entry(rng, first + k) for k in range(n)}
    return {"success": True, "note": rng.choice(ODD), **members, "result": entries, "total": n}


def made(rng):
    meta = {"rate": 1, "text": "}{"}
    return [document(rng, 0, 60, meta=meta), document(rng, 100, 1), document(rng, 200, 0), document(rng, 300, 25, list=[1, "}"], none=None)]


def rows(df):
    return sorted((tuple(r) for r in df.select(*SCAM_FIELDS).collect()), key=repr)


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize(("seed", "indent", "ascii_only"), [(1, None, True), (2, None, False), (3, 2, False)])
def test_equal_to_parsing_whole(spark, tmp_path, small_splits, seed, indent, ascii_only):
    docs = made(random.Random(seed))
    lines = tmp_path / "lines.json"
    lines.write_text("\n".join(json.dumps(d) for d in docs))
    folder = tmp_path / "long"
    folder.mkdir()
    # several documents in a file, with and without text behind the last brace; an empty file, a blank one
    texts = [json.dumps(d, indent=indent, ensure_ascii=ascii_only) for d in docs]
    (folder / "a.json").write_text(texts[0] + "\n\n" + texts[1] + texts[2])
    (folder / "b.json").write_text(" \n" + texts[3] + " \n")
    (folder / "c.json").write_text("")
    (folder / "d.json").write_text(" \n\n ")
    got = rows(read_long_scams(spark, str(folder)))
    assert got == rows(read_scams(spark, str(lines))) and len(got) > 80
    cut = split_documents(spark, str(folder))
    assert cut.count() == 4 + 59 + 24
    assert cut.agg(F.max(F.length("value"))).first()[0] < 1500


def test_many_tasks_read_one_line(spark, tmp_path, small_splits):
    path = tmp_path / "one.json"
    path.write_text(json.dumps(document(random.Random(4), 0, 200)))
    assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 20
    assert rows(read_long_scams(spark, str(path))) == rows(read_scams(spark, str(path)))


def test_equal_keys_stay_apart_as_when_parsed_whole(spark, tmp_path):
    one = json.dumps(entry(random.Random(5), 7))
    (tmp_path / "a.json").write_text(f'{{"result":{{"k":{one},"k":{one} , "k" : {one}}}}}')
    got = rows(read_long_scams(spark, str(tmp_path)))
    assert got == rows(read_scams(spark, str(tmp_path))) and len(got) in (3, 6)


def test_objects_in_an_array_behind_the_entries(spark, tmp_path):
    rng = random.Random(6)
    doc = document(rng, 0, 8) | {"list": [{"a": "}"}, {"b": [1]}], "last": {"c": 1}}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    assert rows(read_long_scams(spark, str(tmp_path))) == rows(read_scams(spark, str(tmp_path)))


ENTRY = '{"id":1,"name":"n","url":"u","coin":"c","category":"Scam","addresses":["0xaa"],"status":null}'


@pytest.mark.parametrize(
    ("text", "message"),
    [
        (f'{{"result":{{"a":{ENTRY},"b":{ENTRY}}}', "(?i)malformed"),
        (f'{{"result":{{"a":{ENTRY},"b":{ENTRY}}}\n', "ends inside"),
        (f'{{"result":{{"a":{ENTRY},"b":{ENTRY[:-8]}', "ends inside"),
        (f'{{"result":{{"a":{ENTRY}}}}} rest', "ends inside"),
        (f'{{"result":{{"a":{ENTRY}}}}}}}', "closes more"),
        (f'{{"result":{{"a":{ENTRY} "b":{ENTRY}}}}}', "without a comma"),
        (f'{{"result":{{"a":{ENTRY},,"b":{ENTRY}}}}}', "(?i)malformed"),
        (f'{{"result":{{"a":{ENTRY},"b":{ENTRY},}}}}', "(?i)malformed"),
        (f'{{"result":{{"a":{ENTRY},"b":{ENTRY.replace("u", "|").replace("|", chr(92) + "}", 1)}}}}}', "(?i)malformed|ends inside|closes more"),
        (f'{{"other":{{"a":{ENTRY},"b":{ENTRY}}}}}', "outside of 'result'"),
        (f'{{"list":[{{"x":1}}],"result":{{"a":{ENTRY}}}}}', "outside of 'result'"),
        ('{"success": true}', "with 'result'"),
        ('{"result":{"a":{"id":1}}}', "scam entry without"),
        (f'{{"result":{{"a":{ENTRY},"b":{{"id":1}}}}}}', "scam entry without"),
        ("words", "ends inside"),
    ],
)
def test_a_broken_document_is_an_error(spark, tmp_path, text, message):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match=message):
        read_long_scams(spark, str(tmp_path)).collect()
