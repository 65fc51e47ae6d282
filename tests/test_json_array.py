"""Records of large JSON files at any number of splits."""

import json
import random

import pytest

from terravane.sources import json_array, places


def value(rng, depth):
    kind = rng.randrange(8 if depth else 5)
    texts = ["", "a", 'q"uo\\te', "{", "}{[", "\\", "è😀", '","features":[{', "x" * 50, "\n"]
    if kind < 5:
        return [rng.choice(texts), rng.randrange(100), None, True, rng.choice(texts)][kind]
    if kind < 7:
        return {rng.choice([*texts, "features", "places", "k"]): value(rng, depth - 1) for _ in range(rng.randrange(4))}
    return [value(rng, depth - 1) for _ in range(rng.randrange(4))]


def objects(seed):
    rng = random.Random(seed)
    return [{"id": i, "v": value(rng, 4), "w": value(rng, 3), "type": "x" * rng.randrange(80)} for i in range(120)]


FORMS = {
    "array": lambda rows: rows,
    "collection": lambda rows: {"type": "FeatureCollection", "meta": {"features": [{"no": 1}], "a": [{"b": {}}]}, "other": [{"no": 2}], "features": rows, "after": [{"no": 3}, {"features": [{}]}]},
    "places": lambda rows: {"places": rows},
    "odd": lambda rows: [1, "{", [{"no": 4}], *rows, [[{"no": 5}]], None],
}


@pytest.mark.parametrize("form", sorted(FORMS))
@pytest.mark.parametrize("split", [1 << 20, 211])
def test_records_at_any_number_of_splits(spark, tmp_path, form, split):
    want = {}
    for seed, indent in ((1, None), (2, 2)):
        rows = objects(seed)
        (tmp_path / f"{seed}.json").write_text(json.dumps(FORMS[form](rows), indent=indent, ensure_ascii=bool(indent)), encoding="utf-8")
        want[f"{seed}.json"] = rows
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, str(split) if n == names[0] else "0")
    try:
        found = json_array.records(spark, str(tmp_path))
        got = sorted((r["file"].rsplit("/", 1)[1], r["start"], r["seq"], r["text"]) for r in found.collect())
        for name, rows in want.items():
            assert [json.loads(t) for f, _, _, t in got if f == name] == rows
        if split < 3000:
            assert spark.read.option("lineSep", "{").text(str(tmp_path)).rdd.getNumPartitions() > 20
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def test_empty_arrays_and_broken_files(spark, tmp_path):
    for i, text in enumerate(("[]", '{"features": []}', "{}", "[ ]\n")):
        (tmp_path / f"{i}.json").write_text(text)
    assert json_array.records(spark, str(tmp_path)).collect() == []
    (tmp_path / "bad.json").write_text('[{"a": 1}, {"b": "')
    with pytest.raises(ValueError, match="ends within"):
        json_array.records(spark, str(tmp_path))


def test_extract_reads_each_form_and_fails_on_a_bad_record(spark, tmp_path):
    rows = [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.5, 2.0]}, "properties": {"id": f"p{i}", "names": {"primary": "Bar {"}}} for i in range(30)]
    for name, whole in (("a", rows), ("b", {"features": rows}), ("c", {"places": rows})):
        (tmp_path / f"{name}.json").write_text(json.dumps(whole))
        got = places.extract(spark, str(tmp_path / f"{name}.json")).select("properties.id", "properties.names.primary").collect()
        assert sorted(r["id"] for r in got) == sorted(r["properties"]["id"] for r in rows) and {r["primary"] for r in got} == {"Bar {"}
    (tmp_path / "d.json").write_text('[{"type": "Feature"}, {"no": "type"}]')
    with pytest.raises(Exception, match="malformed record"):
        places.extract(spark, str(tmp_path / "d.json")).collect()
