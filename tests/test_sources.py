"""Files: splits, compression, appending, repair, listing, shards; windows by a tokenizer; the shared folder."""

import json

import pytest
import zstandard
from pyspark.sql import functions as F

from contrasto.operators import mentions
from contrasto.sources import jsonl, lookups, tables


def test_splits_number_lines(spark, tmp_path):
    """Whatever the split, the same lines with the same numbers; blank lines count, long lines cross splits."""
    lines = [json.dumps({"k": k, "t": "é" * (k * 37 % 300)}, ensure_ascii=False) if k % 7 else "" for k in range(400)]
    a, b = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    a.write_text("\n".join(lines) + "\n")
    b.write_text(lines[1] + "\r\n\n" + lines[2])  # no line end at the end
    (tmp_path / "c.jsonl").write_text("")
    (tmp_path / "d.jsonl.zstd").write_bytes(zstandard.compress(a.read_bytes()))
    want = {("a", k + 1, x) for k, x in enumerate(lines) if x} | {("b", 1, lines[1]), ("b", 3, lines[2])} | {("d", k + 1, x) for k, x in enumerate(lines) if x}
    for size in (1 << 20, 9000, 2500):
        got = [(r["file"].rsplit("/", 1)[1][0], r["line"], r["value"]) for r in jsonl.read_lines(spark, [str(x) for x in sorted(tmp_path.glob("*.jsonl*"))], size).collect()]
        assert len(got) == len(want) and set(got) == want


def test_strict_lines_name_the_line(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"url": "u"}\n' * 50 + "\n[1]\n")
    with pytest.raises(Exception, match="x.jsonl:52: not a JSON object"):
        jsonl.read_jsonl(spark, [str(p)], "url string").collect()


def test_zstd_write_and_append(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(100).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("é "), F.col("id").cast("string"))).alias("t"))
    jsonl.write_jsonl(df.repartition(3), path, compressed=True)
    jsonl.write_jsonl(df.where("id < 5"), path, compressed=True, append=True)
    read = lambda: sorted((r["id"], r["t"]) for r in jsonl.read_jsonl(spark, jsonl.expand_inputs([path]), "id long, t string").collect())
    rows = [(r["id"], r["t"]) for r in df.collect()]
    assert read() == sorted(rows + rows[:5])
    jsonl.write_jsonl(df.where("id < 7"), path, compressed=True)  # overwrites
    said = b"".join(zstandard.ZstdDecompressor().stream_reader(p.read_bytes()).read() for p in (tmp_path / "out").glob("part-*")).decode()
    assert read() == rows[:7] and '{"id":0,"t":null}\n' in said


@pytest.mark.parametrize("name", ["x.jsonl", "x.jsonl.zstd"])
def test_append_and_repair(spark, tmp_path, name):
    p = tmp_path / name
    read = lambda: [r["k"] for r in jsonl.read_jsonl(spark, [str(p)], "k long").orderBy("line").collect()]
    jsonl.append_rows(str(p), [{"k": 1}, {"k": 2}])
    jsonl.append_rows(str(p), [{"k": 3}])
    assert read() == [1, 2, 3] and not jsonl.repair(str(p))
    whole = p.read_bytes()
    extra = b'{"k": 4}\n{"k": 5' if name.endswith("jsonl") else zstandard.compress(b'{"k": 4}\n{"k": 5}\n')[:-3]
    p.write_bytes(whole + extra)
    if name.endswith("zstd"):
        assert jsonl.truncated_zstd(p.read_bytes())
    jsonl.append_rows(str(p), [{"k": 6}])  # repairs first
    assert read() in ([1, 2, 3, 4, 6], [1, 2, 3, 6]) and not jsonl.repair(str(p))
    assert not jsonl.repair(str(tmp_path / "none.jsonl"))


def test_inputs_and_reports_on_file_systems(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for n in ("in/b.jsonl", "in/a.jsonl.zstd", "in/deep/c.jsonl", "in/skip.txt"):
        (tmp_path / n).write_text("")
    uri = f"file://{tmp_path}"
    assert jsonl.expand_inputs([f"{uri}/in"]) == [f"{uri}/in/{n}" for n in ("a.jsonl.zstd", "b.jsonl", "deep/c.jsonl")]
    assert jsonl.expand_inputs([f"{uri}/in/*.jsonl", f"{uri}/in/b.jsonl"]) == [f"{uri}/in/b.jsonl"]
    assert [x.rsplit("/", 1)[1] for x in jsonl.expand_inputs([str(tmp_path / "in")])] == ["a.jsonl.zstd", "b.jsonl", "c.jsonl"]
    for bad in (f"{uri}/none", f"{uri}/in/*.csv", str(tmp_path / "none")):
        with pytest.raises(FileNotFoundError):
            jsonl.expand_inputs([bad])
    for where in (f"{uri}/reports/r.json", str(tmp_path / "reports" / "s.json")):
        jsonl.write_manifest(where, {"n": 1})
        jsonl.write_manifest(where, {"n": 2})
        with jsonl.opened_input(where) as f:
            assert json.loads(f.read()) == {"n": 2}
    assert len(list((tmp_path / "reports").iterdir())) == 2


def test_shards_cover_tasks_once(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("key"))
    parts = [sorted(r["key"] for r in lookups.take_shard(df, "key", k, 3).collect()) for k in range(3)]
    assert sorted(sum(parts, [])) == sorted(str(k) for k in range(200)) and all(parts)
    with pytest.raises(ValueError):
        lookups.take_shard(df, "key", 3, 3)


def test_windows_by_a_tokenizer(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    text = "The river and the bridge. " * 40
    made = [(r["chunk_start"], r["chunk_text"]) for r in mentions.chunk_documents(spark.createDataFrame([("d", text), ("e", ""), ("f", None)], "document_id string, text string"), 50, 20, path).orderBy("chunk_start").collect()]
    assert len(made) > 3 and made[0][0] == 0 and all(text[a : a + len(t)] == t for a, t in made)
    assert all(len(mentions.tokenizer_spans(path)(t)) <= 50 for _, t in made) and all(b[0] < a[0] + len(a[1]) for a, b in zip(made, made[1:]))


def test_entities_of_overlapping_windows_count_once(spark):
    import re

    label = lambda: lambda texts: [[(m.start(), m.end(), "B-PER") for m in re.finditer(r"\b[A-Z]\w+", t)] for t in texts]
    text = " ".join(f"word{k} and {'Anna' if k % 5 else 'Berta'} went home." for k in range(120))
    rows = {r["document_id"]: r["entities"] for r in mentions.tag_entities(spark.createDataFrame([("d", text), ("e", "nobody"), ("f", None)], "document_id string, text string"), label, ["person"], 60, 30).collect()}
    assert [(e["norm"], e["count"]) for e in rows["d"]] == [("anna", 96), ("berta", 24)] and rows["d"][0]["first_start"] == text.index("Anna") and rows["e"] == rows["f"] == []


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Session:
        conf = Conf

        class sparkContext:
            master = "yarn"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_dir(Session)
    assert tables.shared_dir(spark)


def test_small_splits_make_few_tasks(spark, tmp_path):
    """Thousands of small splits are read by as many tasks as the bytes need."""
    p = tmp_path / "x.json"
    p.write_text("".join(f"line {i}\n" for i in range(30_000)))
    rows = jsonl.read_lines(spark, str(p), split_bytes=64)
    assert rows.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    got = rows.collect()
    assert len(got) == 30_000 and all(r["value"] == f"line {r['line'] - 1}" for r in got)
