"""Sources, sinks, streaming, models and the command line, on temporary files."""

import json

import pytest
from pyspark.sql import functions as F

from tessera import cli, models
from tessera.sources import files
from tessera.streaming import stateless


def write_lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows) + "\n", encoding="utf-8")
    return str(path)


def test_jsonl(spark, tmp_path):
    path = write_lines(tmp_path / "a.txt", [{"id": "1", "x": "é/"}, "", "  ", {"id": "2", "x": None}])
    assert files.read_jsonl(spark, path, "id string, x string").count() == 2
    with pytest.raises(Exception, match="blank line"):
        files.read_jsonl(spark, path, "id string, x string", strict=True).collect()
    bad = write_lines(tmp_path / "b.txt", [{"id": "1"}, "{broken"])
    with pytest.raises(Exception):
        files.read_jsonl(spark, bad, "id string").collect()
    assert files.read_jsonl(spark, bad, "id string", tolerant=True).count() == 1
    assert files.read_optional_jsonl(spark, str(tmp_path / "none"), "id string").count() == 0
    df = files.read_jsonl(spark, path, "id string, x string")
    files.write_jsonl(df, str(tmp_path / "out"))
    files.write_jsonl(df, str(tmp_path / "out"), append=True)
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part*"))
    assert '"x":null' in text and "é" in text and files.read_jsonl(spark, str(tmp_path / "out"), "id string, x string").count() == 4


def read_arrays(folder):
    """All objects of a folder of files that hold one JSON array each."""
    return [x for p in sorted(folder.glob("part*")) if p.stat().st_size for x in json.loads(p.read_text(encoding="utf-8"))]


@pytest.mark.parametrize("indent", [0, 4])
def test_json_array(spark, tmp_path, indent):
    df = spark.createDataFrame([("1", "é"), ("2", None), ("3", 'a "b"')], "id string, x string").repartition(2)
    files.write_json_arrays(df, str(tmp_path / "deep" / "a"), indent)
    assert sorted(read_arrays(tmp_path / "deep" / "a"), key=lambda r: r["id"]) == [{"id": "1", "x": "é"}, {"id": "2", "x": None}, {"id": "3", "x": 'a "b"'}]
    assert files.read_json_array(spark, str(tmp_path / "deep" / "a")).count() == 3
    files.write_json_arrays(df.where("false"), str(tmp_path / "none"), indent)
    assert read_arrays(tmp_path / "none") == []


def test_file_order(spark, tmp_path):
    """The order of the files by name, whatever their sizes make Spark read first."""
    (tmp_path / "in").mkdir()
    for i, n in enumerate((3, 400, 20)):
        write_lines(tmp_path / "in" / f"{i}.txt", [{"id": f"{i}-{j:04}", "pad": "x" * 50} for j in range(n)])
    want = sorted(f"{i}-{j:04}" for i, n in enumerate((3, 400, 20)) for j in range(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = files.read_jsonl(spark, str(tmp_path / "in"), "id string", order="at")
        assert [r["id"] for r in rows.orderBy("at").collect()] == want
        assert [r["id"] for r in cli.with_position(rows.withColumnRenamed("at", "_line")).orderBy("position").collect()] == want
        assert "3" not in [r["id"] for r in rows.orderBy("at").limit(3).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_missing_is_not_null(spark):
    raw = spark.createDataFrame([('{"language":null,"lang":"ko"}',), ('{"lang":"ko"}',), ('{"language":"en"}',), ("{}",)], "v string")
    got = [r["x"] for r in raw.select(files.present_or(F.col("v"), "language", "lang", "unk").alias("x")).collect()]
    assert got == ["unk", "ko", "en", "unk"]


def test_stream(spark, tmp_path):
    write_lines(tmp_path / "in.json", [{"language": "en", "origin_query": "Q", "category_path": "a,b", "item_title": "q z"}])
    rows = stateless.read_stream(spark, str(tmp_path / "*.json"), "language string, origin_query string, category_path string, item_title string")
    out = stateless.similarity(stateless.tag_categories(rows))
    stateless.append_jsonl(out, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    row = spark.read.json(str(tmp_path / "out")).first()
    assert row["origin_query"] == "[LANG=en] Q" and row["category_path"] == "[D1] a [/D1] [D2] b [/D2]" and row["jac"] > 0


def test_models(spark):
    df = spark.createDataFrame([("1", "p", None, "1"), ("2", "", None, "0")], "id string, prompt_for_train string, prompt_for_desc string, label string")
    rows = models.caption(df, models.Stub).collect()
    assert [r["id"] for r in rows] == ["1"] and rows[0]["generation"]["is_valid"] and rows[0]["gold_label"] == "1"
    scored = models.score(df, models.Stub, "prompt_for_train").collect()
    assert all(r["logprob_yes"] < 0 for r in scored)
    train = models.training_rows(df.withColumn("full", F.lit("a bb ccc")).withColumn("head", F.lit("a bb")), models.Stub, "head", "full").first()
    assert train["input_ids"] == [1, 2, 3, 0] and train["labels"] == [-100, -100, 3, 0] and train["attention_mask"] == [1] * 4
    assert models.training_config("Mistral-7B").prompt_template == "mistral"
    with pytest.raises(ValueError):
        models.training_config("x")


def test_command_line(spark, tmp_path):
    qi = write_lines(tmp_path / "qi.txt", [{"id": i, "language": "en", "origin_query": f"red lamp {i}", "item_title": f"Red Lamp {i} by Acme", "label": i % 2} for i in range(20)])
    qc = write_lines(tmp_path / "qc.txt", [{"id": 1, "task": "QC", "language": "en", "origin_query": "Red  lamp 3", "category_path": "home, Big Lamps", "label": 1}])
    run = lambda *a: cli.main([str(x) for x in a])
    run("clean", "--input", qi, "--output", tmp_path / "clean", "--task", "QI")
    clean = spark.read.json(str(tmp_path / "clean"))
    assert set(clean.columns) == {"id", "language", "origin_query", "item_title", "label"} and clean.count() == 10
    run("tag-qc", "--input", qc, "--output", tmp_path / "qct")
    assert spark.read.json(str(tmp_path / "qct")).first()["category_path"] == "[D1] home [/D1] [D2] Big Lamps [/D2]"
    run("tag-qi", "--input", qi, "--qc_path", qc, "--output", tmp_path / "qit")
    tagged = {r["id"]: r for r in spark.read.json(str(tmp_path / "qit")).collect()}
    assert tagged["3"]["attributes_extracted"]["category"] == "big_lamps" and "qc_leaf: big_lamps" in tagged["3"]["attributes_str"]
    assert tagged["4"]["attributes_extracted"]["brand"] == "acme" and tagged["4"]["origin_query_tagged"] == "[LANG=en] red lamp 4"
    run("caption", "--input", tmp_path / "qit", "--output", tmp_path / "cap", "--limit", 5)
    assert spark.read.json(str(tmp_path / "cap")).count() == 5
    run("convert", "--task", "QI", "--input_path", tmp_path / "cap", "--output_path", tmp_path / "final.txt")
    final = read_arrays(tmp_path / "final.txt")
    assert len(final) == 5 and final[0]["gen_label"] in ("0", "1")
    run("predict", "--input", tmp_path / "final.txt", "--output", tmp_path / "pred")
    run("predict", "--input", tmp_path / "final.txt", "--output", tmp_path / "pred")
    assert spark.read.json(str(tmp_path / "pred")).count() == 5  # the second run finds all done
    for f in (tmp_path / "pred").glob(".*"):
        f.unlink()  # checksums of the files that are torn next
    torn = next(p for p in (tmp_path / "pred").glob("part*") if p.stat().st_size)
    torn.write_text(torn.read_text().rstrip()[:-20])
    run("predict", "--input", tmp_path / "final.txt", "--output", tmp_path / "pred", "--temperature", 0.5, "--batch_size", 3)
    again = files.read_jsonl(spark, str(tmp_path / "pred"), files.SCHEMAS["predictions"], tolerant=True).where("prediction is not null")
    assert again.count() == 5 and again.select("id").distinct().count() == 5
    run("predict", "--input", tmp_path / "final.txt", "--output", tmp_path / "bare", "--no-save_scores")
    assert set(spark.read.json(str(tmp_path / "bare")).columns) == {"id", "prediction"}
    run("icl", "--run", "convert_qc_format_with_icl", "--input", qc, "--output", tmp_path / "icl.txt")
    assert read_arrays(tmp_path / "icl.txt")[0]["output"] == "yes"
    run("split", "--input", tmp_path / "final.txt", "--output", tmp_path / "split")
    assert spark.read.json(str(tmp_path / "split")).where("split = 'test'").count() == 1
    run("train", "--input", tmp_path / "final.txt", "--output", tmp_path / "model")
    first = json.loads((tmp_path / "model" / "training_summary.json").read_text())
    assert first["params"]["cutoff_len"] == 1024 and first["num_tokens_k"] > 0 and first["model_size_MB"] > 0 and first["eval_loss"] > 0
    assert len(first["sample"]["input_ids"]) == len(first["sample"]["labels"]) <= 1024
    run("train", "--input", tmp_path / "final.txt", "--output", tmp_path / "more", "--resume_from_checkpoint", tmp_path / "model")
    second = json.loads((tmp_path / "more" / "training_summary.json").read_text())
    assert second["loss_tokens"] == 2 * first["loss_tokens"]


def test_micro_batches(spark):
    sizes = spark.sparkContext.accumulator(0)

    class Counting(models.Stub):
        def generate(self, prompts, **sampling):
            sizes.add(1)
            assert len(prompts) <= 3 and sampling["temperature"] == 0.7 and sampling["top_p"] == 0.9
            return [p.upper() for p in prompts]

    df = spark.createDataFrame([(str(i), f"p{i}") for i in range(10)], "id string, prompt string").coalesce(1)
    out = models.generate(df, Counting, "prompt", 3, temperature=0.7).collect()
    assert [(r["id"], r["text"]) for r in out] == [(str(i), f"P{i}") for i in range(10)] and sizes.value == 4
