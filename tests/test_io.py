"""Sources and sinks."""

import pytest

from pairjudge.sources import io as IO


def test_require_columns_names_missing(spark):
    df = spark.createDataFrame([(1, "x")], "id int, question string")
    with pytest.raises(ValueError, match="original_answer"):
        IO.require_columns(df, ["id", "question", "original_answer"])


def test_derive_item_id_precedence(spark):
    df = spark.createDataFrame([(1, 2, "a")], "`Unnamed: 0` int, postID int, t string")
    assert IO.derive_item_id(df).first()["item_id"] == "2"
    df2 = spark.createDataFrame([("a", "b")], "x string, y string")
    assert len(IO.derive_item_id(df2).first()["item_id"]) == 64


def test_conform_contract(spark):
    df = spark.createDataFrame([("1", "3.5", "extra"), ("2", "n/a", None)], "item_id string, score string, junk string")
    out = IO.conform(df, [("item_id", "string", None), ("score", "double", None), ("judge", "string", "")])
    assert out.columns == ["item_id", "score", "judge"]
    rows = out.orderBy("item_id").collect()
    assert rows[0]["score"] == 3.5 and rows[1]["score"] is None and rows[1]["judge"] == ""


def test_salvage_and_encoding(spark):
    path = IO.scratch_path(spark, "t-salvage")
    lines = spark.createDataFrame([("a,n",), ("x,1",), ("y,zz",), ("z,3",)], "value string")
    lines.coalesce(1).write.text(path)
    from pyspark.sql import types as T
    good, bad = IO.read_salvage(spark, path, T.StructType([T.StructField("a", T.StringType()),
                                                           T.StructField("n", T.IntegerType())]))
    assert sorted(r["a"] for r in good.collect()) == ["x", "z"] and bad.count() == 1

    p2 = IO.scratch_path(spark, "t-enc")
    df = spark.createDataFrame([(1, "fr", "café à la crème")], "doc_id long, lang string, text string")
    IO.write_csv(df, f"{p2}/l1", encoding="ISO-8859-1")
    IO.write_csv(df.selectExpr("2 AS doc_id", "lang", "text"), f"{p2}/u8")
    back = {r["doc_id"]: r["text"] for r in IO.read_encoding_fallback(spark, f"{p2}/*", "doc_id long, lang string, text string").collect()}
    assert back == {1: "café à la crème", 2: "café à la crème"}


def test_salvage_keeps_quoted_and_multi_line_records(spark):
    from pyspark.sql import types as T
    path = IO.scratch_path(spark, "t-salvage-quoted")
    text = 'a,b,n\nx,"line one\nline two, with comma",1\ny,"say ""hi""",2\nz,w,many\n'
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", "\n").text(path)
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("n", T.IntegerType())])
    good, bad = IO.read_salvage(spark, path, schema)
    assert sorted(tuple(r) for r in good.collect()) == [("x", "line one\nline two, with comma", 1), ("y", 'say "hi"', 2)]
    assert bad.count() == 1


def test_bom_is_written_and_read_back(spark):
    path = IO.scratch_path(spark, "t-bom")
    IO.write_csv(spark.createDataFrame([("é", 1)], "a string, n int"), path, bom=True)
    raw = spark.read.format("binaryFile").load(path).where("length > 0").first()["content"]
    assert bytes(raw).startswith(b"\xef\xbb\xbfa,n")
    assert [tuple(r) for r in IO.read_table(spark, path, "a string, n int").collect()] == [("é", 1)]


def test_content_ids_tell_null_from_absent(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None), ("a", "", "b")], "x string, y string, z string")
    assert IO.derive_item_id(df).select("item_id").distinct().count() == 3


def test_dynamic_overwrite_needs_no_session_option(spark):
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode", None)
    path = IO.scratch_path(spark, "t-dynamic")
    IO.write_results(spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int"), path, ["k"])
    IO.write_results(spark.createDataFrame([("b", 3)], "k string, n int"), path, ["k"])
    assert sorted((r["k"], r["n"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3)]
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode", None) == before


def test_streams_of_like_named_stores_have_their_own_checkpoints(spark, monkeypatch):
    from pairjudge.streaming import upsert as U
    places = []

    class Writer:
        def __getattr__(self, name):
            def call(*args, **kwargs):
                if name == "option":
                    places.append(args[1])
                return self
            return call

    class Stream:
        sparkSession, writeStream = spark, Writer()

    for store in ("/x/one/store", "/x/two/store"):
        U.start_upsert(Stream(), store, ["k"], ["t"])
    assert len(set(places)) == 2


def test_utf8_file_with_replacement_character_stays(spark):
    path = IO.scratch_path(spark, "t-enc-fffd")
    schema = "doc_id long, text string"
    df = spark.createDataFrame([(1, "caffè �"), (2, "line one\nè two")], schema)
    IO.write_csv(df, f"{path}/u8")
    IO.write_csv(spark.createDataFrame([(3, "é à"), (4, "plain")], schema), f"{path}/l1", encoding="ISO-8859-1")
    back = {r["doc_id"]: r["text"] for r in IO.read_encoding_fallback(spark, f"{path}/*", schema).collect()}
    assert back == {1: "caffè �", 2: "line one\nè two", 3: "é à", 4: "plain"}


def _store(spark, name):
    path = IO.scratch_path(spark, name)
    df = spark.createDataFrame([(i, j, v) for i in range(6) for j, v in (("j 1", "a/b"), ("j2", None), ("j2", "x"))], "i int, judge string, variant string")
    IO.write_results(df, path, ["judge", "variant"])
    return path, lambda: sorted((tuple(r) for r in spark.read.parquet(path).select("i", "judge", "variant").collect()), key=str)


def test_run_is_replaced_also_by_nothing(spark):
    path, rows = _store(spark, "t-replace")
    new = spark.createDataFrame([(9, "j 1", "a/b")], "i int, judge string, variant string")
    IO.replace_run(new, path, {"judge": "j 1", "variant": "a/b"})
    assert [r for r in rows() if r[1] == "j 1"] == [(9, "j 1", "a/b")] and len(rows()) == 13
    IO.replace_run(new.limit(0), path, {"judge": "j 1", "variant": "a/b"})
    IO.replace_run(new.limit(0), path, {"judge": "j2", "variant": None})
    assert {r[1:] for r in rows()} == {("j2", "x")} and len(rows()) == 6
    IO.replace_run(new, path, {"judge": "j 1", "variant": "a/b"})  # a run that was not there
    assert len(rows()) == 7


def test_failed_replacement_leaves_the_old_run(spark):
    path, rows = _store(spark, "t-replace-failed")
    before = rows()
    wrong = spark.createDataFrame([(9, "j 1", "a/b"), (10, "other", "a/b")], "i int, judge string, variant string")
    with pytest.raises(Exception, match="does not belong"):
        IO.replace_run(wrong, path, {"judge": "j 1", "variant": "a/b"})
    assert rows() == before
    from pairjudge.sources import files
    assert not [n for n in files.names(spark, path) if n.startswith(("_new", "_old"))]


def test_row_index_follows_files_and_splits(spark):
    path = IO.scratch_path(spark, "t-row-index")
    spark.range(5000).repartitionByRange(7, "id").sortWithinPartitions("id").selectExpr("id", "repeat('x', 20) AS t").write.parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = IO.with_row_index(spark.read.parquet(path)).collect()
        assert sorted(r["row_index"] for r in got) == list(range(5000)) and all(r["id"] == r["row_index"] for r in got)
        text = IO.scratch_path(spark, "t-row-index-csv")
        IO.write_csv(spark.range(3000).repartitionByRange(3, "id").sortWithinPartitions("id").selectExpr("id", "id % 7 AS t"), text)
        got = IO.derive_item_id(IO.read_table(spark, text, "v long, t long", multi_line=False), by_row_index=True).collect()
        assert len(got) == 3000 and all(r["item_id"] == str(r["v"]) for r in got)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
