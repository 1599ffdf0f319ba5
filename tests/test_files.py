import pytest
from pyspark.sql import functions as F

from opinion_spark import schemas
from opinion_spark.operators.counts import sum_by_key
from opinion_spark.operators.similarity import jaccard_of_pairs
from opinion_spark.sources import files
from opinion_spark.sources.network import read_network
from opinion_spark.sources.posts import read_posts
from opinion_spark.sources.sets import read_item_pairs, read_item_sets, read_user_items
from opinion_spark.staging import shared_dir, stage
from util import rows


@pytest.mark.parametrize(
    "schema,data",
    [
        (schemas.RAW_POST, [(1, "{}"), (5_000_000_000, "é")]),
        (schemas.COUNTED_KEY, [("u", 3), ("v", 70000)]),
        (schemas.RAW_NETWORK, [("{}", "1,2,3")]),
        (schemas.USER_ITEMS_CSV, [(7, "a,b")]),
    ],
)
def test_sequence_files(spark, table, tmp_path, schema, data):
    path = str(tmp_path / "seq")
    files.write_sequence(table(data, schema), path)
    back = files.read_sequence(spark, path, schema)
    assert rows(back) == sorted(data, key=repr)
    assert back.schema == table(data, schema).schema


def _headers(path):
    """What each file says of its records."""
    return [f.read_bytes()[:120] for f in sorted(path.iterdir()) if f.name.startswith("part-")]


def test_sequence_files_keep_the_record_classes(spark, table, tmp_path):
    small = table([(1, "a"), (2, "b"), (9_000_000_000, "c")], schemas.RAW_POST)
    files.write_sequence(small.repartition(2), str(tmp_path / "long"))
    for head in _headers(tmp_path / "long"):
        assert b"org.apache.hadoop.io.LongWritable" in head and b"org.apache.hadoop.io.Text" in head
    files.write_sequence(table([("a", 1)], schemas.COUNTED_KEY), str(tmp_path / "int"))
    assert all(b"org.apache.hadoop.io.IntWritable" in head for head in _headers(tmp_path / "int"))
    # the batch jobs' own reader takes them for what they are
    read = spark.sparkContext.sequenceFile(str(tmp_path / "long"), files.WRITABLES["bigint"], files.WRITABLES["string"])
    assert sorted(read.collect()) == [(1, "a"), (2, "b"), (9_000_000_000, "c")]


def test_sequence_files_are_split_and_read_without_python(spark, table, tmp_path):
    path = str(tmp_path / "big")
    data = spark.range(200_000).select(F.col("id"), F.repeat(F.lit("text "), 40).alias("line")).coalesce(1)
    files.write_sequence(data, path)
    back = files.read_sequence(spark, path, "id bigint, line string")
    assert back.agg(F.count("*"), F.sum("id"), F.min(F.length("line"))).head() == (200_000, 19_999_900_000, 200)
    assert back.rdd.getNumPartitions() > 1
    assert "Python" not in back._jdf.queryExecution().executedPlan().toString().replace("applySchemaToPythonRDD", "")


def test_failed_sequence_write_leaves_no_part_file(spark, table, tmp_path):
    bad = table([(i, "x" if i < 90 else None) for i in range(100)], "id bigint, text string").repartition(4)
    with pytest.raises(Exception, match="(?i)null"):
        files.write_sequence(bad, str(tmp_path / "bad"))
    assert not [f for f in (tmp_path / "bad").glob("part-*")]
    assert not (tmp_path / "bad" / "_SUCCESS").exists()


def test_empty_sequence_file(spark, table, tmp_path):
    files.write_sequence(table([], schemas.RAW_POST), str(tmp_path / "none"))
    assert files.read_sequence(spark, str(tmp_path / "none"), schemas.RAW_POST).count() == 0


def test_sequence_files_of_long_records(spark, tmp_path):
    path = str(tmp_path / "long")
    big = [(6_000_000_000 + i, "{}") for i in range(3)]
    spark.sparkContext.parallelize(big, 2).saveAsSequenceFile(path)
    assert rows(read_posts(spark, path, "sequence")) == big


def test_parquet_and_several_paths(spark, table, tmp_path):
    for i in range(2):
        table([(i, "{}")], schemas.RAW_POST).write.parquet(str(tmp_path / "in" / f"d={i}"))
    assert rows(read_posts(spark, str(tmp_path / "in" / "d=*"))) == [(0, "{}"), (1, "{}")]
    both = [str(tmp_path / "in" / f"d={i}") for i in range(2)]
    assert rows(read_posts(spark, both)) == [(0, "{}"), (1, "{}")]
    with pytest.raises(ValueError):
        read_network(spark, "x", "avro")


def test_tsv(spark, table, tmp_path):
    path = str(tmp_path / "out")
    df = table([(3, "c"), (1, 'quo"te'), (2, None)], "id bigint, name string")
    files.write_tsv(df, path, order_by=["id"])
    lines = [r.value for r in spark.read.text(path).collect()]
    assert sorted(lines) == ['1\tquo"te', "2\t", "3\tc"]
    (tmp_path / "list.tsv").write_text("1\t5\nbad\t6\n2\n3\t4\t5\n4\t 7\n9\t8\n")
    assert rows(files.read_tsv(spark, str(tmp_path / "list.tsv"), schemas.SIDE_LIST)) == [
        (1, 5), (9, 8),
    ]


def test_sorted_parts_are_the_single_sorted_file(spark, table, tmp_path, conf):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("key"), F.concat(F.lit("é"), "id").alias("name"))
    many, one = tmp_path / "many", tmp_path / "one"
    conf("spark.sql.adaptive.enabled", "false")
    files.write_sorted(df, str(many), ["key"])
    files.write_tsv(df.coalesce(1).sortWithinPartitions("key"), str(one))
    parts = files.sorted_parts(spark, str(many))
    assert len(parts) > 1
    joined = b"".join(open(p, "rb").read() for p in parts)
    assert joined == next(one.glob("part-*")).read_bytes()
    assert spark.read.text(str(many)).count() == 5000  # the list of parts is no part


def test_a_sorted_output_begins_anew_only_if_it_was_not_finished(spark, table, tmp_path):
    path = tmp_path / "out"
    df = table([(2, "b"), (1, "a")], "key bigint, name string")
    path.mkdir()
    (path / "part-00000-left-over.txt").write_text("9\tz\n")
    files.write_sorted(df, str(path), ["key"])
    assert "".join(open(p).read() for p in files.sorted_parts(spark, str(path))) == "1\ta\n2\tb\n"
    files.write_sorted(df.where("key = 1"), str(path), ["key"])
    assert spark.read.text(str(path)).count() == 2
    files.write_sorted(df.where("false"), str(tmp_path / "none"), ["key"])
    assert files.sorted_parts(spark, str(tmp_path / "none")) == []


def test_seq_to_text_chain(spark, table, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    files.write_sequence(table([("a", 1), ("b", 2), ("a", 3)], schemas.COUNTED_KEY), source)
    pairs = files.read_sequence(spark, source, schemas.COUNTED_KEY)
    files.write_tsv(sum_by_key(pairs), target, order_by=["key"])
    assert [r.value for r in spark.read.text(target).collect()] == ["a\t4", "b\t2"]


def test_list_readers(spark, tmp_path):
    (tmp_path / "sets.tsv").write_text("u1\t3,1,3\nbad\nu2\t7,x\n")
    assert rows(read_item_sets(spark, str(tmp_path / "sets.tsv"))) == [
        ("u1", 1), ("u1", 3), ("u1", 3), ("u2", 7),
    ]
    (tmp_path / "users.tsv").write_text("5\ta,b\n")
    assert rows(read_user_items(spark, str(tmp_path / "users.tsv"), "tsv")) == [(5, "a"), (5, "b")]
    (tmp_path / "pairs.tsv").write_text("a,1,2,2\tb,2,3\nc,1\td,2\n")
    pairs = read_item_pairs(spark, str(tmp_path / "pairs.tsv"))
    assert rows(jaccard_of_pairs(pairs)) == [("a", "b", 1 / 3), ("c", "d", 0.0)]
    assert rows(jaccard_of_pairs(pairs, 0.1)) == [("a", "b", 1 / 3)]


def test_lists_are_written_as_csv(spark, table, tmp_path):
    sets = table([("a", [1, 2]), ("b", [])], "item string, users array<bigint>")
    files.write_tsv(sets, str(tmp_path / "sets"), order_by=["item"])
    lines = [r.value for r in spark.read.text(str(tmp_path / "sets")).collect()]
    assert lines == ["a\t1,2", "b\t"]


def test_terms(spark, tmp_path):
    path = tmp_path / "terms.txt"
    path.write_text("年金\n尖閣\n尖閣\n", encoding="utf-8")
    assert [r.term for r in files.read_terms(spark, str(path)).collect()] == ["年金", "尖閣", "尖閣"]


def test_separators_are_no_patterns(spark, tmp_path):
    (tmp_path / "bars.txt").write_text("a|1\nb|x\n", encoding="utf-8")
    read = files.read_tsv(spark, str(tmp_path / "bars.txt"), "name string, n bigint", sep="|")
    assert [tuple(r) for r in read.collect()] == [("a", 1)]


def test_stage_writes_to_the_shared_folder(spark):
    staged = stage(spark.range(5).withColumn("x", F.lit("a")), "t")
    assert staged.count() == 5
    assert staged.inputFiles()[0].startswith("file://" + shared_dir(spark))


def test_lines_of_a_sorted_output_are_numbered_through_its_parts(spark, tmp_path, conf):
    conf("spark.sql.adaptive.enabled", "false")
    conf("spark.sql.files.maxPartitionBytes", "4096")  # parts are read in several splits
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("key"), F.lit("é").alias("name"))
    files.write_sorted(df, str(tmp_path / "out"), ["key"])
    assert len(files.sorted_parts(spark, str(tmp_path / "out"))) > 1
    got = [tuple(r) for r in files.numbered_lines(spark, str(tmp_path / "out")).orderBy("line").collect()]
    keys = sorted(i * 7919 % 20_011 for i in range(20_000))
    assert got == [(i, f"{key}\té") for i, key in enumerate(keys, 1)]
    files.write_sorted(df.where("false"), str(tmp_path / "none"), ["key"])
    assert files.numbered_lines(spark, str(tmp_path / "none")).count() == 0
