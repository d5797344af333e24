"""Files in and out."""

from pyspark.sql import functions as F

from corpusloom.operators import tokens
from corpusloom.sources import files


def test_lines_of_a_split_file_are_numbered_in_order(spark, tmp_path):
    for name, count in (("a.txt", 5000), ("b.txt", 3)):
        (tmp_path / name).write_text("".join(f"{name} line {i}\n" for i in range(count)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = files.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 5003
    assert all(r.text.endswith(f" line {r.line_no}") and r.file.endswith(r.text.split()[0]) for r in rows)


def test_csv_round_trip_with_quotes_blanks_and_nulls(spark, tmp_path):
    data = [(1, ' lead, "quoted" ', 1.5), (2, None, None), (3, "back\\slash", -2.0), (4, "NA", 0.0), (5, "", 0.25)]
    df = spark.createDataFrame(data, "id BIGINT, t STRING, v DOUBLE")
    for write, read in ((files.write_csv, files.read_csv), (files.write_csv2, files.read_csv2)):
        path = str(tmp_path / write.__name__)
        write(df, path)
        got = {r.id: (r.t, r.v) for r in read(spark, path, "id BIGINT, t STRING, v DOUBLE").collect()}
        assert got == {1: (' lead, "quoted" ', 1.5), 2: (None, None), 3: ("back\\slash", -2.0), 4: (None, 0.0), 5: (None, 0.25)}


def test_csv2_reads_decimal_commas(spark, tmp_path):
    (tmp_path / "x.csv").write_text("name;share\nJane;0,25\nJohn;NA\n")
    got = [(r["name"], r.share) for r in files.read_csv2(spark, str(tmp_path / "x.csv"), "name STRING, share DOUBLE").collect()]
    assert got == [("Jane", 0.25), ("John", None)]


def test_row_operators_accept_a_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(0, "One two. Three")], "doc_id BIGINT, text STRING").write.parquet(source)
    stream = spark.readStream.schema("doc_id BIGINT, text STRING").parquet(source)
    query = tokens.explode_words(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(out)
    query.awaitTermination(60)
    assert sorted(r.word for r in spark.read.parquet(out).collect()) == ["one", "three", "two"]


def test_csv_fields_with_line_breaks(spark, tmp_path):
    data = {1: "a\nb", 2: "c", 3: 'say "x",\n\n', 4: "\n"}
    df = spark.createDataFrame(list(data.items()), "id BIGINT, t STRING")
    for write, read in ((files.write_csv, files.read_csv), (files.write_csv2, files.read_csv2)):
        path = str(tmp_path / write.__name__)
        write(df, path)
        assert {r.id: r.t for r in read(spark, path, "id BIGINT, t STRING").collect()} == data
