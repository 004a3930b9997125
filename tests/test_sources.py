from __future__ import annotations

import datetime
import math
import re

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tallymark.operators import settle as settle_module
from tallymark.operators.settle import clear_settled, settle, shared_folder
from tallymark.sources import schemas
from tallymark.sources.files import number_losses, read_csv, read_parquet, read_tsv
from tallymark.sources.schemas import Input
from tallymark.sources.sinks import run_stamp, write_csv, write_parquet

HEADER = "State Student ID,Extra,Grade,District Number,School Number,Literacy Proficiency Level,Composite (Overall) Proficiency Level"


def test_csv_by_header(spark, tmp_path):
    (tmp_path / "r.csv").write_text(
        HEADER + '\n1,x,03,TN00470,0010,2.5,3.1\n2,,NA,"TN00010",,NA,\n3,NA,K,"","12",abc,NaN\n'
    )
    got = read_csv(spark, "r.csv", schemas.RESULTS, base=str(tmp_path))
    assert got.columns == ["id", "grade", "district", "school", "literacy", "score"]
    assert rows(got) == [
        (1, "03", "TN00470", "0010", 2.5, 3.1), (2, None, "TN00010", None, None, None), (3, "K", None, "12", None, None)
    ]
    assert dict(got.dtypes)["score"] == "double"


def test_csv_without_a_column(spark, tmp_path):
    (tmp_path / "r.csv").write_text("State Student ID,Grade\n1,2\n")
    with pytest.raises(ValueError, match="District Number"):
        read_csv(spark, str(tmp_path / "r.csv"), schemas.RESULTS)


def test_tsv(spark, tmp_path):
    (tmp_path / "l.txt").write_text("A\tSTUDENT_KEY\nx\t5\ny\t5\nz\tNA\n")
    assert rows(read_tsv(spark, tmp_path / "l.txt", schemas.LISTED)) == [(5,), (5,), (None,)]


def test_pruned_columns_are_not_parsed(spark, tmp_path):
    (tmp_path / "r.csv").write_text(HEADER + "\n1,x,03,TN1,1,2.5,3.1\n")
    text = read_csv(spark, str(tmp_path / "r.csv"), schemas.RESULTS).select("id")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ReadSchema: struct<State Student ID:string>", text)


def test_schemas_have_unique_short_names():
    for layout in vars(schemas).values():
        if isinstance(layout, Input):
            assert len(set(layout.renames.values())) == len(layout.columns)
    assert len(schemas.DISABILITY_COLUMNS) == 16


def report(spark):
    return spark.createDataFrame([(2, "b", None, 0), (1, "a", 50.0, 4), (1, None, 0.0, 3)], "system int, subgroup string, pct double, n int")


def lines(path):
    parts = sorted(path.glob("part-*"))
    assert len(parts) == 1
    return parts[0].read_text().splitlines()


def test_csv_sink(spark, tmp_path):
    write_csv(report(spark), str(tmp_path / "a"), one_file=True, order_by=["system", "subgroup"])
    assert lines(tmp_path / "a") == ["system,subgroup,pct,n", "1,a,50.0,4", "1,,0.0,3", "2,b,,0"]
    write_csv(report(spark), str(tmp_path / "b"), undefined={"pct": F.col("n") == 0}, one_file=True, order_by=["system", "subgroup"])
    assert lines(tmp_path / "b")[-1] == "2,b,NaN,0"
    with pytest.raises(TypeError):
        write_csv(report(spark), str(tmp_path / "c"), undefined={"n": F.lit(True)})


def test_one_file_is_in_order(spark, tmp_path):
    write_csv(report(spark).repartition(3), str(tmp_path / "a"), one_file=True, order_by=["pct", "n"])
    assert lines(tmp_path / "a")[1:] == ["1,,0.0,3", "1,a,50.0,4", "2,b,,0"]
    write_csv(report(spark).repartition(2), str(tmp_path / "b"))
    assert len(list((tmp_path / "b").glob("part-*"))) == 2


TEXTS = Input([("ID", schemas.LongType, "id"), ("A, name", schemas.StringType, "name"), ("Score", schemas.DoubleType, "score")])


def test_quotes_commas_and_line_breaks(spark, tmp_path):
    (tmp_path / "q.csv").write_text(
        'ID,"A, name",Score\n1,"He said ""hi"", ok",2.5\n2,"two\nlines",3.5\n12345.0," pad ",x\n3000000000,a\\b,NA\n'
    )
    got = read_csv(spark, str(tmp_path / "q.csv"), TEXTS)
    assert rows(got) == [
        (1, 'He said "hi", ok', 2.5), (2, "two\nlines", 3.5), (12345, " pad ", None), (3000000000, "a\\b", None)
    ]
    losses = number_losses(spark, str(tmp_path / "q.csv"), TEXTS)
    assert rows(losses) == [("ID", 4, 0), ("Score", 3, 1)]


def test_text_is_written_as_it_is(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, ' pad ', 1.5), (2, 'say "x", y', None), (3, "two\nlines", 0.0), (4, None, None)],
        "`ID` bigint, `A, name` string, `Score` double",
    )
    write_csv(df, str(tmp_path / "w"), one_file=True, order_by=["ID"])
    assert lines(tmp_path / "w")[1:3] == ['1," pad ",1.5', '2,"say ""x"", y",'] or lines(tmp_path / "w")[1] == "1, pad ,1.5"
    assert rows(read_csv(spark, str(tmp_path / "w"), TEXTS)) == rows(df)


def test_a_line_that_does_not_fit_fails(spark, tmp_path):
    (tmp_path / "q.csv").write_text('ID,"A, name",Score\n1,a,2.5,9\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        read_csv(spark, str(tmp_path / "q.csv"), TEXTS).collect()


def test_written_report_reads_back(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 2, "All Students", 3, 4, 1, 2, 66.7, None)],
        "system int, school int, subgroup string, valid_tests_growth bigint, valid_tests_exit bigint, n_met_exit bigint, "
        "n_met_growth bigint, pct_met_growth double, pct_met_exit double",
    )
    write_csv(df, str(tmp_path / "r"))
    assert rows(read_csv(spark, str(tmp_path / "r"), schemas.OUR_RESULTS)) == rows(df)
    write_parquet(df, str(tmp_path / "p"), ["system"])
    assert rows(read_parquet(spark, str(tmp_path / "p"), schemas.OUR_RESULTS)) == rows(df)


def test_run_stamp(spark):
    stamp = spark.range(1).select(run_stamp()).first()[0]
    assert abs((datetime.datetime.strptime(stamp, "%Y%m%d") - datetime.datetime.now()).days) <= 1


def test_settle_keeps_rows_and_types(spark):
    df = spark.createDataFrame([(1, None, math.inf), (2, "", -math.inf)], "a int, b string, c double")
    settled = settle(df)
    assert settled.dtypes == df.dtypes
    assert rows(settled) == rows(df)


class Unset:
    """A session without spark.checkpoint.dir."""

    def __init__(self, master):
        self.sparkContext = self
        self.conf = self
        self.master = master
        self.folder = None

    def get(self, key, default):
        return default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_settle_folder():
    for master in ("local[4]", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(Unset(master))
    named = Unset("yarn")
    named.setCheckpointDir("hdfs:/shared/")
    assert shared_folder(named) == "hdfs:/shared"


def test_settled_tables_can_be_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(settle_module, "shared_folder", lambda spark: str(tmp_path))
    monkeypatch.setattr(settle_module, "_written", [])
    settle(spark.range(3))
    settle(spark.range(4))
    assert len(list(tmp_path.iterdir())) == 2
    assert clear_settled(spark) == 2
    assert list(tmp_path.glob("tallymark-*")) == []
    assert clear_settled(spark) == 0


@pytest.mark.parametrize("read, sep", [(read_csv, ","), (read_tsv, "\t")])
def test_lost_numbers_are_counted_by_the_job_that_reads(spark, tmp_path, read, sep):
    from pyspark.sql import Observation
    from pyspark.sql.types import DoubleType, IntegerType, StringType

    lines = [["Key", "A.b", "Score", "Text"], ["1", "2.5", "7", "x"], ["k", "NA", "seven", "y"], ["", "--", "8", "NA"]]
    (tmp_path / "f").write_text("\n".join(sep.join(line) for line in lines) + "\n")
    layout = schemas.Input([
        ("Key", IntegerType, "key"), ("A.b", DoubleType, "ab"), ("Score", IntegerType, "score"), ("Text", StringType, "text"),
    ])
    losses = Observation()
    df = read(spark, tmp_path / "f", layout, multi_line=False, losses=losses)
    assert rows(df) == rows(read(spark, tmp_path / "f", layout))
    assert losses.get == {"rows": 3, "key": 1, "ab": 1, "score": 1}


def test_text_without_line_breaks_is_split(spark, tmp_path):
    from pyspark.sql.types import IntegerType

    (tmp_path / "f.csv").write_text("n\n" + "\n".join(map(str, range(20_000))) + "\n")
    layout = schemas.Input([("n", IntegerType, "n")])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        split = read_csv(spark, tmp_path / "f.csv", layout, multi_line=False)
        assert split.rdd.getNumPartitions() > 4
        assert split.agg({"n": "sum"}).first()[0] == sum(range(20_000))
        assert read_csv(spark, tmp_path / "f.csv", layout).rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_places_are_written(spark, tmp_path):
    from pyspark.sql.types import IntegerType, StringType

    df = spark.createDataFrame([(3, "c"), (1, "a"), (None, "d"), (2, "b")], "n int, t string")
    write_csv(df, str(tmp_path / "out"), order_by=["n"], place="at")
    layout = schemas.Input([("n", IntegerType, "n"), ("t", StringType, "t"), ("at", IntegerType, "at")])
    assert rows(read_csv(spark, str(tmp_path / "out"), layout), "at", "t") == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
