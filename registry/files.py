"""Tables written as text and read back by their headers."""

from __future__ import annotations

from pyspark.sql import Observation, functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType

from tallymark.functions.missing import clean_code, nan_to_null_frame
from tallymark.operators.settle import new_path, settle
from tallymark.sources.files import number_losses, read_csv, read_parquet, read_tsv
from tallymark.sources.schemas import LISTED, Input
from tallymark.sources.sinks import run_stamp, write_csv

from .views import table

CUSTOMERS = Input([
    ("Customer ID", LongType, "id"),
    ("Market / Segment", StringType, "segment"),
    ("District Number", StringType, "district"),
    ("Balance (Overall)", DoubleType, "balance"),
    ("Grade", IntegerType, "grade"),
])
_WRITTEN = {
    "Extra": "c_name",
    "Customer ID": "c_custkey",
    "Market / Segment": "case when c_custkey % 11 = 0 then null else c_mktsegment end",
    "Balance (Overall)": "case when c_custkey % 13 = 0 then null else c_acctbal end",
    "District Number": "concat('TN', c_nationkey)",
    "Grade": "case when c_custkey % 10 = 0 then 'K' when c_custkey % 9 = 0 then 'NA' else concat('', c_custkey % 9) end",
}


def csv_round_trip(spark, sf_dir):
    """A CSV file with odd headers, an unknown column and three kinds of missing text."""
    path = new_path(spark)
    write_csv(table(spark, sf_dir, "customer").select(*[F.expr(e).alias(c) for c, e in _WRITTEN.items()]), path)
    back = read_csv(spark, path, CUSTOMERS)
    return back.withColumn("system", clean_code(F.col("district"), "TN")).drop("district")


def tsv_round_trip(spark, sf_dir):
    path = new_path(spark)
    keys = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("STUDENT_KEY"), "o_orderpriority")
    write_csv(keys, path, sep="\t")
    return read_tsv(spark, path, LISTED).groupBy("STUDENT_KEY").agg(F.count("*").alias("n"))


PARTS = Input([("Part", LongType, "id"), ("Name, long", StringType, "name"), ("Brand", StringType, "brand")])
_ODD = {
    "Part": "p_partkey",
    "Name, long": "case p_partkey % 5 when 0 then concat('\"', p_name, '\", he said') when 1 then concat(p_name, chr(10), p_brand) "
                  "when 2 then concat(' ', p_name, '  ') when 3 then concat(p_name, chr(92), ',', p_brand) else p_name end",
    "Brand": "p_brand",
}


def odd_text_round_trip(spark, sf_dir):
    """Quotes, commas, line breaks, backslashes and blanks at the ends."""
    path = new_path(spark)
    write_csv(table(spark, sf_dir, "part").select(*[F.expr(e).alias(c) for c, e in _ODD.items()]), path)
    return read_csv(spark, path, PARTS)


def lost_numbers(spark, sf_dir):
    """Values of number columns that are no numbers, counted while reading."""
    path = new_path(spark)
    write_csv(table(spark, sf_dir, "customer").select(*[F.expr(e).alias(c) for c, e in _WRITTEN.items()]), path)
    return number_losses(spark, path, CUSTOMERS)


def losses_while_reading(spark, sf_dir):
    """The same losses, counted by the job that reads the rows: no second scan."""
    path = new_path(spark)
    write_csv(table(spark, sf_dir, "customer").select(*[F.expr(e).alias(c) for c, e in _WRITTEN.items()]), path)
    losses = Observation()
    settle(read_csv(spark, path, CUSTOMERS, multi_line=False, losses=losses))
    found = losses.get
    rows = [(header, found[short]) for header, _, short in CUSTOMERS.columns if short in found]
    return spark.createDataFrame(rows, "`column` string, n_lost long").withColumn("n_rows", F.lit(found["rows"]).cast("long"))


def base_folder(spark, sf_dir):
    """A Parquet table read by its name under a folder."""
    nations = Input([("n_nationkey", LongType, "system"), ("n_name", StringType, "system_name")])
    return read_parquet(spark, "nation.parquet", nations, base=sf_dir)


def nan_as_missing(spark, sf_dir):
    """Quantities, every seventh line's NaN: NaN counts as missing."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", F.expr("case when l_linenumber = 7 then double('NaN') else l_quantity end").alias("quantity"),
    )
    return nan_to_null_frame(lines).groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.count("quantity").alias("n_known"), F.max("quantity").alias("most")
    )


def stamped_orders(spark, sf_dir):
    """Orders per status with the length of the run's date stamp."""
    counts = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return counts.withColumn("digits", F.length(run_stamp()))


QUERIES = {
    "csv_round_trip": csv_round_trip,
    "tsv_round_trip": tsv_round_trip,
    "odd_text_round_trip": odd_text_round_trip,
    "lost_numbers": lost_numbers,
    "losses_while_reading": losses_while_reading,
    "base_folder": base_folder,
    "nan_as_missing": nan_as_missing,
    "stamped_orders": stamped_orders,
}

ORACLES = {
    "csv_round_trip": """select c_custkey as id,
            case when c_custkey % 11 = 0 then null else c_mktsegment end as segment,
            case when c_custkey % 13 = 0 then null else c_acctbal end as balance,
            cast(case when c_custkey % 10 = 0 or c_custkey % 9 = 0 then null else c_custkey % 9 end as integer) as grade,
            c_nationkey as system
        from customer""",
    "tsv_round_trip": "select o_custkey as STUDENT_KEY, count(*) as n from orders group by o_custkey",
    "odd_text_round_trip": f"""select p_partkey as id, {_ODD['Name, long']} as name, p_brand as brand from part""",
    "lost_numbers": """select 'Customer ID' as "column", count(*) as n_values, cast(0 as bigint) as n_lost from customer
        union all select 'Balance (Overall)', count(case when c_custkey % 13 <> 0 then 1 end), 0 from customer
        union all select 'Grade', count(case when c_custkey % 10 = 0 or c_custkey % 9 <> 0 then 1 end),
            count(case when c_custkey % 10 = 0 then 1 end) from customer""",
    "losses_while_reading": """select 'Customer ID' as "column", cast(0 as bigint) as n_lost, count(*) as n_rows from customer
        union all select 'Balance (Overall)', 0, count(*) from customer
        union all select 'Grade', count(case when c_custkey % 10 = 0 then 1 end), count(*) from customer""",
    "base_folder": "select n_nationkey as system, n_name as system_name from nation",
    "nan_as_missing": """select l_returnflag, count(*) as n, count(case when l_linenumber <> 7 then l_quantity end) as n_known,
            max(case when l_linenumber <> 7 then l_quantity end) as most from lineitem group by l_returnflag""",
    "stamped_orders": """select o_orderstatus, count(*) as n, cast(8 as integer) as digits
        from orders group by o_orderstatus""",
}
