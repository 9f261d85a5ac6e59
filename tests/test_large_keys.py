"""Queries on keys as large as those of larger tables, against their SQL."""

import duckdb
import pytest
from compare import spark_rows, sql_rows
from pyspark.sql import functions as F

from sparkveil import plans
from sparkveil.operators import lists, networks


def _given(spark, tmp_path, name: str, rows: str):
    """A connection with one table of SQL rows, which lies under ``tmp_path`` too."""
    con = duckdb.connect()
    con.execute(f"copy ({rows}) to '{tmp_path}/{name}.parquet' (format parquet)")
    con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", ["a4_k8_satellites", "b4_satellite_export"])
def test_catalogue_numbers_of_more_letters(spark, tmp_path, name):
    con = _given(spark, tmp_path, "events", "select i::bigint as event_id, i * 997 as user_id from range(241) t(i)")
    assert spark_rows(plans.QUERIES[name](spark, str(tmp_path))) == sql_rows(con, plans.ORACLES[name])


def test_bylines_of_repeated_words(spark, tmp_path):
    con = _given(spark, tmp_path, "documents", "select i as doc_id, ['By By By By. re', 'by Ann Lee Moe and By Bo Ek', 'no', null][i + 1] as text from range(4) t(i)")
    assert spark_rows(plans.QUERIES["d5_person_names"](spark, str(tmp_path))) == sql_rows(con, plans.ORACLES["d5_person_names"])


def test_analytics_ids_of_long_accounts(spark, tmp_path):
    con = _given(spark, tmp_path, "pages", "select 99990 + i as page_id, 'http://a.example/' as url, '<p>' as html from range(20) t(i)")
    assert spark_rows(plans.QUERIES["d6_analytics_ids"](spark, str(tmp_path))) == sql_rows(con, plans.ORACLES["d6_analytics_ids"])


def test_account_probes_of_every_user(spark, tmp_path):
    con = _given(spark, tmp_path, "customer", "select i as c_custkey, (i % 2)::int as c_nationkey, 'C' || i as c_name from range(150) t(i)")
    con.execute(f"copy (select i as s_suppkey, (i % 2)::int as s_nationkey from range(10) t(i)) to '{tmp_path}/supplier.parquet' (format parquet)")
    con.execute(f"create view supplier as select * from '{tmp_path}/supplier.parquet'")
    rows = spark_rows(plans.QUERIES["c17_account_exists"](spark, str(tmp_path)))
    assert rows == sql_rows(con, plans.ORACLES["c17_account_exists"]) and len(rows[1]) == 150 * 5


def test_account_probes_are_many_tasks(spark, tmp_path):
    con = _given(spark, tmp_path, "customer", "select i as c_custkey, 7::int as c_nationkey, 'C' || i as c_name from range(2000) t(i)")
    con.execute(f"copy (select i as s_suppkey, 7::int as s_nationkey from range(1300) t(i)) to '{tmp_path}/supplier.parquet' (format parquet)")
    con.execute(f"create view supplier as select * from '{tmp_path}/supplier.parquet'")
    probes = plans.QUERIES["c17_account_exists"](spark, str(tmp_path))
    counts = [r["count"] for r in probes.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(counts) == 2000 * 1300 and max(counts) < 0.5 * sum(counts)
    told = "select count(*), count(*) filter (account), sum(user * site) filter (account)"
    said = probes.selectExpr("count(*)", "count(*) filter (where account)", "sum(user * site) filter (where account)").first()
    assert tuple(said) == con.execute(f"{told} from ({plans.ORACLES['c17_account_exists']})").fetchone()


def test_accounts_by_answers_and_by_judged_texts(spark):
    messages = "array('', 'user not found')"
    answers = spark.sql(f"""select * from values (1, 'message', 200, 'x/u/1', 'x/none/', 'C1', {messages}), (2, 'message', 200, 'x/u/2', 'x/none/', 'Sorry: user not found', {messages}),
        (3, 'message', 404, 'x/u/3', 'x/none/', 'C3', {messages}), (4, 'response_url', 200, 'x/none//', 'x/none/', 'C4', {messages}), (5, 'response_url', 200, 'x/none/5', 'x/none/', 'C5', {messages}), (6, 'response_url', 200, 'x', '', 'C6', {messages}),
        (7, 'response_url', 200, null, 'x/none', 'C7', {messages}), (8, 'status_code', 200, null, null, null, null), (9, 'message', 200, null, null, 'C9', null) as t(no, style, status, final_url, error_url, body, messages)""")
    judged = answers.select("no", "style", "status", lists.says_missing(F.col("body"), F.col("messages")).alias("missing"), lists.sent_on(F.col("final_url"), F.col("error_url")).alias("sent_on"))
    for rows in (answers, judged):
        assert [r["no"] for r in lists.account_exists(rows).where("account").orderBy("no").collect()] == [1, 5, 6, 7, 8, 9]


def test_first_members_by_number_of_both_families(spark, tmp_path):
    con = _given(spark, tmp_path, "supplier", "select i as s_suppkey, 'S' || i % 4 as s_name, 1::int as s_nationkey from range(200) t(i)")
    con.execute(f"copy (select i as c_custkey from range(400) t(i)) to '{tmp_path}/customer.parquet' (format parquet)")
    con.execute(f"create view customer as select * from '{tmp_path}/customer.parquet'")
    assert spark_rows(plans.QUERIES["e3_members_both_families"](spark, str(tmp_path))) == sql_rows(con, plans.ORACLES["e3_members_both_families"])


def test_addresses_of_one_file_are_many_tasks(spark):
    addresses = networks.located(spark.range(1000).coalesce(1).selectExpr("id as target", "concat('10.0.', id % 256, '.1') as ip"))
    listed = networks.parsed(spark.createDataFrame([("p", "10.0.0.0/8")], "provider string, cidr string"))
    parts = networks.in_networks(addresses, listed).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in parts) < 500
