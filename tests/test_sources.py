import csv
import datetime as dt
import io
import random
import shutil

import pandas as pd
import pytest

from pyspark.sql import functions as F

from punctual.operators import profile
from punctual.session import shared_folder
from punctual.sources import bronze as sources
from punctual.sources import split_csv
from punctual.sources.cache import ResultCache, materialize, table_digest

REVIEWS_CSV = (
    "review_id,order_id,review_score,review_comment_title,review_comment_message,"
    "review_creation_date,review_answer_timestamp\n"
    '"r1","o1",5,"título","linha 1\nlinha 2, com ""aspas""",2018-01-01 00:00:00,2018-01-02 03:04:05\n'
    '"r2","o2",1,,"",2018-01-01 00:00:00,2018-01-02 03:04:05\n'
    '"r3","o3",,,,2018-01-01 00:00:00,2018-01-02 03:04:05\n'
    '"r4","o4",3,," ",2018-01-01 00:00:00,\n'
)


def test_csv_text_survives(spark, tmp_path):
    (tmp_path / "x_order_reviews_y.csv").write_text(REVIEWS_CSV, encoding="utf-8")
    frame = sources.Sources(str(tmp_path), "csv", "x_{table}_y.csv").read(spark, "order_reviews")
    rows = frame.orderBy("review_id").collect()
    assert [r.review_comment_message for r in rows] == ['linha 1\nlinha 2, com "aspas"', None, None, " "]
    assert [r.review_score for r in rows] == [5, 1, None, 3]
    assert rows[0].review_comment_title == "título"
    assert rows[0].review_answer_timestamp == dt.datetime(2018, 1, 2, 3, 4, 5)
    assert rows[3].review_answer_timestamp is None
    assert dict(frame.dtypes)["review_answer_timestamp"] == "timestamp_ntz"


def test_csv_keeps_leading_zeros_extra_columns_and_any_column_order(spark, tmp_path):
    (tmp_path / "customers.csv").write_text(
        "extra,customer_zip_code_prefix,customer_id,customer_unique_id,customer_city,customer_state\n"
        "e,01037,c,u,são paulo,SP\n",
        encoding="utf-8",
    )
    row = sources.Sources(str(tmp_path), "csv", "{table}.csv").read(spark, "customers").first()
    assert (row.customer_zip_code_prefix, row.customer_city, row.extra) == ("01037", "são paulo", "e")


def test_csv_that_does_not_fit_its_types_fails(spark, tmp_path):
    (tmp_path / "order_payments.csv").write_text("order_id,payment_installments,payment_value\no,many,1.0\n")
    with pytest.raises(Exception):
        sources.Sources(str(tmp_path), "csv", "{table}.csv").read(spark, "order_payments").collect()


def test_sources_bind_one_prefix(spark, tmp_path):
    assert sources.Sources("/data/", "csv", "{table}.csv").location("orders") == "/data/orders.csv"
    assert sources.Sources("db", "table").location("orders") == "db.orders"
    with pytest.raises(KeyError):
        sources.Sources(str(tmp_path)).read(spark, "sellers")
    with pytest.raises(ValueError):
        sources.Sources(str(tmp_path), "xml").read(spark, "orders")
    assert not set(sources.TABLES) & set(sources.OUT_OF_SCOPE)


def test_sql_over_a_frame(spark):
    sources.register_frame(spark, pd.DataFrame({"a": [1, 2, 3]}), "frame_view")
    assert spark.sql("SELECT sum(a) AS s FROM frame_view").first().s == 6
    assert profile.column_sum(spark.table("frame_view"), "a").first().s == 6


def test_cache_builds_once_and_again_only_when_told_or_incomplete(spark, tmp_path):
    cache = ResultCache(spark, str(tmp_path))
    calls = []

    def build():
        calls.append(1)
        return spark.range(len(calls))

    with pytest.raises(FileNotFoundError):
        cache.load("x")
    assert cache.load_or_build("x", build).count() == 1
    assert cache.load_or_build("x", build).count() == 1 and len(calls) == 1
    assert cache.load_or_build("x", build, regenerate=True).count() == 2
    # Without its manifest a version does not count, and the one before is loaded again.
    (tmp_path / "x" / "manifest=2" / "_SUCCESS").unlink()
    assert cache.load_or_build("x", build).count() == 1 and len(calls) == 2
    (tmp_path / "x" / "manifest=1" / "_SUCCESS").unlink()
    assert cache.load_or_build("x", build).count() == 3
    assert cache.load("x").count() == 3


def test_cache_follows_its_inputs(spark, tmp_path):
    cache = ResultCache(spark, str(tmp_path))
    rows = [(i, None if i % 3 else "t", float(i), [i, None], {"k": i}) for i in range(50)]
    schema = "id long, text string, x double, parts array<long>, map map<string,long>"
    calls = []

    def built(frame):
        def build():
            calls.append(1)
            return frame.select("id")

        return cache.load_or_build("x", build, inputs={"rows": frame, "other": spark.range(3)}).count()

    table = spark.createDataFrame(rows, schema)
    assert built(table) == 50 and built(table) == 50 and len(calls) == 1
    assert built(spark.createDataFrame(rows[::-1], schema).repartition(7)) == 50 and len(calls) == 1
    for change in (
        [*rows[1:], (0, "u", 0.0, [0, None], {"k": 0})],
        [*rows[1:], (0, "t", 0.0, [None, 0], {"k": 0})],
        [*rows[1:], (0, "t", 0.0, [0, None], {"l": 0})],
        [*rows[1:], (None, "t", 0.0, [0, None], {"k": 0})],
        [*rows, rows[0]],
        rows[1:],
    ):
        before = len(calls)
        assert built(spark.createDataFrame(change, schema)) == len(change) and len(calls) == before + 1
    assert built(table.withColumnRenamed("text", "title")) == 50 and len(calls) == 8


def test_swapped_nulls_and_values_have_other_digests(spark):
    one = spark.createDataFrame([("a", None), (None, "b")], "x string, y string")
    two = spark.createDataFrame([(None, "a"), ("b", None)], "x string, y string")
    assert len({table_digest(one), table_digest(two), table_digest(one.limit(0)), table_digest(one.unionAll(one))}) == 4


def test_a_broken_write_leaves_the_old_result(spark, tmp_path):
    cache = ResultCache(spark, str(tmp_path))
    cache.save("x", spark.range(4))

    def fails():
        return spark.range(8).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))

    with pytest.raises(Exception):
        cache.load_or_build("x", fails, regenerate=True)
    assert cache.load("x").count() == 4
    # The write was complete, but its manifest was not.
    cache.save("x", spark.range(9))
    newest = max((tmp_path / "x").glob("manifest=*"))
    (newest / "_SUCCESS").unlink()
    assert cache.load("x").count() == 4
    # A result may be made from its own earlier version.
    assert cache.save("x", cache.load("x").selectExpr("id * 2 AS id")).count() == 4
    assert sorted(r.id for r in cache.load("x").collect()) == [0, 2, 4, 6]
    for n in range(5):
        cache.save("x", spark.range(n))
    assert len(list((tmp_path / "x").glob("version=*"))) == 2


HARD_CSV = (
    'review_id,review_comment_title,review_comment_message,review_score\r\n'
    '"r1","a ""quoted"" word","line 1\nline 2\r\n\n""line"" 5",1\r\n'
    '\n'
    'r2,,"",2\n'
    '"r3","""","\n\n\n",3\n'
    'r4,"é,日本\n","ends with a mark""",4\r\n'
    '"r5","x","no line end",5'
)


def in_blocks(spark, size):
    session = spark.newSession()
    for key, value in {"maxPartitionBytes": size, "openCostInBytes": 1, "minPartitionNum": 1}.items():
        session.conf.set(f"spark.sql.files.{key}", str(value))
    return session


@pytest.mark.parametrize("size", [3, 5, 7, 31, 1 << 20])
def test_multi_line_csv_in_blocks(spark, tmp_path, size):
    """Line breaks and doubled marks come to lie on every border of blocks."""
    (tmp_path / "order_reviews.csv").write_bytes(HARD_CSV.encode())
    header, *rows = [r for r in csv.reader(io.StringIO(HARD_CSV, newline="")) if r]
    session = in_blocks(spark, size)
    split = sources.Sources(str(tmp_path), "csv", "{table}.csv").read(session, "order_reviews")
    assert split.columns == header
    want = [(r[0], r[1] or None, r[2] or None, int(r[3])) for r in rows]
    assert len(want) == 5 and sorted(map(tuple, split.collect()), key=lambda r: r[0]) == want
    if size < 64:
        assert split_csv._lines(session, str(tmp_path)).rdd.getNumPartitions() > 3


def test_random_csv_in_blocks(spark, tmp_path):
    rng = random.Random(3)
    pieces = ["a", "word ", '"', "\n", "\r\n", ",", "é", '""', "x\n\n\ny", ""]
    for part in range(2):
        with open(tmp_path / f"p{part}.csv", "w", encoding="utf-8", newline="") as out:
            writer = csv.writer(out, lineterminator="\n")
            writer.writerow(["review_id", "review_comment_message", "review_score"])
            writer.writerows([f"r{i}", "".join(rng.choices(pieces, k=rng.randint(0, 12))), i % 5] for i in range(part, 600, 2))
    whole = spark.read.options(header=True, multiLine=True, escape='"').csv(str(tmp_path))
    split = sources.read_csv(in_blocks(spark, 700), str(tmp_path))
    assert sorted(map(tuple, split.collect())) == sorted((r[0], r[1], int(r[2])) for r in whole.collect())


def test_a_task_reads_many_small_blocks(spark, tmp_path, monkeypatch):
    """Tasks follow the cores and the bytes, not the blocks; a record may span blocks, tasks and Arrow batches."""
    with open(tmp_path / "order_reviews.csv", "w", encoding="utf-8", newline="") as out:
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(["review_id", "review_comment_message", "review_score"])
        writer.writerows([f"r{i}", 'a "b",\r\n\n' * (900 if i % 250 == 7 else i % 4), i % 5] for i in range(1500))
    session = in_blocks(spark, 300)
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    blocks = split_csv._lines(session, str(tmp_path)).select("file", "block").distinct().count()
    tasks = split_csv._lines(session, str(tmp_path)).rdd.getNumPartitions()
    assert blocks > 4 * tasks and tasks == split_csv.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    whole = spark.read.options(header=True, multiLine=True, escape='"').csv(str(tmp_path))
    split = sources.read_csv(session, str(tmp_path))
    assert sorted(map(tuple, split.collect())) == sorted((r[0], r[1], int(r[2])) for r in whole.collect())
    monkeypatch.setattr(split_csv, "TASK_BYTES", 1000)
    assert split_csv._lines(session, str(tmp_path)).rdd.getNumPartitions() > tasks


def test_csv_with_other_columns_or_unpaired_marks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("review_id,review_score\nr1,1\n")
    (tmp_path / "b.csv").write_text("review_score,review_id\n1,r1\n")
    with pytest.raises(Exception, match="other columns"):
        sources.read_csv(spark, str(tmp_path)).collect()
    (tmp_path / "b.csv").unlink()
    (tmp_path / "a.csv").write_text('review_id,review_comment_title\nr1,5" pipe\n')
    with pytest.raises(split_csv.UnpairedQuotes):
        split_csv.csv_records(spark, str(tmp_path), ["review_id", "review_comment_title"])
    assert [tuple(r) for r in sources.read_csv(spark, str(tmp_path)).collect()] == [("r1", '5" pipe')]
    (tmp_path / "a.csv").write_text("review_id,review_score\n")
    assert sources.read_csv(spark, str(tmp_path)).collect() == []


def test_materialize_cuts_lineage(spark, tmp_path):
    source = materialize(spark.range(5), str(tmp_path / "a"))
    copy = materialize(source.selectExpr("id * 2 AS id"), str(tmp_path / "b"))
    shutil.rmtree(tmp_path / "a")
    assert sorted(r.id for r in copy.collect()) == [0, 2, 4, 6, 8]


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_csv_fixture_is_written_by_every_task(spark, tmp_path):
    """No single task holds all reviews, and files of several tasks are read back whole."""
    from punctual.catalogue import queries as catalogue
    from punctual.sources.bronze import Bronze
    from punctual.sources.star_schema import star_schema_bronze

    bronze = star_schema_bronze(spark, "/root/testdata/sf0.001")
    reviews = bronze.order_reviews.repartition(5)
    folder = catalogue._stored(spark, "csv_reviews_in_blocks")
    spread = Bronze(**{**bronze.tables(), "order_reviews": reviews})
    read = catalogue.csv_reviews_in_blocks(spark, spread)
    files = spark.read.text(f"{folder}/order_reviews.csv").select("_metadata.file_path").distinct().count()
    assert files == 5
    assert sorted(map(str, read.collect())) == sorted(map(str, reviews.drop("has_text", "text_digest").select(*read.columns).withColumn("review_id", reviews.review_id.cast("string")).withColumn("order_id", reviews.order_id.cast("string")).collect()))
