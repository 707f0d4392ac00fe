"""Search by grams finds what a scan finds; name changes carry what their events say."""

import datetime as dt

import pytest

from chronolith.operators import scd2

D = dt.date(2020, 1, 1)
SCHEMA = "entity_id long, code string, name string, entity_type string, market string, valid_from date, valid_to date, knowledge_time timestamp_ntz, version long"


@pytest.fixture(scope="module")
def identity(spark):
    names = [("600000.SH", "Bank of Ürümqi"), ("600001.SH", "BANKBANK"), ("AB", None), (None, "ban"), ("x", "aaaa"), ("y", "a%a_a"), ("z", "上海银行股份"), ("z", "ab ank")]
    return spark.createDataFrame([(n // 2 if n > 5 else n, c, name, "equity", "cn", D, None, dt.datetime(2020, 1, 1), n) for n, (c, name) in enumerate(names)], SCHEMA)


@pytest.mark.parametrize("text", ["ban", "BANK", "ank", "600", "00.s", "a", "aaa", "aaaaa", "%a_", "银行股", "ürü", "absent", "", None, "ankb", "nkb"])
def test_search_by_grams_equals_a_scan(spark, identity, tmp_path, text):
    index = scd2.search_index(identity)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(scd2.search(identity, text, index=index)) == rows(scd2.search(identity, text))


def test_index_has_each_gram_of_an_entity_once(identity):
    got = sorted(tuple(r) for r in scd2.search_index(identity.where("name = 'aaaa' OR code = 'AB'")).collect())
    assert got == [("aaa", 4)]


def test_columns_of_events_stand_on_the_new_name(spark):
    who = spark.createDataFrame([(1, "c", "old", "equity", "cn", None, None, None, 3)], SCHEMA)
    events = spark.createDataFrame([(1, "mid", D, dt.date(2020, 2, 1), dt.date(2019, 12, 1), {"k": "v"}), (1, "new", dt.date(2020, 6, 1), None, None, None)], "entity_id long, new_name string, start date, end date, ann_date date, attrs map<string,string>").drop("attrs")
    got = [tuple(r) for r in scd2.name_changes(who, events).orderBy("version").collect()]
    first = dt.date(1990, 1, 1)
    assert got == [
        (1, "close", "old", first, dt.date(2019, 12, 31), 4, None), (1, "name", "mid", D, dt.date(2020, 2, 1), 5, dt.date(2019, 12, 1)), (1, "resume", "old", dt.date(2020, 2, 2), None, 6, None),
        (1, "close", "old", dt.date(2020, 2, 2), dt.date(2020, 5, 31), 7, None), (1, "name", "new", dt.date(2020, 6, 1), None, 8, None),
    ]
    plan = scd2.name_changes(who, events)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert scd2.name_changes(who, events.limit(0)).count() == 0
