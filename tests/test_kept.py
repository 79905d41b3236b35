"""Figures that follow changes against fresh runs."""

import pytest
from pyspark.sql import functions as F

from strata.operators import kept, mutate
from strata.plans import fixtures as fx

SF = "/root/testdata/sf0.001"
KNOWN = ["cat_1", "cat_2", "cat_3"]
CHANGES = {
    "nothing": lambda f: f,
    "set_category": lambda f: mutate.set_category(f, [1, 2, 3, 46], "cat_2", KNOWN),
    "remove": lambda f: mutate.remove(f, [4, 5, 6, 7, 17, 93]),
    "restore": lambda f: mutate.restore(f, [17, 34, 51]),
    "delete_category": lambda f: mutate.delete_category(f, "cat_3"),
    "rename_category": lambda f: mutate.rename_category(f, "cat_1", "new"),
    "fewer": lambda f: f.where("id % 3 <> 0 AND (taken IS NULL OR taken <> '2024-05')"),
    "odd": lambda f: f.withColumns({"category": F.when(F.col("id") % 5 != 1, F.col("category")), "size": F.when(F.col("id") % 4 != 1, F.col("size")), "place2": F.when(F.col("id") % 7 != 1, F.col("place2"))}),
    "none left": lambda f: f.limit(0),
}


def shown(rows):
    return sorted(str(sorted(r.asDict().items())) for r in rows.collect())


@pytest.fixture(scope="module")
def table(spark):
    columns = "id name path prev_path kind mode category second second_score score reason size duplicate_of taken reviewed corrected checked removed place1 place2 geo".split()
    rows = fx.files(spark, SF).select(*columns).collect()
    return spark.createDataFrame(rows, fx.files(spark, SF).select(*columns).schema).coalesce(2).cache()


@pytest.mark.parametrize("name", sorted(CHANGES))
def test_kept_equals_fresh(table, name):
    after = CHANGES[name](table).select(*table.columns)
    old, new = table.exceptAll(after), after.exceptAll(table)
    got, want = kept.follow(kept.start(table), after, old, new), kept.start(after)
    for figure in want:
        assert shown(got[figure]) == shown(want[figure]), figure
    back = kept.follow({"totals": want["totals"]}, table, new, old)
    assert shown(back["totals"]) == shown(kept.start(table)["totals"])
