"""Tables in the shared folder: one for each use, and gone when discarded."""

import os

from skein.plans import tables


def test_settled_and_discarded(spark):
    one, two = tables.settled(spark.range(3).toDF("id")), tables.settled(spark.range(3).toDF("id"))
    assert one.count() == 3 and one._folder != two._folder
    folder = one._folder.removeprefix("file://").removeprefix("file:")
    assert os.path.isdir(folder)
    tables.discarded(one, spark.range(1))
    assert not os.path.exists(folder) and two.count() == 3
