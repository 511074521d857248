"""What the registered queries need of the session they are given."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

from litrewise.placement import folder_root, name_folder


def prepared(spark: SparkSession) -> SparkSession:
    """`spark`, in UTC, as the expected values are, and with a folder for settled data.

    The folder is the session's own `spark.checkpoint.dir`. Only a local session that names
    none, as in a trial, gets a temporary one of its machine.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if folder_root(spark) is None and re.match(r"local(\[|$)", spark.sparkContext.master):
        name_folder(spark, tempfile.mkdtemp(prefix="settled-"))
    return spark
