"""The place on a leg is worked out in the order of the SQL, as its last bit decides between lines that lie on each other."""

import re

from pyspark.sql import functions as F

from wayframe.checks.geometry import _T
from wayframe.functions.geo import project


def test_projection_is_that_of_the_sql_to_the_last_bit(spark, con):
    rows = [(k, *[(-100 if j % 2 == 0 else 40) + (k * (17 + 6 * j) % 997) / 9970 for j in range(6)]) for k in range(2000)]
    names = ["px", "py", "ax", "ay", "bx", "by"]
    table = spark.createDataFrame(rows, ["k", *names])
    ours = dict(table.select("k", project(*[F.col(c) for c in names])["t"]).collect())
    values = ", ".join("(" + ", ".join(f"'{v!r}'::DOUBLE" if n else str(v) for n, v in enumerate(r)) + ")" for r in rows)
    sql = f'SELECT k, {_T.format(x="px", y="py")} FROM (VALUES {values}) v(k, px, py, ax, ay, bx, by)'
    theirs = dict(con.execute(re.sub(r"\bby\b", '"by"', sql)).fetchall())
    # The two sides may round a cosine differently now and then.
    assert sum(ours[k] != float(theirs[k]) for k in ours) <= 20
