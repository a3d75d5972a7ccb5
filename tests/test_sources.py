"""Readers against plain readings of the same files."""

import csv
import io

from wayframe.sources import readers as R


def test_line_breaks_in_values_and_a_file_of_many_splits(spark, tmp_path):
    rows = [[str(i), ["plain", "a,b", 'say "so"', "two\nlines", "\n\n", 'end "\n', "x" * 300 + "\n" + "y" * 300, "dos\r\nbreak", "", "ü"][i % 10], "z" * (i % 7)] for i in range(400)]
    rows.append(["400", "long " + "many\nlines " * 2_000, "z"])
    rows += [[str(i), "after", ""] for i in range(401, 450)]
    for name in ("a", "b"):
        out = io.StringIO()
        csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\r\n" if name == "b" else "\n").writerows([["Key", "﻿Name", "Rest"], *[[f"{name}{r[0]}", *r[1:]] for r in rows]])
        (tmp_path / f"{name}.csv").write_bytes(out.getvalue().encode())
    want = sorted((f"{n}{k}", v or None, r or None) for n in "ab" for k, v, r in rows)
    whole = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("700", "4096", whole[0]):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            df = R.read_delimited(spark, str(tmp_path), ["key", "name"], line_breaks=True)
            assert df.columns == ["key", "name", "rest"]
            got = sorted((r.key, r.name or None, r.rest or None) for r in df.collect())
            assert got == want, size
        # The one-task reading gives the same, but for line breaks in values of files with two-byte ends, which it makes one byte.
        plain = lambda v: (v or "").replace("\r\n", "\n")
        spark.conf.set("spark.sql.files.maxPartitionBytes", whole[0])
        one = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(str(tmp_path))
        assert sorted((r[0], plain(r[1]), plain(r[2])) for r in one.collect()) == sorted((k, plain(v), plain(r)) for k, v, r in want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", whole[0])
        spark.conf.set("spark.sql.files.openCostInBytes", whole[1])


def test_other_charsets_and_blank_lines(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes('Ort;"Weg"\n\n"Köln";"a\nb"\n"";""\nBonn;c\n'.encode("latin-1"))
    df = R.read_delimited(spark, str(tmp_path / "x.csv"), sep=";", encoding="ISO-8859-1", line_breaks=True)
    assert sorted((r.ort or "", r.weg or "") for r in df.collect()) in ([("Bonn", "c"), ("Köln", "a\nb")], [("", ""), ("Bonn", "c"), ("Köln", "a\nb")])
