"""Sources and the contracts checked on reading them (S-1..S-7, S-13..S-15, S-17..S-20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.identity import concat_tables
from ..operators.ordered import first_by
from ..runtime import cut


def require_columns(df: DataFrame, columns: list[str], what: str) -> DataFrame:
    """S-13: fail unless every column is there."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {', '.join(missing)}")
    return df


def undocumented_columns(df: DataFrame, documented: list[str]) -> list[str]:
    """S-13: columns nobody described."""
    return [c for c in df.columns if c not in documented]


def read_delimited(spark: SparkSession, path: str, columns: list[str] | None = None, sep: str = ",", quote: str = '"',
                   encoding: str = "UTF-8", line_breaks: bool = False) -> DataFrame:
    """S-1, S-2: delimited text with quotes and doubled quotes; headers in lower case.

    A file is split over tasks, also where quoted values may hold line breaks (``line_breaks``, see
    :func:`whole_records`); only texts of more than one byte a line break are then one task for each file.
    """
    wide = line_breaks and encoding.upper().replace("-", "").startswith(("UTF16", "UTF32"))
    df = (spark.read.option("header", True).option("multiLine", wide).option("quote", quote).option("escape", quote)
          .option("sep", sep).option("encoding", encoding).option("ignoreLeadingWhiteSpace", False).csv(path))
    if line_breaks and not wide:
        records = whole_records(spark, path, quote, encoding)
        options = {"sep": sep, "quote": quote, "escape": quote, "maxCharsPerColumn": "-1", "ignoreLeadingWhiteSpace": "false", "multiLine": "true"}
        bare = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(df.columns))])
        read = records.filter(~F.col("header")).select(F.from_csv("record", bare.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options).alias("r"))
        df = read.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(df.columns)])
    df = df.toDF(*[c.replace("\ufeff", "").strip().lower() for c in df.columns])
    return require_columns(df, columns, path) if columns else df


def whole_records(spark: SparkSession, path: str, quote: str, encoding: str) -> DataFrame:
    """Records of delimited files (header, record); a quoted value may hold line breaks, and a file is still split over tasks.

    A line stands inside a value if the quotes before it in its file are odd in number.  Quotes are counted
    for each range of a file that a task reads; the counts of the ranges before, one row each, give
    every range the state in which it starts, and its lines follow from there.  Lines that continue
    a record which began in an earlier range go to the last record that began before them.
    Line breaks inside values stay as they are.  ``header`` marks each file's first record.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    text = F.decode(F.col("value").cast("binary"), encoding)
    place = ["_file", "_from"]
    lines = raw.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from"), F.monotonically_increasing_id().alias("_at"),
                       text.alias("_text"))
    lines = lines.withColumn("_quotes", F.length("_text") - F.length(F.replace("_text", F.lit(quote), F.lit(""))))
    earlier = W.partitionBy("_file").orderBy("_from").rowsBetween(W.unboundedPreceding, -1)  # as many rows as the file has ranges
    states = lines.groupBy(*place).agg(F.sum("_quotes").alias("_n")).select(*place, (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) % 2).alias("_open"))
    row = W.partitionBy(*place).orderBy("_at")
    before = F.coalesce(F.sum("_quotes").over(row.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    marked = lines.join(states, place).withColumn("_starts", ((before + F.col("_open")) % 2 == 0).cast("bigint"))
    # The quotes are summed in the same window, so lines are dealt to their ranges once.
    numbered = cut(marked.withColumn("_no", F.sum("_starts").over(row)).drop("_open", "_quotes"))
    last = numbered.groupBy(*place).agg(F.max("_no").alias("_k")).withColumn("_last", F.last(F.when(F.col("_k") > 0, F.struct("_from", "_k")), ignorenulls=True).over(earlier))
    # The blank lines between records belong to none.
    whole = numbered.join(last.select(*place, "_last"), place).withColumn("_of", F.when(F.col("_no") > 0, F.struct("_from", F.col("_no").alias("_k"))).otherwise(F.col("_last")))
    first = (F.col("_of._from") == 0) & (F.col("_of._k") == 1)
    each = whole.groupBy("_file", "_of").agg(F.array_sort(F.collect_list(F.struct("_from", "_at", "_text"))).alias("_l"), F.max(first).alias("header"))
    return each.select("header", F.regexp_replace(F.array_join(F.transform("_l", lambda x: x["_text"]), "\n"), "\r$", "").alias("record")).filter(F.trim("record") != "")


def read_positional(spark: SparkSession, path: str, columns: dict[int, str], width: int, sep: str = "\t", encoding: str = "ISO-8859-1") -> DataFrame:
    """S-3: separated text read by column position; short rows and the header are dropped."""
    lines = spark.read.option("encoding", encoding).option("header", True).option("sep", sep).csv(path, schema=T.StructType(
        [T.StructField(f"c{i}", T.StringType()) for i in range(width)]), enforceSchema=True)
    return lines.filter(F.col(f"c{width - 1}").isNotNull()).select(*[F.trim(f"c{i}").alias(n) for i, n in columns.items()])


def decode_files(files: DataFrame, fallback: str = "windows-1252") -> DataFrame:
    """S-4: files (path, content) as text: strict UTF-8, else the fallback; reports which (path, encoding, text).

    The fallback charsets need a legacy setting, which is on for this reading only, so the
    texts are written out here.
    """
    spark, setting = files.sparkSession, "spark.sql.legacy.javaCharsets"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        valid = F.is_valid_utf8(F.col("content").cast("string"))
        text = F.when(valid, F.decode("content", "UTF-8")).otherwise(F.decode("content", fallback))
        return cut(files.select("path", F.when(valid, "utf-8").otherwise(fallback).alias("encoding"), F.regexp_replace(text, "^\ufeff", "").alias("text")))
    finally:
        spark.conf.set(setting, before)


def read_encoded(spark: SparkSession, path: str, fallback: str = "windows-1252") -> DataFrame:
    """S-4: whole files with their encoding found out."""
    return decode_files(spark.read.format("binaryFile").load(path).select("path", "content"), fallback)


def split_lines(texts: DataFrame, sep: str = ",") -> DataFrame:
    """Lines of decoded files as arrays of cells (path, line, cells)."""
    return (texts.select("path", F.posexplode(F.split("text", "\r?\n")).alias("line", "_t")).filter(F.trim("_t") != "")
            .select("path", "line", F.transform(F.split("_t", sep), lambda x: F.trim(x)).alias("cells")))


def read_array_lines(spark: SparkSession, path: str, fields: list[str], wide_fields: list[str], wide: bool) -> DataFrame:
    """S-5: one JSON array per line, by position; ``wide`` (from the sidecar's version) picks the longer layout.

    What follows the named fields is a flat list of coordinates.
    """
    names = wide_fields if wide else fields
    rows = spark.read.text(path).filter(F.length("value") > 2).select(F.from_json("value", "array<string>").alias("a"))
    every = list(dict.fromkeys([*wide_fields, *fields]))
    flat = F.transform(F.slice("a", len(names) + 1, F.size("a")), lambda x: x.cast("double"))
    return rows.select(*[(F.get("a", F.lit(names.index(n))) if n in names else F.lit(None).cast("string")).alias(n) for n in every],
                       paired(flat).alias("coords"))


def paired(flat: Column) -> Column:
    """A flat coordinate list as an array of lon/lat."""
    return F.transform(F.filter(flat, lambda x, i: i % 2 == 0), lambda x, i: F.struct(x.alias("lon"), F.get(flat, i * 2 + 1).alias("lat")))


_LINE = "array<array<double>>"


def lines_of(geometry: Column) -> Column:
    """S-6: lines of a GeoJSON geometry text: one for LineString, all for MultiLineString, none otherwise."""
    kind = F.get_json_object(geometry, "$.type")
    coords = F.get_json_object(geometry, "$.coordinates")
    lines = (F.when(kind == "LineString", F.array(F.from_json(coords, _LINE))).when(kind == "MultiLineString", F.from_json(coords, f"array<{_LINE}>"))
             .otherwise(F.array().cast(f"array<{_LINE}>")))
    return F.transform(lines, lambda line: F.transform(line, lambda c: F.struct(F.get(c, 0).alias("lon"), F.get(c, 1).alias("lat"))))


def drifting_documents(docs: DataFrame, text: str, keep: list[str] = (), rename: dict[str, str] | None = None) -> DataFrame:
    """S-5, S-6, S-20: JSON documents whose fields and types drift, as typed columns found from the data.

    The documents are parsed once as variants, and one aggregate over all of them gives the schema that holds
    them all: a field that is there at times only is null elsewhere, numbers take the wider type, and a field of
    several types comes out as text (as does one that is always null).  Fields of objects become columns
    ``outer_inner``.  ``rename`` maps the names of earlier years to today's (path to path); where both are
    there, today's counts.  Texts that are no JSON give nulls.
    """
    parsed = cut(docs.select(*keep, F.try_parse_json(text).alias("_v")))
    told = parsed.agg(F.schema_of_variant_agg("_v")).first()[0]  # one schema, whatever the number of documents
    schema = T.StructType.fromDDL("v " + told.replace("OBJECT<", "STRUCT<")) if told.startswith("OBJECT<") else T.StructType()
    found: dict[str, str] = {}

    def walk(fields: list[T.StructField], path: str) -> None:
        for f in fields:
            at = f"{path}.{f.name}" if path else f.name
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType.fields, at)
            else:
                loose = isinstance(f.dataType, (T.VariantType, T.NullType))
                found[at] = "string" if loose else f.dataType.simpleString()
    for f in schema.fields:
        walk(f.dataType.fields, "")
    read = {at: F.try_variant_get("_v", f"$.{at}", kind) for at, kind in found.items()}
    for old, new in (rename or {}).items():
        if old in read:
            earlier = read.pop(old)
            read[new] = F.coalesce(read[new], F.try_variant_get("_v", f"$.{old}", found[new])) if new in read else earlier
    return parsed.select(*keep, *[c.alias(at.replace(".", "_")) for at, c in sorted(read.items())])


def read_partitions(spark: SparkSession, path: str, system: str | None = None, states: list[str] | None = None) -> DataFrame:
    """S-7: one dataset partitioned by system and jurisdiction; only the wanted folders are read."""
    df = spark.read.parquet(path)
    if system is not None:
        df = df.filter(F.col("system") == system)
    return df if states is None else df.filter(F.col("st").isin(*states))


def way_numbers(ways: DataFrame, relations: DataFrame, way: str, ref: str, member: str) -> DataFrame:
    """S-14: route numbers of a way: its own and those of the route relations it is a member of (way, ref)."""
    own = ways.filter(F.col(ref).isNotNull()).select(way, ref)
    through = relations.filter(F.col(ref).isNotNull()).select(F.explode(member).alias(way), ref).join(ways.select(way), way, "left_semi")
    return own.unionByName(through).distinct()


def way_vertices(ways: DataFrame, nodes: DataFrame, way: str, refs: str, node: str) -> DataFrame:
    """S-15: ways (way, refs) as vertex rows in order; nodes that are not there are dropped, and ways left with one point.

    Positions are renumbered from 0 without holes.
    """
    rows = ways.select(way, F.posexplode(refs).alias("_p", node)).join(nodes.select(node, "lon", "lat"), node)
    # A way is one source object of bounded size.
    full = rows.groupBy(way).agg(F.array_sort(F.collect_list(F.struct("_p", "lon", "lat"))).alias("_v")).filter(F.size("_v") >= 2)
    return full.select(way, F.posexplode("_v").alias("seq", "_c")).select(way, "seq", "_c.lon", "_c.lat")


def edition_fallback(current: DataFrame, previous: DataFrame, key: str, year: int, previous_year: int, share: float = 0.5) -> DataFrame:
    """S-17: rows of the latest edition, but a key with under half its earlier rows keeps the earlier ones; adds ``edition``."""
    now = current.groupBy(key).agg(F.count(F.lit(1)).alias("_now"))
    then = previous.groupBy(key).agg(F.count(F.lit(1)).alias("_then"))
    short = then.join(now, key, "left").filter(F.coalesce("_now", F.lit(0)) < F.col("_then") * share).select(key)
    return (current.join(short, key, "left_anti").withColumn("edition", F.lit(year))
            .unionByName(previous.join(short, key, "left_semi").withColumn("edition", F.lit(previous_year))))


def newest_edition(resources: DataFrame, key: str, title: str, keep: list[str]) -> DataFrame:
    """S-18: the resource whose title names the latest year."""
    year = F.regexp_extract(title, r"((?:19|20)\d{2})", 1).try_cast("int")
    dated = resources.withColumn("edition_year", year).filter(F.col("edition_year").isNotNull())
    return first_by(dated, [key], ["edition_year", title], [title, "edition_year", *[k for k in keep if k != title]], largest=True)


def yearly_columns(df: DataFrame, keys: list[str], pattern: str, value: str = "value") -> DataFrame:
    """S-19: one column per year as rows (keys, year, value); the header names the year."""
    import re
    found = [(c, int(m.group(1))) for c in df.columns if (m := re.fullmatch(pattern, c))]
    if not found:
        raise ValueError(f"no yearly column like {pattern}")
    cells = F.array(*[F.struct(F.lit(y).alias("year"), F.col(c).cast("double").alias(value)) for c, y in found])
    return df.select(*keys, F.inline(cells)).filter(F.col(value).isNotNull())


def numbered_pairs(df: DataFrame, keys: list[str], year: str, value: str, n: int) -> DataFrame:
    """S-19: numbered year/value column pairs as rows."""
    require_columns(df, [f"{year}{i}" for i in range(1, n + 1)] + [f"{value}{i}" for i in range(1, n + 1)], "numbered pairs")
    cells = F.array(*[F.struct(F.col(f"{year}{i}").cast("int").alias("year"), F.col(f"{value}{i}").cast("double").alias("value")) for i in range(1, n + 1)])
    return df.select(*keys, F.inline(cells)).filter(F.col("year").isNotNull() & F.col("value").isNotNull())


def headed_columns(df: DataFrame, keys: list[str], headings: dict[str, str]) -> DataFrame:
    """S-19: one column per highway as rows; a cut-off heading belongs to the one name it begins, the last column left over to the last name."""
    columns = [c for c in df.columns if c not in keys]
    claimed: dict[str, str] = {}
    for full, name in headings.items():
        fits = [c for c in columns if c not in claimed and full.lower().startswith(c.strip().lower())]
        if len(fits) == 1:
            claimed[fits[0]] = name
    left_c, left_n = [c for c in columns if c not in claimed], [n for n in headings.values() if n not in claimed.values()]
    if len(left_c) == 1 and len(left_n) == 1:
        claimed[left_c[0]] = left_n[0]
    if len(claimed) != len(columns):
        raise ValueError(f"columns without a highway: {[c for c in columns if c not in claimed]}")
    cells = F.array(*[F.struct(F.lit(n).alias("highway"), F.col(c).cast("double").alias("value")) for c, n in claimed.items()])
    return df.select(*keys, F.inline(cells)).filter(F.col("value").isNotNull())


def drifting_union(tables: dict[int, DataFrame], aliases: dict[str, list[str]]) -> DataFrame:
    """S-20: yearly tables whose column names drift: each wanted column from the first alias a table has; adds ``year``."""
    out = []
    for year, df in tables.items():
        picked = [next((F.col(a) for a in names if a in df.columns), F.lit(None)).alias(c) for c, names in aliases.items()]
        out.append(df.select(F.lit(year).alias("year"), *picked))
    return concat_tables(*out)
