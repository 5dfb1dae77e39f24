"""Alignments by other programs, tig layouts, viewer layouts and assembly tables: readers, all of which split files between tasks, and writers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import _text

#: Letters of a quality string begin at this code.
ZERO = 48
READ = "struct<kind:string,ident:long,container:long,parent:long,a_hang:int,b_hang:int,bgn:int,end:int>"


def _word(words: Column | str, i: int | Column, kind: str = "string") -> Column:
    return F.get(words, F.lit(i) if isinstance(i, int) else i).try_cast(kind)


def coordinates(spark: SparkSession, path: str, least: float = 0.0) -> DataFrame:
    """(read, r_bgn, r_end, reverse, genome, g_bgn, g_end, identity, error) of coordinate tables of a whole-genome aligner.

    Positions are as given, from 1; those of a reversed read are swapped.  Lines that
    don't begin with a number are headers; names are the last two words.  Alignments below `least`
    per cent are left out; error names lines that are too short or run backwards.
    """
    t = spark.read.text(path).select(F.split(F.trim(F.translate("value", "|", " ")), r"\s+").alias("w")).where(F.col("w")[0].rlike(r"^\d+$"))
    x, y = _word("w", 2, "long"), _word("w", 3, "long")
    out = t.select(
        _word("w", F.size("w") - 1).alias("read"), F.least(x, y).alias("r_bgn"), F.greatest(x, y).alias("r_end"), (x > y).alias("reverse"), _word("w", F.size("w") - 2).alias("genome"),
        _word("w", 0, "long").alias("g_bgn"), _word("w", 1, "long").alias("g_end"), _word("w", 6, "double").alias("identity"), F.size("w").alias("n"),
    )
    error = F.when(F.col("n") < 9, "too_short").when(F.col("identity").isNull() | F.col("r_bgn").isNull(), "no_number").when((F.col("r_bgn") >= F.col("r_end")) | (F.col("g_bgn") >= F.col("g_end")), "empty_range")
    return out.withColumn("error", error).where(F.col("error").isNotNull() | (F.col("identity") >= least)).drop("n")


def tigs(spark: SparkSession, path: str, kind: str = "unitig") -> DataFrame:
    """(id, length, cns, qlt, data, reads) of tig layouts as text, a row for each block that begins with `kind` and a number.

    data maps what follows "data." to its value; reads are FRG lines in their
    order.  Files that hold unitigs and contigs are to be read once for each
    kind alone, as one kind's blocks end at the next one of that kind.
    """
    t = spark.read.option("lineSep", f"\n{kind} ").text(path).select(F.regexp_replace(F.regexp_replace("value", "\r", ""), rf"^\s*{kind} ", "").alias("t"))
    lines = F.transform(F.split("t", "\n"), lambda x: F.split(F.trim(x), r"\s+"))
    t = t.select(F.regexp_extract("t", r"^(\d+)", 1).try_cast("long").alias("id"), lines.alias("l")).where("id is not null")
    one = lambda name: F.get(F.filter("l", lambda w: w[0] == name), F.lit(0))
    data = F.transform(F.filter("l", lambda w: w[0].startswith("data.") & (F.size(w) > 1)), lambda w: F.struct(F.substring(w[0], 6, 200).alias("k"), w[1].alias("v")))
    named = F.aggregate(data, F.expr("cast(map() as map<string,string>)"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: k != x["k"]), F.create_map(x["k"], x["v"])))

    def read(w: Column) -> Column:
        after = lambda name, i, k: F.get(w, F.array_position(w, name).cast("int") + i).try_cast(k)  # noqa: E731  (positions count from 1)
        return F.struct(
            after("type", 0, "string").alias("kind"), after("ident", 0, "long").alias("ident"), after("container", 0, "long").alias("container"), after("parent", 0, "long").alias("parent"),
            after("hang", 0, "int").alias("a_hang"), after("hang", 1, "int").alias("b_hang"), after("position", 0, "int").alias("bgn"), after("position", 1, "int").alias("end"),
        )

    reads = F.transform(F.filter("l", lambda w: w[0] == "FRG"), read)
    return t.select("id", _word(one("len"), 1, "long").alias("length"), F.coalesce(_word(one("cns"), 1), F.lit("")).alias("cns"), F.coalesce(_word(one("qlt"), 1), F.lit("")).alias("qlt"), named.alias("data"), reads.alias("reads"))


def write_tigs(df: DataFrame, path: str, kind: str = "unitig") -> None:
    """Writes rows as `tigs` reads them."""
    line = lambda r: F.format_string(
        "FRG type %s ident %d container %d parent %d hang %d %d position %d %d", r["kind"], r["ident"], r["container"], r["parent"], r["a_hang"], r["b_hang"], r["bgn"], r["end"]
    )
    data = F.transform(F.array_sort(F.map_entries("data")), lambda e: F.concat(F.lit("data."), e["key"], F.lit(" "), e["value"]))
    head = F.array(*(F.concat_ws(" ", F.lit(k), F.col(c).cast("string")) for k, c in ((kind, "id"), ("len", "length"), ("cns", "cns"), ("qlt", "qlt"))))
    _text(df.select(F.concat_ws("\n", F.concat(head, data, F.transform("reads", line))).alias("value")), path, None)


def viewer(spark: SparkSession, path: str) -> DataFrame:
    """(kind, name, words, comment, color, thick, bgn, end, row, styles) of the lines of a viewer's layout.

    kind is style, line, attribute, link or overlap.  A line's words are places
    and A... styles, bgn and end the first and last place, row its R number, styles
    those of its pieces; a style has its C color and T thickness; links and overlaps
    list the names of their objects.  What follows # is the comment.
    """
    t = spark.read.text(path).where(F.trim("value") != "")
    body = F.trim(F.regexp_replace("value", r"\s*#.*$", ""))
    t = t.select(F.regexp_extract("value", r"#\s*(.*?)\s*$", 1).alias("comment"), F.regexp_extract(body, r"^([^:]*):", 1).alias("name"), F.trim(F.regexp_replace(body, r"^[^:]*:", "")).alias("rest"), body.alias("body")).where("body <> ''")
    kind = F.when(F.col("name") == "ATT", "attribute").when(F.col("name") == "LNK", "link").when(F.col("name") == "OVL", "overlap").when(F.col("rest").rlike(r"^-?\d"), "line").otherwise("style")
    t = t.select("name", "rest", "comment", kind.alias("kind"), F.filter(F.split("rest", r"\s+"), lambda w: w != "").alias("words"))
    line, style = F.col("kind") == "line", F.col("kind") == "style"
    at = F.filter("words", lambda w: w.rlike(r"^-?\d+$"))
    letter = lambda c: F.get(F.filter("words", lambda w: w.rlike(f"^{c}[0-9A-Fa-f]+$")), F.lit(0))
    return t.select(
        "kind", "name", "words", "comment", F.when(style, F.substring(letter("C"), 2, 6)).alias("color"), F.when(style, F.substring(letter("T"), 2, 9)).try_cast("int").alias("thick"),
        F.when(line, F.get(at, F.lit(0))).try_cast("long").alias("bgn"), F.when(line, F.element_at(at, -1)).try_cast("long").alias("end"), F.when(line, F.substring(letter("R"), 2, 9)).try_cast("int").alias("row"),
        F.when(line, F.transform(F.filter("words", lambda w: w.startswith("A")), lambda w: F.substring(w, 2, 200))).alias("styles"),
    )


def write_viewer(lines: DataFrame, path: str, styles: Mapping[str, str] | None = None) -> None:
    """Writes lines(name, bgn, end, style, row, comment) and the styles they name, as `viewer` reads them; styles come first."""
    spark = lines.sparkSession
    body = lines.select(F.format_string("%s: %d A%s %d R%d # %s", "name", "bgn", "style", "end", "row", F.coalesce("comment", F.lit(""))).alias("value"))
    if styles:
        body = spark.createDataFrame([(f"{k}: {v}",) for k, v in styles.items()], "value string").coalesce(1).unionByName(body)
    _text(body, path, None)


def quality_fasta(df: DataFrame, path: str) -> None:
    """Writes df(name, qlt) with quality letters as numbers of two digits, a line for each record; null is empty."""
    numbers = F.array_join(F.transform(F.filter(F.split(F.coalesce("qlt", F.lit("")), ""), lambda c: c != ""), lambda c: F.format_string("%02d", F.ascii(c) - ZERO)), " ")
    _text(df.select(F.concat(F.lit(">"), "name", F.lit("\n"), numbers).alias("value")), path, None)


def write_database(tables: Mapping[str, DataFrame], path: str, how: str = "parquet") -> None:
    """Writes each table to path/name: "parquet", "delimited" (tabs, with a header) or "insert" (SQL statements)."""
    if how not in ("parquet", "delimited", "insert"):
        raise ValueError(f"how is {how!r}")
    for name, df in tables.items():
        at = f"{path}/{name}"
        if how == "parquet":
            df.write.mode("overwrite").parquet(at)
        elif how == "delimited":
            df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(at)
        else:
            kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
            bare = ("byte", "short", "integer", "long", "float", "double", "boolean", "decimal")
            shown = [F.col(c).cast("string") if kinds[c] in bare else F.concat(F.lit("'"), F.replace(F.col(c).cast("string"), F.lit("'"), F.lit("''")), F.lit("'")) for c in df.columns]
            values = F.concat_ws(", ", *(F.coalesce(c, F.lit("NULL")) for c in shown))
            _text(df.select(F.concat(F.lit(f"INSERT INTO {name} ({', '.join(df.columns)}) VALUES ("), values, F.lit(");")).alias("value")), at, None)


def database(spark: SparkSession, path: str, schemas: Mapping[str, str], how: str = "parquet") -> dict[str, DataFrame]:
    """The tables of write_database, each also a view of its name, so that SQL can join them."""
    out = {}
    for name, schema in schemas.items():
        r = spark.read.schema(schema)
        out[name] = r.parquet(f"{path}/{name}") if how == "parquet" else r.option("sep", "\t").option("header", True).csv(f"{path}/{name}")
        out[name].createOrReplaceTempView(name)
    return out
