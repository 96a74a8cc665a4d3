"""Reading and writing tables of the lake: typed CSV, snapshots with manifests, partitions, upserts and versions."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import stored


def read_csv(spark: SparkSession, path: str, schema: str, times: Sequence[str] = ()) -> DataFrame:
    """CSV with a header as typed rows: blanks are null, times without zone are UTC, what can't be cast is null."""
    want = StructType.fromDDL(schema)
    raw = spark.read.option("header", True).schema(StructType.fromDDL(", ".join(f"`{f.name}` string" for f in want))).csv(path)
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return raw.select(*[blank(F.col(f.name)).try_cast("timestamp" if f.name in times else f.dataType).alias(f.name) for f in want])


def load_odds_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    out = read_csv(spark, path, schema, ["captured_at", "available_at"])
    return out.withColumn("captured_at", F.coalesce("captured_at", "available_at"))


#: Bytes of a file that one row of a snapshot holds.
RANGE = 8 << 20


def _read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each (path, start, length) with their hash, in batches of one range, or several short ones; a file stays open for its ranges."""
    names = ["name", "start", "length", "sha256", "content"]
    opened, f, rows, held = None, None, [], 0
    try:
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != opened:
                    if f is not None:
                        f.close()
                    files, path = fs.FileSystem.from_uri(quote(row["path"], safe=":/@"))
                    f, opened = files.open_input_file(path), row["path"]
                content = f.read_at(row["length"], row["start"])
                if len(content) != row["length"]:
                    raise OSError(f"{row['path']} has changed while it was read")
                if rows and (held + len(content) > RANGE or len(rows) >= 10000):
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*rows, strict=True)], names)
                    rows, held = [], 0
                rows.append((row["name"], row["start"], row["length"], hashlib.sha256(content).hexdigest(), content))
                held += len(content)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*rows, strict=True)], names)
    finally:
        if f is not None:
            f.close()


def _hashes(files: DataFrame) -> DataFrame:
    """``(name, sha256, length)`` of every file: the hash of its contents if they are one range, else of the ranges' hashes in order."""
    parts = F.array_sort(F.collect_list(F.struct("start", "sha256")))
    whole = F.when(F.size(parts) == 1, parts[0]["sha256"]).otherwise(F.sha2(F.array_join(F.transform(parts, lambda x: x["sha256"]), ""), 256))
    return files.groupBy("name").agg(whole.alias("sha256"), F.sum("length").alias("length"))


def snapshot(spark: SparkSession, path: str, base: str, size: int = RANGE) -> str:
    """Copy files to an immutable folder named by their contents, with a manifest, and point ``base``/latest to it.

    Returns the snapshot id, the first 16 hex digits of the hash over file names and hashes; the same contents change nothing
    but the pointer. Files are read once, in ranges of ``size`` bytes dealt over the tasks, so a file may be of any length;
    their paths must be within reach of the tasks by the same address. What is copied is staged and renamed when it is
    complete, the pointer is replaced last: a writer that fails leaves the old snapshot as the latest. Without files: an error.
    """
    files = spark.read.format("binaryFile").load(path)
    address = F.regexp_replace("path", "^file:/+", "file:///").alias("path")
    sized = files.select(address, "length")  # contents aren't read here, and Spark leaves out empty files
    names = spark.createDataFrame([(unquote(f),) for f in files.inputFiles()], "path string")  # what Spark has listed itself
    listed = names.select(address).join(sized, "path", "left").select("path", F.coalesce("length", F.lit(0).cast("long")).alias("length"))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0).cast("long")), F.lit(size).cast("long"))
    name = F.element_at(F.split("path", "/"), -1)
    ranges = listed.select("path", name.alias("name"), F.col("length").alias("_all"), F.explode(starts).alias("start"))
    ranges = ranges.withColumn("length", F.least(F.lit(size).cast("long"), F.col("_all") - F.col("start"))).drop("_all")
    n, total = ranges.agg(F.count(F.lit(1)), F.sum("length")).first()
    if not n:
        raise FileNotFoundError(f"no files at {path}")
    staged = f"{base}/.staged-{uuid.uuid4().hex}"
    # As many tasks as the bytes need, not the ranges; a few for each core at least, unless there are fewer ranges.
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-total // (16 * RANGE)))
    dealt = ranges.repartition(min(n, tasks, 20000), "path", "start").sortWithinPartitions("path", "start")
    dealt.mapInArrow(_read_ranges, "name string, start long, length long, sha256 string, content binary").write.parquet(f"{staged}/files")
    write_manifest(spark, staged)
    rows = F.array_sort(F.collect_list(F.concat_ws(":", "name", "sha256")))  # a line a file
    key = read_manifest(spark, staged).agg(F.sha2(F.array_join(rows, "\n"), 256).alias("k")).first()["k"][:16]
    if not exists(spark, f"{base}/{key}/manifest/_SUCCESS"):
        _move(spark, staged, f"{base}/{key}")
    else:
        _drop(spark, staged)
    pointer = f"{base}/.latest-{uuid.uuid4().hex}"
    _write_text(spark, pointer, key)
    _move(spark, pointer, f"{base}/latest", replace=True)
    return key


def latest_snapshot(spark: SparkSession, base: str) -> str | None:
    """The folder of the snapshot that was taken last, None if there is none or it is gone."""
    if not exists(spark, f"{base}/latest"):
        return None
    target = f"{base}/{spark.read.text(f'{base}/latest').first()['value']}"
    return target if exists(spark, target) else None


def write_manifest(spark: SparkSession, target: str) -> None:
    """Names, hashes and lengths of the files of a snapshot, as JSON beside them."""
    _hashes(spark.read.parquet(f"{target}/files")).write.mode("overwrite").json(f"{target}/manifest")


def read_manifest(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema("name string, sha256 string, length long").json(f"{target}/manifest")


def verify_manifest(spark: SparkSession, target: str) -> DataFrame:
    """Files of a snapshot whose contents don't match the manifest, or that one of the two lacks; contents are hashed anew."""
    have = _hashes(spark.read.parquet(f"{target}/files").withColumn("sha256", F.sha2("content", 256))).select("name", F.col("sha256").alias("found"))
    return read_manifest(spark, target).join(have, "name", "full").where(~F.col("found").eqNullSafe(F.col("sha256"))).select("name", "sha256", "found")


def read_ndjson(spark: SparkSession, paths: str | list[str], schema: str, pattern: str = ".*") -> DataFrame:
    """Raw JSON records (gz too) of the files whose name matches, with ``file``."""
    rows = spark.read.schema(schema).json(paths).withColumn("file", F.col("_metadata.file_name"))
    return rows.where(F.col("file").rlike(pattern))


def merge_by_hash(new: DataFrame, existing: DataFrame, key: str = "content_hash") -> DataFrame:
    """Existing rows and those of ``new`` whose hash isn't there, one per hash; ``is_new`` tells them apart."""
    fresh = new.dropDuplicates([key]).join(existing.select(key), key, "left_anti").withColumn("is_new", F.lit(True))
    return existing.withColumn("is_new", F.lit(False)).unionByName(fresh, allowMissingColumns=True)


def parse_fixed_width(df: DataFrame, raw: str, layout: Sequence[tuple[str, int, int, str]]) -> DataFrame:
    """Typed columns from byte ranges (first from 1, length) of binary records; blanks and unreadable values are null.

    Text is decoded from code page 932, which needs ``spark.sql.legacy.javaCharsets``.
    """
    out = []
    for name, first, length, kind in layout:
        text = F.nullif(F.trim(F.decode(F.substring(F.col(raw), first, length), "windows-31j")), F.lit(""))
        out.append((text if kind == "string" else text.try_cast(kind)).alias(name))
    return df.select(*[c for c in df.columns if c != raw], *out)


def explode_slots(df: DataFrame, text: str, first: int, stride: int, n: int, fields: Sequence[tuple[str, int, int]]) -> DataFrame:
    """One row for each non-blank slot of a repeating block, ``slot`` from 1."""
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((i + 1).alias("slot"), F.substring(F.col(text), i * stride + first, F.lit(stride)).alias("s")))
    rows = df.select(*[c for c in df.columns if c != text], F.explode(F.filter(at, lambda z: F.trim(z["s"]) != "")).alias("z"))
    return rows.select(*[c for c in df.columns if c != text], "z.slot", *[F.substring("z.s", a, k).alias(f) for f, a, k in fields])


def flatten_odds(df: DataFrame, payload: str, captured: str) -> DataFrame:
    """Rows (sel, win_odds, popularity, place_low, place_high, at) of odds payloads, win and place merged by selection."""
    schema = "status string, data struct<official_datetime:string, odds:map<string,map<string,array<string>>>>"
    keep = [c for c in df.columns if c != payload]
    p = df.withColumn("_p", F.from_json(payload, schema)).select(*keep, F.coalesce(F.col("_p.data.official_datetime").try_cast("timestamp"), F.col(captured).cast("timestamp")).alias("at"), F.col("_p.data.odds").alias("odds"))
    win, place = F.try_element_at("odds", F.lit("1")), F.try_element_at("odds", F.lit("2"))
    empty = F.array().cast("array<string>")
    sels = F.array_union(F.coalesce(F.map_keys(win), empty), F.coalesce(F.map_keys(place), empty))
    rows = p.withColumn("sel", F.explode(sels)).withColumn("w", F.try_element_at(win, F.col("sel"))).withColumn("l", F.try_element_at(place, F.col("sel")))
    num = lambda c, k: F.get(c, F.lit(k)).try_cast("double")
    return rows.select(*keep, "at", "sel", num("w", 0).alias("win_odds"), F.get("w", F.lit(2)).try_cast("int").alias("popularity"), num("l", 0).alias("place_low"), num("l", 1).alias("place_high"))


def flatten_combo_odds(df: DataFrame, payload: str) -> DataFrame:
    """Rows (block, combo, odds, popularity) of payloads keyed by block and combo; first value odds, last popularity."""
    keep = [c for c in df.columns if c != payload]
    blocks = df.select(*keep, F.explode(F.from_json(payload, "map<string,map<string,array<string>>>")).alias("block", "m"))
    rows = blocks.select(*keep, "block", F.explode("m").alias("combo", "v"))
    return rows.select(*keep, "block", "combo", F.try_element_at("v", F.lit(1)).try_cast("double").alias("odds"), F.try_element_at("v", F.lit(-1)).try_cast("int").alias("popularity"))


def extract_rows(pages: DataFrame, html: str, row: str, cells: dict[str, str]) -> DataFrame:
    """One row for each match of ``row`` in a page, its cells by patterns (group 1), null if a cell isn't there."""
    keep = [c for c in pages.columns if c != html]
    found = pages.select(*keep, F.posexplode(F.regexp_extract_all(html, F.lit(row), F.lit(0))).alias("pos", "_row"))
    return found.select(*keep, "pos", *[F.nullif(F.regexp_extract("_row", p, 1), F.lit("")).alias(n) for n, p in cells.items()])


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _move(spark: SparkSession, source: str, target: str, replace: bool = False) -> None:
    """Rename in the tables' file system, where a target that is there is kept unless it is to be replaced."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = (jvm.org.apache.hadoop.fs.Path(x) for x in (source, target))
    if replace:
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(b.getFileSystem(conf).getUri(), conf).rename(a, b, options)
    elif not a.getFileSystem(conf).rename(a, b):
        raise OSError(f"{source} could not be renamed to {target}")


def _drop(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_partitioned(df: DataFrame, base: str, by: Sequence[str]) -> None:
    """Replace the touched partitions alone. Rows are dealt by partition, and a partition that is too large for a task to
    several of them."""
    df.hint("rebalance", *by).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*by).parquet(base)


def read_partitioned(spark: SparkSession, base: str | list[str], schema: str) -> DataFrame:
    """Read with declared types, partition columns too, so that ``"06"`` keeps its zero; missing columns are null."""
    return spark.read.schema(schema).option("mergeSchema", True).parquet(*([base] if isinstance(base, str) else base))


def append_new(new: DataFrame, existing: DataFrame, key: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """Rows of ``new`` to append: one per key that isn't in the table."""
    w = Window.partitionBy(*key).orderBy(*ties)
    one = new.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return one.join(existing.select(*key), list(key), "left_anti")


def last_write_wins(existing: DataFrame, new: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Union by key: a new row replaces an old one, the highest ``order`` a lower one."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.desc("_new"), F.desc(order))
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def partition_upsert(new: DataFrame, base: str, by: Sequence[str], natural_key: Sequence[str], available: str, order: str) -> int:
    """Merge rows into a table partitioned ``by``; how many of their keys, ``natural_key`` with ``available``, it did not have.

    Of rows of a key the one with the highest ``order`` counts, and a new one replaces what is there. Only the partitions of
    the new rows are read, and only those that get a new key are written; all other files stay as they are. What is merged is
    stored first and then replaces its partitions when the whole write has succeeded: a writer that fails leaves the old
    state, and after a crash among the last renames the same call completes them. Null keys match each other.
    """
    spark, key = new.sparkSession, [*natural_key, available]
    first = Window.partitionBy(*by, *key).orderBy(F.desc_nulls_last(order))
    rows = stored(new.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn"), "upsert")
    if exists(spark, base):
        # A table's partitions are few enough for the driver to list; their values prune the scan.
        touched = rows.select(*by).distinct().collect()
        old = spark.read.schema(new.schema).parquet(base)
        for c in by:
            values = {r[c] for r in touched}
            old = old.where(F.col(c).isin([v for v in values if v is not None]) | (F.col(c).isNull() if None in values else F.lit(False)))
    else:
        old = rows.limit(0)
    same = Window.partitionBy(*by, *key).orderBy(F.desc("_new"))
    both = old.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    merged = both.withColumns({"_rn": F.row_number().over(same), "_old": F.min("_new").over(Window.partitionBy(*by, *key))}).where("_rn = 1").drop("_rn")
    merged = stored(merged, "merged")
    fresh = (F.col("_new") == 1) & (F.col("_old") == 1)
    counts = merged.where(fresh).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    n = counts.agg(F.sum("_n").alias("n")).first()["n"] or 0
    if n:
        grown = F.lit(True)
        for c in by:
            grown = grown & merged[c].eqNullSafe(counts[c])
        write_partitioned(merged.join(counts, grown, "left_semi").select(*new.columns), base, by)
    return n


def upsert_on_key(existing: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    return existing.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def append_versioned(existing: DataFrame, new: DataFrame, group: Sequence[str]) -> DataFrame:
    """New rows with each group's next version."""
    top = existing.groupBy(*group).agg(F.max("version").alias("_v"))
    return new.join(top, list(group), "left").withColumn("version", F.coalesce("_v", F.lit(0)) + 1).drop("_v")


def unchanged(before: DataFrame, after: DataFrame) -> bool:
    """Whether every row of ``before`` is in ``after`` as it was."""
    return before.exceptAll(after.select(*before.columns)).isEmpty()


def run_id(name: str, features: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(name), features), 256)


def upsert_run(df: DataFrame, base: str, run: str) -> None:
    """Store a run's rows under its id: a rerun replaces its own rows, other runs stay."""
    write_partitioned(df.withColumn("run_id", F.lit(run)), base, ["run_id"])


def hash_gated(new: DataFrame, stored: DataFrame, key: Sequence[str], hash_: str) -> DataFrame:
    """Rows of ``new`` whose hash isn't what is stored."""
    old = stored.select(*key, F.col(hash_).alias("_h"))
    return new.join(old, list(key), "left").where(~F.col(hash_).eqNullSafe(F.col("_h"))).drop("_h")


def conditional_upsert(stored: DataFrame, new: DataFrame, key: str, owner: str, state: str) -> DataFrame:
    """``outcome`` of each new row: inserted, updated (same owner, still open), conflict or closed."""
    old = stored.select(key, F.col(owner).alias("_o"), F.col(state).alias("_s"))
    code = F.when(F.col("_o").isNull(), "inserted").when(F.col("_o") != F.col(owner), "conflict").when(F.col("_s") != "open", "closed").otherwise("updated")
    return new.join(old, key, "left").withColumn("outcome", code).drop("_o", "_s")


def lww_merge(local: DataFrame, server: DataFrame, key: Sequence[str], time: str, values: Sequence[str]) -> DataFrame:
    """Newest of two copies by ``time``, the local one on a tie."""
    both = local.withColumn("_l", F.lit(1)).unionByName(server.withColumn("_l", F.lit(0)))
    best = both.groupBy(*key).agg(F.max_by(F.struct(time, *values), F.struct(time, "_l")).alias("b"))
    return best.select(*key, "b.*")


def replace_user_rows(stored: DataFrame, new: DataFrame, user: str, valid: Column, most: int, order: Sequence[str]) -> DataFrame:
    """Each user's rows replaced by their valid new ones, ``most`` at most."""
    w = Window.partitionBy(user).orderBy(*order)
    fine = new.where(valid).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")
    return stored.join(new.select(user).distinct(), user, "left_anti").unionByName(fine)


def validate_tickets(df: DataFrame, payload: str, types: dict[str, int], most_lines: int = 100, most_bytes: int = 20_000) -> DataFrame:
    """``reject`` code per ticket payload, null if it is sound; the cost must be the unit times the lines."""
    p = F.from_json(payload, "ticket struct<type:string, lines:array<struct<combo:array<string>>>>, unit int, cost int, race struct<raceKey:string>")
    t = df.withColumn("_p", p)
    size = None
    for k, n in types.items():
        size = F.when(F.col("_p.ticket.type") == k, n) if size is None else size.when(F.col("_p.ticket.type") == k, n)
    lines = F.col("_p.ticket.lines")
    sound = F.forall(lines, lambda z: (F.size(z["combo"]) == size) & (F.size(F.array_distinct(z["combo"])) == size) & F.forall(z["combo"], lambda c: c.rlike("^[0-9]{1,2}$")))
    code = (
        F.when(F.octet_length(payload) > most_bytes, "too_large").when(F.col("_p.ticket.type").isNull() | lines.isNull(), "malformed").when(size.isNull(), "type")
        .when(~F.size(lines).between(1, most_lines), "lines").when(~F.coalesce(sound, F.lit(False)), "combo")
        .when(F.coalesce(F.col("_p.unit") <= 0, F.lit(True)), "unit").when(~F.col("_p.cost").eqNullSafe(F.col("_p.unit") * F.size(lines)), "cost")
        .when(~F.coalesce(F.col("_p.race.raceKey").rlike("^[0-9]{8}-[0-9]{2}-[0-9]{2}$"), F.lit(False)), "race")
    )
    return t.withColumn("reject", code).drop("_p")
