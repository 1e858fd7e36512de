"""Readers of session tables from several file formats, and their sinks. Each reader gives (sessions, violations); violations name file, key and reason."""

from __future__ import annotations

import ast
import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SESSION = "split string, sample_id string, session_id string, instructions array<string>"


def _split_of_path() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]*$", 1)


def _session(split: Column, sample: Column) -> Column:
    return F.concat_ws("/", split, sample)


def _checked(rows: DataFrame, reason: Column, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    marked = rows.withColumn("reason", reason)
    return marked.where("reason is null").select(*keep), marked.where("reason is not null").select("split", "sample_id", "reason")


def _blank(texts: Column | str) -> Column:
    return F.exists(texts, lambda t: t.isNull() | (F.trim(t) == ""))


def _repeated(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split", "sample_id").agg(F.count("*").alias("copies"))


def read_three_turns(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines in one folder a split: image, instruction (exactly three texts that are not blank), ids unique within a split."""
    raw = spark.read.schema("image string, instruction array<string>").json(f"{root}/*/*")
    sample = F.regexp_extract("image", r"([^/]+?)(\.[^.]*)?$", 1)
    rows = raw.where("image is not null or instruction is not null").select(_split_of_path().alias("split"), sample.alias("sample_id"), "image", F.col("instruction").alias("instructions"))
    counted = rows.join(_repeated(rows), ["split", "sample_id"], "left").withColumn("session_id", _session(F.col("split"), F.col("sample_id")))
    reason = (
        F.when(F.col("image").isNull() | F.contains("image", F.lit("..")), "bad image path")
        .when(F.coalesce(F.size("instructions") != 3, F.lit(True)), "not three turns")
        .when(_blank("instructions"), "blank instruction")
        .when(F.col("copies") > 1, "repeated id")
    )
    return _checked(counted, reason, ["split", "sample_id", "session_id", "image", "instructions"])


def read_variable_turns(spark: SparkSession, root: str, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """JSON lines with keys id, turn1, turn2, ...: two turns at least, without gaps."""
    names = [f"turn{k}" for k in range(1, most + 1)]
    raw = spark.read.schema("id string, " + ", ".join(f"{n} string" for n in names)).json(f"{root}/*/*")
    long = raw.where("id is not null").select(_split_of_path().alias("split"), F.col("id").alias("sample_id"), F.posexplode(F.array(*names)).alias("at", "text")).where("text is not null")
    listed = long.groupBy("split", "sample_id").agg(F.array_sort(F.collect_list(F.struct((F.col("at") + 1).alias("turn"), "text"))).alias("t"))
    rows = listed.select("split", "sample_id", _session(F.col("split"), F.col("sample_id")).alias("session_id"), F.transform("t", lambda s: s["text"]).alias("instructions"), F.transform("t", lambda s: s["turn"]).alias("at"))
    reason = (
        F.when(F.size("at") < 2, "fewer than two turns").when(F.col("at") != F.sequence(F.lit(1), F.size("at")), F.when(F.array_max("at") > F.size("at"), "gap in turns").otherwise("repeated id")).when(_blank("instructions"), "blank instruction")
    )
    return _checked(rows, reason, ["split", "sample_id", "session_id", "instructions"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def literal_list(cells: pd.Series) -> pd.Series:
    """Lists written as literals in a cell; null where a cell is none."""

    def one(cell: str | None) -> list[str] | None:
        try:
            value = ast.literal_eval(cell)
        except (ValueError, SyntaxError, TypeError):
            return None
        return value if isinstance(value, list) and all(isinstance(v, str) for v in value) else None

    return cells.map(one)


def read_prefix_csv(spark: SparkSession, path: str, turns: int = 3) -> tuple[DataFrame, DataFrame]:
    """CSV rows (image_index, turns, instructions) whose lists are the prefixes of one chain: each prefix once, none in conflict."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', schema="image_index string, turns string, instructions string")
    parsed = raw.select(F.lit("csv").alias("split"), F.col("image_index").alias("sample_id"), F.col("turns").try_cast("int").alias("turn"), literal_list("instructions").alias("list"))
    grouped = parsed.groupBy("split", "sample_id").agg(F.array_sort(F.collect_list(F.struct("turn", "list"))).alias("p"))
    longest = F.element_at("p", -1)["list"]
    fits = F.forall("p", lambda s: F.coalesce((F.size(s["list"]) == s["turn"]) & (F.slice(longest, F.lit(1), s["turn"]) == s["list"]), F.lit(False)))
    numbers = F.transform("p", lambda s: s["turn"])
    reason = (
        F.when(~F.col("sample_id").rlike("^(0|[1-9][0-9]*)$"), "bad id")
        .when(F.exists("p", lambda s: s["list"].isNull() | s["turn"].isNull()), "bad literal")
        .when(numbers != F.sequence(F.lit(1), F.lit(turns)), "prefix missing or repeated")
        .when(~fits, "prefixes in conflict")
    )
    rows = grouped.withColumns({"session_id": _session(F.col("split"), F.col("sample_id")), "instructions": longest})
    return _checked(rows, reason, ["split", "sample_id", "session_id", "instructions"])


def read_zip_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, size, copies): one archive is read by one task at a time, its directory alone is kept."""
    return zip_members(spark.read.format("binaryFile").load(path))


def zip_members(files: DataFrame) -> DataFrame:
    """The same of archives in a table (path, content)."""
    files = files.select("path", "content")

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                entries = zipfile.ZipFile(io.BytesIO(content)).infolist()
                yield pd.DataFrame({"archive": name, "member": [e.filename for e in entries], "size": [e.file_size for e in entries]})

    listed = files.mapInPandas(members, "archive string, member string, size long")
    return listed.groupBy("archive", "member").agg(F.max("size").alias("size"), F.count("*").alias("copies"))


def zip_coverage(sessions: DataFrame, members: DataFrame, member: Column) -> DataFrame:
    """Sessions whose member is missing or there more than once; unused members are allowed."""
    joined = sessions.withColumn("member", member).join(members.select("member", "copies"), "member", "left")
    return joined.select("session_id", "member", F.when(F.col("copies").isNull(), "missing member").when(F.col("copies") > 1, "repeated member").alias("reason")).where("reason is not null")


def read_run_tree(spark: SparkSession, root: str, session_schema: str, turn_schema: str) -> tuple[DataFrame, DataFrame]:
    """<root>/<session>/session.json and turn_<n>.json: session and turn tables with the identity of their paths."""
    at = lambda k: F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/([^/]+)$", k)
    sessions = spark.read.schema(session_schema).option("multiLine", True).json(f"{root}/*/session.json").select(at(1).alias("path_session"), "*")
    turns = spark.read.schema(turn_schema).option("multiLine", True).json(f"{root}/*/turn_*.json")
    return sessions, turns.select(at(1).alias("path_session"), F.regexp_extract(at(2), r"turn_(\d+)", 1).cast("long").alias("path_turn"), "*")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(origin, width, height, pixel_hash): SHA-256 of 'RGB:width:height:' and the RGB bytes; the JVM decodes."""
    import hashlib

    images = spark.read.format("image").load(path).select("image.*")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for w, h, n, data in zip(b["width"], b["height"], b["nChannels"], b["data"], strict=True):
                bgr = np.frombuffer(data, dtype=np.uint8).reshape(h, w, n)
                rgb = bgr[:, :, 2::-1] if n >= 3 else np.repeat(bgr, 3, axis=2)
                out.append(hashlib.sha256(f"RGB:{w}:{h}:".encode() + np.ascontiguousarray(rgb).tobytes()).hexdigest())
            yield pd.DataFrame({"origin": b["origin"], "width": b["width"], "height": b["height"], "pixel_hash": out})

    return images.mapInPandas(hashed, "origin string, width int, height int, pixel_hash string")


def read_arrays(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(file, step, layer, head, values): positions of one array [step, layer, head, element] of each NPZ file; only that array is read."""
    return array_positions(spark.read.format("binaryFile").load(path), name)


def array_positions(files: DataFrame, name: str) -> DataFrame:
    """The same of files in a table (path, content)."""
    files = files.select("path", "content")

    def positions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                array = np.load(io.BytesIO(content))[name].astype(np.float64)
                for step in range(array.shape[0]):
                    layer, head = np.indices(array.shape[1:3]).reshape(2, -1)
                    yield pd.DataFrame({"file": file, "step": step, "layer": layer, "head": head, "values": list(array[step].reshape(len(layer), -1))})

    return files.mapInPandas(positions, "file string, step long, layer long, head long, values array<double>")


def write_manifest(rows: DataFrame, path: str) -> None:
    """Compressed JSON lines; an existing manifest is refused."""
    rows.write.mode("errorifexists").option("compression", "gzip").json(path)


def write_tables(parts: list[DataFrame], path: str) -> None:
    """CSV with the union of the columns; a number that is not finite stops the job."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    finite = [F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), F.raise_error(F.lit(f"{c} is not finite"))).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in whole.dtypes]
    whole.select(*finite).write.mode("errorifexists").option("header", True).option("compression", "gzip").csv(path)


def write_metrics(rows: DataFrame, path: str, metrics: list[str], by: str) -> None:
    """Metric values as array<struct<metric, value, valid>>, in one folder for each value of `by`."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.coalesce(m, F.lit(0.0)).alias("value"), F.col(m).isNotNull().alias("valid")) for m in metrics])
    rows.select(*[c for c in rows.columns if c not in metrics], each.alias("metrics")).write.partitionBy(by).parquet(path)


def append_events(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
