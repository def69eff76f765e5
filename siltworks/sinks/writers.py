"""Sinks: JSON lines, reports, ledgers, run records, streams, checkpoints. Paths may be of any file system that Spark reaches."""

from __future__ import annotations

import json
import traceback
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def refuse_same(spark: SparkSession, source: str, target: str) -> None:
    """Raises where both paths are one place, or one lies in the other."""
    clean = lambda x: _fs(spark, x)[0].makeQualified(_fs(spark, x)[1]).toString().rstrip("/") + "/"
    a, b = clean(source), clean(target)
    if a.startswith(b) or b.startswith(a):
        raise ValueError(f"{target} would overwrite {source}")


def write_jsonl(df: DataFrame, path: str, replace: bool = False) -> int:
    """Writes rows as JSON lines (UTF-8, not escaped) and returns their number: the lines of the committed files, so df runs once and a task that is tried again counts once. A path that is there is refused, or replaced."""
    df.write.mode("overwrite" if replace else "errorifexists").json(path)
    return df.sparkSession.read.text(path).count()


def pass_through(spark: SparkSession, source: str, target: str) -> None:
    """Copies a held-out split byte for byte; nothing is parsed. The target must not exist."""
    refuse_same(spark, source, target)
    (a, p), (b, q) = _fs(spark, source), _fs(spark, target)
    if b.exists(q):
        raise FileExistsError(target)
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(a, p, b, q, False, spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, written beside its place and then moved there, so that no reader sees half of it. An old file is replaced."""
    fs, p = _fs(spark, path)
    fresh = _fs(spark, f"{path}.{uuid.uuid4().hex}.new")[1]
    out = fs.create(fresh)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(p):
        fs.delete(p, True)
    if not fs.rename(fresh, p):
        raise OSError(f"{path} could not be written")


def read_text(spark: SparkSession, path: str) -> str:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.text(path, wholetext=True).first().value


def as_json(value) -> str:
    """JSON in which numbers that are none (NaN, infinite) are null."""
    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [plain(v) for v in x]
        return None if isinstance(x, float) and x - x != 0 else x

    return json.dumps(plain(value), ensure_ascii=False, sort_keys=True, default=str)


def write_report(path: str, **parts: DataFrame) -> None:
    """A JSON report of result tables, which are small: each part as a list of objects."""
    spark = next(iter(parts.values())).sparkSession
    write_text(spark, path, as_json({name: [r.asDict(recursive=True) for r in df.collect()] for name, df in parts.items()}))


def append_entry(spark: SparkSession, folder: str, entry: dict) -> None:
    """Adds an entry with its time to an append-only folder of JSON lines, one file each; earlier files are never touched."""
    now = datetime.now(UTC)
    write_text(spark, f"{folder.rstrip('/')}/{now:%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}.json", as_json(entry | {"time": now.isoformat()}))


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """(time, digest, entry) of the entries of a ledger; broken lines are left out, an absent folder is empty."""
    schema = "time string, digest string, entry string"
    if not exists(spark, folder):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(folder).where(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"))
    return lines.select(F.get_json_object("value", "$.time").alias("time"), F.get_json_object("value", "$.digest").alias("digest"), F.col("value").alias("entry"))


def record_evaluation(spark: SparkSession, folder: str, digest: str | None, figures: dict) -> dict:
    """Adds an evaluation to a ledger and tells its number and whether other checkpoints were evaluated before; an unknown digest is no other checkpoint."""
    digest = digest or "unknown"
    before = ledger(spark, folder).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("digest").isNotNull() & ~F.col("digest").isin("unknown", digest), F.col("digest"))).alias("others")).first()
    append_entry(spark, folder, figures | {"digest": digest})
    return {"number": before.n + 1, "repeated": before.n > 0, "other_checkpoints": before.others}


class RunRecorder:
    """Records a run in a folder: environment, configuration, figures by split and events. Leaving it by an error records the error. Events never raise."""

    def __init__(self, spark: SparkSession, name: str, root: str, config: dict):
        from siltworks.sources.files import environment

        self.spark, self.folder = spark, f"{root.rstrip('/')}/{name}-{datetime.now(UTC):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:6]}"
        write_text(spark, f"{self.folder}/environment.json", as_json(environment(spark).first().asDict()))
        write_text(spark, f"{self.folder}/config.json", as_json(config))

    def __enter__(self) -> RunRecorder:
        self.event("start")
        return self

    def __exit__(self, kind, error, trace) -> bool:
        self.event("end" if error is None else "failed", **({} if error is None else {"error": repr(error), "trace": "".join(traceback.format_tb(trace))[-2000:]}))
        return False

    def event(self, kind: str, **values) -> None:
        try:
            append_entry(self.spark, f"{self.folder}/events", {"kind": kind} | values)
        except Exception as error:  # noqa: BLE001 - a record that cannot be kept does not end the run
            print(f"event {kind} not recorded: {error!r}")

    def metrics(self, split: str, figures: dict) -> None:
        """The figures of a split; entries that are no scalars are left out."""
        write_text(self.spark, f"{self.folder}/metrics_{split}.json", as_json({k: v for k, v in figures.items() if v is None or isinstance(v, (str, int, float, bool))}))


def telemetry(source: DataFrame, folder: str, checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """Appends a stream's rows to a folder of JSON lines, every ``seconds`` or, without, all there is and then ends."""
    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    return source.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).trigger(**trigger).outputMode("append").start()


def save_model(spark: SparkSession, path: str, model, state: dict | None = None) -> None:
    """Saves an ML model and a state beside their place and moves them there in one step; the earlier ones stay until then."""
    fs, p = _fs(spark, path)
    fresh = f"{path}.{uuid.uuid4().hex}.new"
    model.save(f"{fresh}/model")
    write_text(spark, f"{fresh}/state.json", as_json(state or {}))
    old = _fs(spark, f"{path}.old")[1]
    if fs.exists(p):
        fs.delete(old, True)
        fs.rename(p, old)
    if not fs.rename(_fs(spark, fresh)[1], p):
        raise OSError(f"{path} could not be written")
    fs.delete(old, True)


def load_model(spark: SparkSession, path: str, kind, parts: tuple[str, ...] = ("model", "state")) -> dict:
    """The parts asked for of a saved model; one that is absent raises. kind: the model's class."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    out = {}
    if "model" in parts:
        out["model"] = kind.load(f"{path}/model")
    if "state" in parts:
        out["state"] = json.loads(read_text(spark, f"{path}/state.json"))
    return out


def save_evaluation(path: str, metrics: DataFrame, predictions: DataFrame | None = None, digest: str | None = None) -> dict:
    """An evaluation in a folder: its metrics as a report, the rows' predictions, if given, as Parquet, and an entry in the ledger beside; what the ledger tells is given back."""
    spark = metrics.sparkSession
    write_report(f"{path}/report.json", metrics=metrics)
    if predictions is not None:
        predictions.write.mode("overwrite").parquet(f"{path}/predictions")
    return record_evaluation(spark, f"{path}/ledger", digest, {"metrics": [r.asDict() for r in metrics.collect()]})
