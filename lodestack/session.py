"""Session construction and the shared folder that jobs use to cut lineage."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench. On a cluster the caller brings the session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lodestack")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is missing, a temporary folder is used, but only in local mode: on a cluster a
    machine-local folder would be invisible to the other machines, so that is an error.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        own = getattr(context, "_lodestack_shared", None)
        if own is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
            own = context._lodestack_shared = tempfile.mkdtemp(prefix="lodestack-")
        folder = own
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def own_dir(spark: SparkSession) -> str:
    """The application's own folder in the shared one; others may work in the shared folder at the same time."""
    return f"{shared_dir(spark).rstrip('/')}/lodestack-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's folder."""
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_once(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read from there: worked out once, whoever is lost."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path on whichever file system it names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def delete_unnamed(spark: SparkSession, folder: str, named: set[str], hours: float) -> int:
    """Delete what lies right below a folder, is not named and was last changed at least so many hours ago: what writers
    left who gave up. The hours must be more than any writer takes from its first file to its publishing."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(place):
        return 0
    limit = (time.time() - 3600 * hours) * 1000
    old = [x.getPath() for x in system.listStatus(place) if x.getPath().getName() not in named and x.getModificationTime() <= limit]
    for path in old:
        system.delete(path, True)
    return len(old)


def create_exclusively(spark: SparkSession, path: str, text: str) -> bool:
    """A small file with its whole text at once; False, and nothing changed, if there is one at the path already."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs
    target, draft = fs.Path(path), fs.Path(f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    system = target.getFileSystem(conf)
    system.mkdirs(target.getParent())
    out = system.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    qualified = [system.makeQualified(p) for p in (draft, target)]
    options = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    options[0] = getattr(fs.Options.Rename, "NONE")
    try:
        fs.FileContext.getFileContext(qualified[0].toUri(), conf).rename(*qualified, options)  # fails where the target exists
    except Exception:  # noqa: BLE001
        system.delete(draft, False)
        if not system.exists(target):
            raise
        return False
    return True


def clean_shared(spark: SparkSession) -> int:
    """Delete the tables and checkpoints that this application left in the shared folder, once its results have been
    written; how many there were. What other applications keep there stays."""
    jvm, context = spark.sparkContext._jvm, spark.sparkContext
    own = own_dir(spark)
    gone = 0
    # Spark puts an application's checkpoints into a folder of its own below the setting's.
    for folder, prefix in ((own, ""), (context.getCheckpointDir(), "rdd-")):
        place = jvm.org.apache.hadoop.fs.Path(folder)
        system = place.getFileSystem(context._jsc.hadoopConfiguration())
        if system.exists(place):
            for status in system.listStatus(place):
                if status.getPath().getName().startswith(prefix):
                    system.delete(status.getPath(), True)
                    gone += 1
    return gone


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable eager checkpoint in the shared folder; survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
