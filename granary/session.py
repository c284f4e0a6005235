"""Session factory and connection settings."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def session(master: str | None = None, app: str = "granary", **conf: str) -> SparkSession:
    """A session with the settings the queries rely on: UTC and adaptive execution."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application that driver and executors share: below the one that
    ``spark.checkpoint.dir`` names. Where none is set, a folder of this machine, which
    does only if the session runs in one process; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(root or '/tmp/checkpoints').rstrip('/')}/granary-{spark.sparkContext.applicationId}"


def jdbc_options(env: Mapping[str, str] = os.environ, host: str = "localhost:5432") -> dict[str, str]:
    """JDBC reader and writer options from DATABASE_URL, or from its parts; an error if neither is set."""
    if url := env.get("DATABASE_URL"):
        scheme, _, rest = url.partition("://")
        login, at, place = rest.rpartition("@")
        user, _, password = login.partition(":")
        return {"url": f"jdbc:{scheme.partition('+')[0]}://{place}"} | ({"user": user, "password": password} if at else {})
    parts = [env.get(f"POSTGRES_{p}") for p in ("USER", "PASSWORD", "DB")]
    if not all(parts):
        raise ValueError("no database: set DATABASE_URL, or POSTGRES_USER, POSTGRES_PASSWORD and POSTGRES_DB")
    return {"url": f"jdbc:postgresql://{host}/{parts[2]}", "user": parts[0], "password": parts[1]}


def shipped(spark: SparkSession) -> SparkSession:
    """The session, after sending this package to its Python workers if they would not find it otherwise."""
    there = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p} | {os.getcwd()}
    context = spark.sparkContext
    if str(ROOT) not in there and not getattr(context, "granary_shipped", False):
        folder = tempfile.mkdtemp()
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.addPyFile(shutil.make_archive(f"{folder}/granary-{context.applicationId}", "zip", ROOT, "granary"))
        context.granary_shipped = True
    return spark
