"""Write the fixture logs out as real rolled files, in parallel tasks.

``<shared>/fixture_logs/<sf>/<app>/<file_name>``: names ending in ``.gz``
are written gzip-compressed (fixed mtime, so reruns give identical bytes) and
flushed now and then, as by a program that logs through a gzip stream, the rest plain.  Each task writes through a temporary name and renames, so a
retried task leaves whole files only.  The folder lives below the cluster's
shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rollscope.session import data_key, shared_dir
from rollscope.sources import fixtures as fx
from rollscope.sources.files import arrow_location

_DONE = "_SUCCESS"
FLUSH_BYTES = 512  # written between two flushes


def _writer(home: str):
    flush_bytes = FLUSH_BYTES

    def run(batches):
        import gzip
        import io
        import os

        import pandas as pd
        from pyarrow import fs as pafs

        if home.startswith("file:"):
            fs, root = pafs.LocalFileSystem(), "/" + home[len("file:"):].lstrip("/")
        elif "://" not in home:
            fs, root = pafs.LocalFileSystem(), home
        else:
            fs, root = pafs.FileSystem.from_uri(home)
        made = set()
        for pdf in batches:
            n = 0
            for app, name, content in zip(pdf["app"], pdf["file_name"], pdf["content"]):
                d = f"{root}/{app}"
                if d not in made:
                    fs.create_dir(d, recursive=True)
                    made.add(d)
                data = bytes(content)
                if name.endswith(".gz"):
                    stored = io.BytesIO()
                    with gzip.GzipFile(fileobj=stored, mode="wb", mtime=0) as gz:
                        for i in range(0, len(data), flush_bytes):
                            gz.write(data[i:i + flush_bytes])
                            gz.flush()
                    data = stored.getvalue()
                tmp = f"{d}/.{name}.{os.getpid()}.tmp"
                with fs.open_output_stream(tmp) as out:
                    out.write(data)
                fs.move(tmp, f"{d}/{name}")
                n += 1
            yield pd.DataFrame({"written": [n]})
    return run


def materialize_logs(spark: SparkSession, sf_dir: str) -> str:
    """Stage the fixture logs of ``sf_dir`` as files once per shared folder; returns the home."""
    home = f"{shared_dir(spark)}/fixture_logs/{data_key(sf_dir)}"
    fs, root = arrow_location(home)
    if fs.get_file_info(f"{root}/{_DONE}").type.name != "NotFound":
        return home
    files = fx.log_files(spark, sf_dir).select("app", "file_name", "content")
    # each file is written on its own: no repartition, so no task holds a hot application
    written = (files.mapInPandas(_writer(home), "written long")
               .agg(F.sum("written")).collect()[0][0])
    with fs.open_output_stream(f"{root}/{_DONE}") as out:
        out.write(str(written or 0).encode())
    return home
