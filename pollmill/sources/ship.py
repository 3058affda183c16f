"""The package on the executors: Python workers import it from an archive that the session hands out."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from .scratch import shared_dir

_SHIPPED: set[str] = set()


def package_bytes(root: Path) -> bytes:
    """The package's modules as a zip that Python can import from."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent).as_posix())
    return out.getvalue()


def ship(spark: SparkSession) -> None:
    """Once an application: workers started on any host find the package, also where it is not installed."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    from pyarrow import fs
    path = f"{shared_dir(spark)}/pollmill-{uuid.uuid4().hex}.zip"
    system, place = fs.FileSystem.from_uri(path)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(place, compression=None) as out:
        out.write(package_bytes(Path(__file__).resolve().parents[1]))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
