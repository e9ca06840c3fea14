"""Getting the package to executors that don't have it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the session's executors this package, once for each application.

    Python workers import the operators' modules; where executors have no copy on their path, they
    get one as a zip from the driver.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="folio-code-")  # the driver's own; executors fetch the archive from it
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / f"{_PACKAGE.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(_PACKAGE.rglob("*.py")):
            z.write(source, str(source.relative_to(_PACKAGE.parent)))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
