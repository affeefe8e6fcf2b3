"""Send this package to the executors through Spark's own file server."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Once per application: make ``tessera`` importable in every Python worker."""
    application = spark.sparkContext.applicationId
    if application not in _sent:
        package = Path(__file__).parent
        target = Path(tempfile.mkdtemp(prefix="tessera-")) / "tessera_package.zip"
        with zipfile.ZipFile(target, "w") as bundle:
            for file in sorted(package.rglob("*.py")):
                bundle.write(file, Path("tessera") / file.relative_to(package))
        spark.sparkContext.addPyFile(str(target))
        _sent.add(application)
    return spark
