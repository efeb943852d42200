from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

HOTSPOT_METHOD_BYTES = "8000"
MIN_PARTITION = "64KB"


_SHIPPED: set[str] = set()


def shipped(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application.

    Functions that run in tasks are pickled by reference to it, so workers must be able to import it
    wherever the driver was started. An installed wheel comes first on their path and does as well.
    """
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp(prefix="probewise-")) / "probewise.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent))
        context.addPyFile(str(archive))
        _SHIPPED.add(context.applicationId)
    return spark


def tuned(spark: SparkSession) -> SparkSession:
    """Ship the package, and set two runtime options that every probing job wants.

    A scorer with many terms can push a fused stage past the size HotSpot will compile, and
    such a stage then runs interpreted (25 times slower here); at HotSpot's own limit Spark
    falls back to per-operator code, which is split into small methods.

    Probing explodes narrow rows hundreds of times, so the work of a partition is far above
    its bytes. Adaptive coalescing may therefore not merge partitions up to its 1 MB default
    when that leaves cores idle.
    """
    shipped(spark)
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", HOTSPOT_METHOD_BYTES)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", MIN_PARTITION)
    return spark
