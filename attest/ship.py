"""Makes this package importable on the executors."""

import io
import os
import tempfile
import zipfile
from pathlib import Path

_SHIPPED: set[str] = set()


def ship(spark) -> None:
    """Sends the package's sources to the executors, once per application.

    Spark serves the archive from the driver, so no folder has to be shared.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        for path in sorted([*root.rglob("*.py"), *root.rglob("*.json")]):
            archive.write(path, f"{root.name}/{path.relative_to(root)}")
    target = os.path.join(tempfile.mkdtemp(), f"{root.name}_src.zip")
    Path(target).write_bytes(held.getvalue())
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)
