"""A PySpark-native engine for reads, k-mers, overlaps, intervals and the graphs built from them."""

from __future__ import annotations

import os
import tempfile
import zipfile


def ship(spark) -> None:
    """Send this package to the executors of a session, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_braidwork_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="braidwork-"), "braidwork.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("braidwork", os.path.relpath(full, here)))
    sc.addPyFile(path)
    sc._braidwork_shipped = True
