"""Make the package importable on executors (Arrow UDFs pickle by module).

``ensure_shipped(spark)`` zips the installed ``lignum`` package once per
SparkContext and registers it with ``addPyFile``, which is how a cluster's
Python workers receive it.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

_SHIPPED: set[str] = set()


def ensure_shipped(spark) -> None:
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="lignum-pkg-"), "lignum.zip")
    with zipfile.ZipFile(out, "w") as z:
        for dp, _dn, fns in os.walk(root):
            for fn in fns:
                if fn.endswith(".py"):
                    full = os.path.join(dp, fn)
                    z.write(full, os.path.join("lignum", os.path.relpath(full, root)))
    sc.addPyFile(out)
    _SHIPPED.add(key)
