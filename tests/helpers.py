"""Small helpers: evaluate a column expression over inline values."""

from __future__ import annotations


def evaluate(spark, values, build, names=("a", "b")):
    """Values (scalars or tuples) -> list of results of ``build(*columns)``, in input order."""
    from pyspark.sql import functions as F

    rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
    width = len(rows[0]) - 1
    schema = "i int, " + ", ".join(f"{n} string" for n in names[:width])
    df = spark.createDataFrame(rows, schema)
    out = df.select("i", build(*[F.col(n) for n in names[:width]]).alias("r")).collect()
    return [r["r"] for r in sorted(out, key=lambda r: r["i"])]
