"""Every query of the subpackage on empty tables, on null, empty and repeated rows, and with columns named like its own."""

from __future__ import annotations

import __spark_entry__
import pytest
from pyspark.sql import functions as F

NAMES = sorted(n for n in __spark_entry__.queries() if n == "pipeline" or n.startswith("op") and n[2:].split("_")[0].isdigit())
TABLES = ("documents", "pages", "benchmark", "labels", "embeddings")
#: Columns that operators add on their way; here the input has them, of another type.
CLASHING = "a b n key node part copy size taken target epochs rest word words hash hashes root rep kept keep component_id n_shingles sketch score host path rule verdict found src dst rank seed trust distrust spans s l at weight level quality held_out lang_pred n_chars_ fingerprint tree pos start end text_ k d i j may forest vector books code error counts failed base_failed judged row gain range ahead h".split()
PER_ROW = {"op2": "documents", "op3": "pages", "op4": "documents", "op5": "documents", "op6": "documents", "op7": "documents", "op8": "documents", "op9": "documents", "op10": "documents", "op12": "documents", "op13": "documents"}


def rows(df):
    return sorted(repr(sorted((k, float(f"{v:.9g}") if isinstance(v, float) else v) for k, v in r.asDict(True).items())) for r in df.collect())


@pytest.fixture(scope="module")
def folders(spark, small, tmp_path_factory):
    """empty: no rows; odd: few rows, with nulls in every column, empty texts and repeats; clash: odd, with more columns."""
    out = {k: str(tmp_path_factory.mktemp(k)) for k in ("empty", "odd", "clash")}
    for name in TABLES:
        df = spark.read.parquet(f"{small}/{name}.parquet")
        first = df.columns[0]
        few = df.orderBy(first).limit(60 if name != "benchmark" else 20)
        nulls = [few.limit(1).withColumn(c, F.lit(None).cast(t)).withColumn(first, F.lit(10**6 + i).cast(dict(df.dtypes)[first])) for i, (c, t) in enumerate(df.dtypes) if c != first]
        texts = [c for c, t in df.dtypes if t == "string"]
        nothing = few.limit(1).select(*(F.lit("").alias(c) if c in texts else F.lit(10**6 + 50).cast(t).alias(c) if c == first else F.col(c) for c, t in df.dtypes))
        odd = few
        for more in (*nulls, nothing, few.orderBy(first).limit(3)):
            odd = odd.unionByName(more)
        odd = spark.createDataFrame(odd.collect(), df.schema)
        df.where("false").write.parquet(f"{out['empty']}/{name}.parquet")
        odd.write.parquet(f"{out['odd']}/{name}.parquet")
        odd.select("*", *(F.array(F.lit(c)).alias(c) for c in CLASHING if c not in odd.columns), F.create_map(F.lit("m"), F.lit(1)).alias("a_map")).write.parquet(f"{out['clash']}/{name}.parquet")
    return out


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, folders, name):
    assert __spark_entry__.queries()[name](spark, folders["empty"]).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_and_clashing_columns(spark, folders, name):
    query = __spark_entry__.queries()[name]
    plain = query(spark, folders["odd"])
    clash = query(spark, folders["clash"]).select(*plain.columns)
    if name == "pipeline":  # its rows keep the columns of the input; the mix's own are left out where the input has them
        mine = [c for c in ("doc_id", "text", "lang", "source", "n_chars")]
        plain, clash = plain.select(*mine), clash.select(*mine)
    got = rows(plain)
    assert got == rows(clash)
    table = PER_ROW.get(name.split("_")[0])
    if table:
        assert len(got) >= spark.read.parquet(f"{folders['odd']}/{table}.parquet").distinct().count()
