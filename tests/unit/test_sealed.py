import glob
import os
import shutil

import pytest

from tidewell.operators.segments import SegmentFamily
from tidewell.sources.sealed import Broken, check, read_sealed, seal


def no_sums(folder):
    """Without the local file system's own checksums, which other file systems don't have."""
    for f in glob.glob(f"{folder}/**/.*.crc", recursive=True, include_hidden=True):
        os.remove(f)


def test_changed_missing_added_and_wrong_key(spark, tmp_path):
    table, target, key = f"file://{tmp_path}/t", f"file://{tmp_path}/s", b"kbys"
    spark.range(100).repartition(3).write.parquet(table)
    seal(spark, table, target, key)
    assert read_sealed(spark, table, target, key).count() == 100
    with pytest.raises(Broken):
        check(spark, table, target, b"other")
    no_sums(tmp_path)
    files = sorted(glob.glob(f"{tmp_path}/t/*.parquet"))
    whole = open(files[0], "rb").read()
    for change in (lambda: open(files[0], "wb").write(whole[:-1] + bytes([whole[-1] ^ 1])), lambda: open(files[0], "wb").write(whole + b"x"), lambda: os.remove(files[0]), lambda: shutil.copy(files[1], f"{tmp_path}/t/more.parquet")):
        change()
        with pytest.raises(Broken, match="differ"):
            check(spark, table, target, key)
        open(files[0], "wb").write(whole)
        if os.path.exists(f"{tmp_path}/t/more.parquet"):
            os.remove(f"{tmp_path}/t/more.parquet")
    check(spark, table, target, key)
    lines = spark.read.parquet(target)
    lines.where(f"file <> '{os.path.basename(files[0])}'").write.parquet(f"file://{tmp_path}/less")
    os.remove(files[0])
    with pytest.raises(Broken, match="whole"):
        check(spark, table, f"file://{tmp_path}/less", key)


def test_segments_are_sealed(spark, tmp_path):
    family = SegmentFamily.create(spark, f"file://{tmp_path}/f", "doc_id", "text", key=b"k")
    for batch in ([(1, "the w1"), (2, "w2"), (3, "w3"), (4, "w4")], [(2, "the")]):
        family.add(spark.createDataFrame(batch, "doc_id long, text string"))
    assert len(family.segments) == 2
    family.check()
    again = SegmentFamily.open(spark, family.path, key=b"k")
    again.check()
    with pytest.raises(Broken):
        SegmentFamily.open(spark, family.path, key=b"x").check()
    no_sums(tmp_path)
    one = glob.glob(f"{tmp_path}/f/segments/*/postings/*.parquet")[0]
    open(one, "ab").write(b"x")
    with pytest.raises(Broken):
        again.check()
    with pytest.raises(ValueError, match="key"):
        SegmentFamily.open(spark, family.path).check()
