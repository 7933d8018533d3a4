"""Digests of files that no task holds."""

import gzip
import hashlib

import numpy as np
import pytest

from dyadlab.sources import files as D

MARK = b"\xef\xbb\xbf"


@pytest.mark.parametrize("split", [None, 4096])
def test_files_are_digested_in_pieces(spark, tmp_path, split):
    """a file was one row, held by its task several times over, and none above the limit of such rows could be read."""
    r = np.random.default_rng(3)
    noise = r.integers(0, 256, 100_000).astype(np.uint8).tobytes()
    given = {
        "none.txt": b"abc", "end.txt": b"abc\n", "ends.bin": b"\n" * 9000, "crlf.txt": b"a\r\nb\r\n\r\n", "mark.txt": MARK, "marked.txt": MARK + b"a\nb", "marked2.txt": MARK + b"\n",
        "twice.txt": MARK + MARK + b"x\n", "three.bin": b"\n\n\n", "noise.bin": noise, "noise2.BIN": noise + b"\n", "sub/with space%20é.bin": noise[:5000], "one line.bin": b"x" * 60_000, "bad.txt": b"\xff\xfe\x00\x80", "zeros.bin": bytes(20_000),
        "marked long.bin": MARK + noise, "packed.txt.gz": gzip.compress(b"lines\n" * 20), "not packed.gz": b"no gzip\n",
    }
    (tmp_path / "sub").mkdir()
    for name, content in given.items():
        (tmp_path / name).write_bytes(content)
    # rows that hold a whole file are limited as rows of 2 GB are
    settings = {"spark.sql.sources.binaryFile.maxLength": "1000", "spark.sql.files.maxPartitionBytes": str(split or 1 << 27), "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = {x["relative_path"]: (x["bytes"], x["sha256"]) for x in D.file_digests(spark, str(tmp_path)).collect()}
        some = {x["relative_path"] for x in D.file_digests(spark, str(tmp_path), [".bin"]).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {name: (len(content), hashlib.sha256(content).hexdigest()) for name, content in given.items()}
    assert some == {name for name in given if name.lower().endswith(".bin")}
