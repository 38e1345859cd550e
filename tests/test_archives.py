"""Archives written by the library and by tarfile, whole, cut off, plain and in many gzip members."""

import gzip
import hashlib
import io
import tarfile

import pytest
from pyspark.sql import functions as F

from verisift.sources.archives import archive_index, parts_of, read_archives, write_archives

SF = "/root/testdata/sf0.001"


def packed(names, mode="w:gz", form=tarfile.PAX_FORMAT):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode, format=form) as tar:
        folder = tarfile.TarInfo("folder")
        folder.type = tarfile.DIRTYPE
        tar.addfile(folder)
        for name, content in names.items():
            info = tarfile.TarInfo(name)
            info.size, info.mtime = len(content), 1_600_000_000
            tar.addfile(info, io.BytesIO(content))
        link = tarfile.TarInfo("link")
        link.type, link.linkname = tarfile.SYMTYPE, "a"
        tar.addfile(link)
    return out.getvalue()


FILES = {"a": b"one", "empty": b"", "folder/" + "long" * 60: b"x" * 700, "ünï": bytes(range(256)) * 20, "last": b"z" * 512}


@pytest.mark.parametrize("mode, form", [("w:gz", tarfile.PAX_FORMAT), ("w:gz", tarfile.GNU_FORMAT), ("w", tarfile.PAX_FORMAT), ("w", tarfile.GNU_FORMAT)])
def test_archives_of_others(spark, tmp_path, mode, form):
    (tmp_path / "x.tar").write_bytes(packed(FILES, mode, form))
    rows = read_archives(spark, [str(tmp_path / "x.tar")], least=600).collect()
    assert sorted((r["path"], bytes(r["content"])) for r in rows) == sorted(FILES.items()) and {r["modified"].timestamp() for r in rows} == {1_600_000_000}
    assert len(parts_of(str(tmp_path / "x.tar"), 600)) == (1 if mode == "w:gz" else 3)


def test_pages_packed_and_back(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    done = write_archives(pages.repartition(3), f"file://{tmp_path}/out", least=20_000)
    index = archive_index(done, least=20_000)
    parts = index.collect()
    assert sum(r["files"] for r in parts) == pages.count() == done.agg(F.sum("files")).first()[0] and len(parts) > 3 * 2
    digest = lambda df: sorted((r["path"], hashlib.md5(bytes(r["content"] or b"")).hexdigest()) for r in df.collect())
    assert digest(read_archives(spark, [r["archive"] for r in done.collect()], least=20_000)) == digest(pages)
    for p in (tmp_path / "out").glob("*.tar.gz"):
        with tarfile.open(p) as tar:  # others can read them
            assert all(m.isreg() for m in tar)


def test_gzip_members_that_are_no_places_to_begin(spark, tmp_path):
    """Members of a stream may be cut anywhere, inside a header or a file."""
    plain = packed(FILES, "w")
    for size in (100, 512, 1024, 1536):
        (tmp_path / "x.tgz").write_bytes(b"".join(gzip.compress(plain[i : i + size]) for i in range(0, len(plain), size)))
        rows = read_archives(spark, [str(tmp_path / "x.tgz")], least=1).collect()
        assert sorted((r["path"], bytes(r["content"])) for r in rows) == sorted(FILES.items()), size


def test_bad_archives_and_limits(spark, tmp_path):
    whole = packed({"a": hashlib.sha256(b"1").digest() * 3000})
    (tmp_path / "cut.tar.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "text.tar").write_bytes(b"not an archive" * 100)
    (tmp_path / "ok.tar.gz").write_bytes(packed(FILES))
    (tmp_path / "none.tar.gz").write_bytes(packed({}))
    paths = [str(tmp_path / n) for n in ("cut.tar.gz", "text.tar", "ok.tar.gz", "none.tar.gz", "absent.tar")]
    index = archive_index(spark.createDataFrame([(p, 1) for p in [*paths, paths[2], None]], "`a.b` string, archive int"), "a.b")
    rows = {r["archive"].rpartition("/")[2]: r for r in index.collect()}
    assert {n for n, r in rows.items() if r["error"]} == {"cut.tar.gz", "text.tar", "absent.tar"} and rows["ok.tar.gz"]["files"] == 5 and len(rows) == 4
    got = {r["path"]: r["content"] for r in read_archives(spark, paths, most_bytes=600).collect()}
    assert got.keys() == FILES.keys() and {n for n, c in got.items() if c is None} == {n for n, c in FILES.items() if len(c) > 600}
    assert write_archives(spark.createDataFrame([], "path string, content binary"), str(tmp_path / "e")).agg(F.sum("files")).first()[0] in (0, None)
    with pytest.raises(Exception, match="needs a path"):
        write_archives(spark.createDataFrame([(None, b"x")], "path string, content binary"), str(tmp_path / "f"))
