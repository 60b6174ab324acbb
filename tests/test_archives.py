"""Archives read entry by entry: limits, names that lead out, and both packings."""

import io
import random
import tarfile
import zipfile

import pytest

from patchloom.sources import archives


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        for name, content in entries:
            target.writestr(name, content)
    return out.getvalue()


def tarred(entries, mode="w:gz"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as target:
        for name, content in entries:
            info = tarfile.TarInfo(name)
            info.size = len(content)
            target.addfile(info, io.BytesIO(content))
        link = tarfile.TarInfo(f"{entries[0][0].partition('/')[0]}/link")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        target.addfile(link)
    return out.getvalue()


FILES = [("r/", b""), ("r/a.txt", b"one"), ("r/b/c.py", b"x" * 50), ("r/empty", b""), ("r/big", b"y" * 5000)]


@pytest.mark.parametrize("raw", [zipped(FILES), tarred(FILES[1:]), tarred(FILES[1:], "w")])
def test_entries(raw):
    got = list(archives.entries_of(raw, most_entry_bytes=100))
    assert sorted(got) == sorted([("a.txt", 3, "kept", b"one"), ("b/c.py", 50, "kept", b"x" * 50), ("empty", 0, "kept", b""), ("big", 101, "too_large", None)])
    dealt = [x for share in range(3) for x in archives.entries_of(raw, share, 3, most_entry_bytes=100)]
    assert sorted(dealt) == sorted(got)


@pytest.mark.parametrize("name", ["../x", "r/../../x", "/etc/x", "r\\x", "C:/x", "r/a/../b", " "])
def test_unsafe_names_refuse_the_archive(name):
    assert archives.is_unsafe(name)
    with pytest.raises(archives.ArchiveError, match="unsafe"):
        list(archives.entries_of(zipped([("r/ok", b"1"), (name, b"2")])))


def test_limits():
    many = zipped([(f"r/{k}", b"abc") for k in range(20)])
    for limit, why in (({"most_entries": 19}, "entries"), ({"most_bytes": 59}, "bytes")):
        with pytest.raises(archives.ArchiveError, match=why):
            list(archives.entries_of(many, **limit))
    assert len(list(archives.entries_of(many, most_entries=20, most_bytes=60))) == 20
    for raw, why in ((zipped([("r/a", b""), ("s/b", b"")]), "root"), (zipped([]), "no entries"), (b"nothing", "read"), (many[:-40], "read"), (tarred(FILES)[:60], "read")):
        with pytest.raises(archives.ArchiveError, match=why):
            list(archives.entries_of(raw))
    bomb = zipped([("r/zeros", b"\0" * 20_000_000)])
    assert len(bomb) < 50_000 and list(archives.entries_of(bomb, most_entry_bytes=1000)) == [("zeros", 1001, "too_large", None)]


def test_stored_archives(spark, tmp_path):
    rnd = random.Random(1)
    want = []
    for k in range(6):
        files = [(f"repo-{k}/src/f{n}.txt", bytes(rnd.randrange(256) for _ in range(rnd.randrange(200)))) for n in range(9)]
        (tmp_path / f"{k}.{'zip' if k % 2 else 'tgz'}").write_bytes(zipped(files) if k % 2 else tarred(files))
        want += [(f"{k}.{'zip' if k % 2 else 'tgz'}", n.split("/", 1)[1], len(c), "kept", c) for n, c in files]
    (tmp_path / "bad.zip").write_bytes(zipped([("r/a", b"fine"), ("r/../../b", b"no")]))
    (tmp_path / "note.md").write_text("no archive")
    rows = archives.stored_archives(spark, str(tmp_path), "*.{zip,tgz}")
    for shares in (1, 3):
        got = archives.archive_entries(rows, shares, strict=False).collect()
        fields = ("archive", "path", "n_bytes", "status", "content")
        assert sorted((r.archive, r.path, r.n_bytes, r.status, bytes(r.content)) for r in got if r.path is not None) == sorted(want)
        assert [(r.archive, r.status[:8]) for r in got if r.path is None] == [("bad.zip", "refused:")] and set(got[0].asDict()) == set(fields)
    with pytest.raises(Exception, match="unsafe path"):
        archives.archive_entries(rows).count()
    none = spark.createDataFrame([("n", None)], "archive string, content binary")
    assert [r.status for r in archives.archive_entries(none, strict=False).collect()] == ["refused: missing or too large"]
    assert archives.archive_entries(none.filter("false")).count() == 0


def test_packed_archives_come_back(spark):
    files = spark.createDataFrame([("k", "a/b", b"1"), ("k", "a/c", None), ("l", "é", b"\0\xff")], "archive string, path string, content binary")
    got = archives.archive_entries(archives.packed(files, ["archive"])).collect()
    assert sorted((r.archive, r.path, bytes(r.content)) for r in got) == [("k", "a/b", b"1"), ("k", "a/c", b""), ("l", "é", b"\0\xff")]
