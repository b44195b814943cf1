"""Archives read member by member against the standard module."""

import hashlib
import random
import zipfile

import pytest

from veridex.sources import archives as Z
from veridex.sources import readers


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(4)
    bodies = {}
    for k in range(3):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w", zipfile.ZIP_DEFLATED if k else zipfile.ZIP_STORED) as z:
            z.mkdir("docs")
            for m in range(25):
                body = rng.randbytes(rng.choice([0, 1, 5_000])) * rng.choice([1, 3])
                bodies[f"{k}.zip", f"docs/é {m}.bin"] = body
                z.writestr(f"docs/é {m}.bin", body)
            for name in ("/abs.txt", "../up.txt", "a/../../b.txt", "C:\\x.txt", "a\\..\\b.txt"):
                z.writestr(name, "no")
    with zipfile.ZipFile(tmp_path / "empty.zip", "w"):
        pass
    (tmp_path / "broken.zip").write_bytes(b"PK no archive")
    return tmp_path, bodies


def test_members_and_hashes(spark, folder):
    path, bodies = folder
    got = Z.zip_hashes(Z.zip_members(spark, str(path))).collect()
    short = lambda r: (r.archive.rsplit("/", 1)[1], r.name)
    assert {short(r): r.sha256 for r in got if r.safe} == {k: hashlib.sha256(b).hexdigest() for k, b in bodies.items()}
    assert {short(r): r.bytes for r in got if r.safe} == {k: len(b) for k, b in bodies.items()}
    assert sum(not r.safe and r.sha256 is None and r.error is None for r in got) == 15 and all(not r.safe for r in got if r.name and "docs" not in r.name)
    assert [(short(r), r.error[:10]) for r in got if r.error] == [(("broken.zip", None), "BadZipFile")]


def test_pieces_of_long_members_and_of_many_tasks(spark, tmp_path, monkeypatch):
    body = random.Random(1).randbytes(3 * Z.BUFFER + 17)
    with zipfile.ZipFile(tmp_path / "long.zip", "w") as z:
        z.writestr("long", body)
        z.writestr("none", b"")
    monkeypatch.setattr(Z, "PER_TASK", 1 << 20)
    pieces = Z.zip_pieces(Z.zip_members(spark, str(tmp_path)))
    assert pieces.rdd.getNumPartitions() == 4
    rows = sorted((r.at, r.piece, bytes(r.content)) for r in pieces.collect())
    assert [(p, len(c)) for _, p, c in rows] == [(0, Z.BUFFER), (1, Z.BUFFER), (2, Z.BUFFER), (3, 17), (0, 0)] and b"".join(c for _, _, c in rows) == body


def test_damaged_members_are_told(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("a", b"x" * 500)
        z.writestr("b", b"fine")
    raw = bytearray((tmp_path / "d.zip").read_bytes())
    raw[raw.index(b"xxx") + 100] ^= 1
    (tmp_path / "d.zip").write_bytes(bytes(raw))
    members = Z.zip_members(spark, str(tmp_path / "d.zip"))
    got = {r.name: (r.sha256, r.error) for r in Z.zip_hashes(members).collect()}
    assert got["b"] == (hashlib.sha256(b"fine").hexdigest(), None) and got["a"][0] is None and "CRC" in got["a"][1]
    assert sum(r.error is not None for r in Z.zip_pieces(members).collect()) == 1


def test_hash_lists(spark, tmp_path):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = [f"{sha(b'one').upper()}  one.txt", "", f"{sha(b'two')} *sub\\two.txt", f"{sha(b'x')}  three.txt", f"{sha(b'x')}  gone.txt", "nonsense", f"{sha(b'q')}  one.txt", f"{sha(b'one')}\tone.txt"]
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("rel/CHECKSUMS.sha256", "\ufeff" + "\r\n".join(lines))
        for name, body in {"rel/one.txt": b"one", "rel/sub/two.txt": b"two", "rel/three.txt": b"three", "one.txt": b"other"}.items():
            z.writestr(name, body)
    with zipfile.ZipFile(tmp_path / "none.zip", "w") as z:
        z.writestr("a", b"a")
    got = Z.verify_checksums(Z.zip_members(spark, str(tmp_path))).collect()
    assert sorted((r.name, r.state) for r in got) == [("nonsense", "malformed"), ("rel/gone.txt", "missing"), ("rel/one.txt", "matched"), ("rel/sub/two.txt", "matched"), ("rel/three.txt", "mismatch")]


def test_whole_members(spark, folder):
    path, bodies = folder
    got = readers.read_zip(spark, f"{path}/[0-9].zip").collect()
    assert {(r.archive.rsplit("/", 1)[1], r.name): bytes(r.content) for r in got if r.safe} == bodies and all(r.content is None for r in got if not r.safe)
    with pytest.raises(Exception, match="BadZipFile"):
        readers.read_zip(spark, str(path)).collect()
