import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from tarn.sources import container, crypt
from tests.packages import FOUR_X, GAME, STANDARD, table

ONE = {"a/b.js": b"x" * 10}


def by_pkg(df, column):
    return {r["pkg_id"]: r[column] for r in df.collect()}


def raw(entries, body=b"0123456789", index_extra=b"", body_length=None):
    index = struct.pack(">I", len(entries)) + b"".join(struct.pack(">I", len(n)) + n + struct.pack(">II", o, s) for n, o, s in entries) + index_extra
    return struct.pack(">BIIIB", 0xBE, 0, len(index), len(body) if body_length is None else body_length, 0xED) + index + body


def start(*names):
    return 14 + 4 + sum(12 + len(n) for n in names)


def test_round_trip(spark):
    df = table(spark, std=STANDARD, empty={})
    entries = container.scan(df)
    got = {(r["pkg_id"], r["path"]): bytes(r["content"]) for r in container.extract(df, entries).collect()}
    assert got == {("std", k): v for k, v in STANDARD.items()}
    again = container.encode_table(container.extract(df, entries))
    assert [bytes(r["content"]) for r in again.collect()] == [container.encode(STANDARD)]
    kinds = {r["path"]: (r["kind"], r["ext"], r["sha256"]) for r in container.files(container.extract(df, entries)).collect()}
    assert kinds["app.json"] == ("asset", "json", hashlib.sha256(STANDARD["app.json"]).hexdigest())


def test_folder_source(spark, tmp_path):
    (tmp_path / "one.pkg").write_bytes(container.encode(ONE))
    rows = container.scan(container.packages(spark, str(tmp_path))).collect()
    assert [(r["pkg_id"], r["name"], r["size"]) for r in rows] == [("one.pkg", "a/b.js", 10)]


def test_bad_headers(spark):
    good = container.encode(ONE)
    df = table(spark, ok=good, short=b"broken", first=b"\0" + good[1:], last=good[:13] + b"\0" + good[14:], enc=b"V1MMWX" + b"x" * 40, length=good[:5] + struct.pack(">I", 3) + good[9:], out=good[:9] + struct.pack(">I", 1 << 31) + good[13:], trailing=good + b"zz")
    assert by_pkg(container.header(df), "header_error") == {"ok": None, "short": "file too small", "first": "bad first marker", "last": "bad last marker", "enc": "encrypted", "length": "bad index length", "out": "sections out of bounds", "trailing": None}
    modes = by_pkg(df.withColumn("m", container.encryption_mode(F.col("content"))), "m")
    assert modes["ok"] == "plain" and modes["enc"] == "encrypted" and modes["short"] == "unknown"
    assert by_pkg(container.scan(df).groupBy("pkg_id").agg(F.first("error").alias("e")), "e")["short"] == "file too small"


MALFORMED = {
    "count": (struct.pack(">BIIIB", 0xBE, 0, 4, 0, 0xED) + struct.pack(">I", 200_000), "too many files"),
    "amplify": (struct.pack(">BIIIB", 0xBE, 0, 4, 0, 0xED) + struct.pack(">I", 9), "bad file count"),
    "name": (raw([(b"", 0, 0)]), "bad name length"),
    "bounds": (raw([(b"a", 4_000_000_000, 4_000_000_000)]), "file out of bounds"),
    "cut": (raw([(b"abcdefghijkl", 0, 0)])[:14] + struct.pack(">II", 1, 500) + b"x" * 30, "entry exceeds index"),
}


@pytest.mark.parametrize("case", MALFORMED)
def test_malformed_index(case):
    data, want = MALFORMED[case]
    assert container.read_index(data)[1] == want


def test_strict_mode_refuses_more():
    cases = {
        "declared size differs": raw([(b"a", start(b"a"), 3)]) + b"zz", "offset outside body": raw([(b"a", 0, 3)]), "duplicate name": raw([(b"a", start(b"a", b"a"), 3)] * 2),
        "NUL in name": raw([(b"a\0", start(b"aa"), 3)]), "name is not UTF-8": raw([(b"\xff", start(b"a"), 3)]), "trailing index bytes": raw([(b"a", start(b"a") + 2, 3)], index_extra=b"zz"),
    }
    for want, data in cases.items():
        assert container.read_index(data)[1] is None
        assert container.read_index(data, strict=True)[1] == want


def test_duplicates_aliases_and_unsafe_paths(spark):
    s2, s3 = start(b"a", b"a"), start(b"app-service.js", b"x/appservice.js")
    packs = {
        "same": raw([(b"a", s2, 3), (b"/a", s2 - 1 + 1, 3)][:1] + [(b"a", s2, 3)]),
        "differ": raw([(b"a", s2, 3), (b"a", s2 + 1, 3)]),
        "unsafe": raw([(b"../a", start(b"../a"), 3)]),
        "alias": raw([(b"app-service.js", s3, 10), (b"x/appservice.js", s3 + 2, 8)]),
        "twice": raw([(b"app.js", start(b"app.js", b"b.js") , 10), (b"b.js", start(b"app.js", b"b.js"), 10)], body=b"0123456789"),
    }
    df = table(spark, **packs)
    out = container.extract(df, container.scan(df))
    assert {(r["pkg_id"], r["ord"]): r["action"] for r in out.collect()}[("same", 1)] == "skip"
    errors = by_pkg(out.groupBy("pkg_id").agg(F.max("error").alias("e")), "e")
    assert errors == {"same": None, "differ": "divergent duplicate", "unsafe": "unsafe path", "alias": None, "twice": None}
    assert {r["action"] for r in out.where("pkg_id = 'alias'").collect()} == {"write", "alias"}
    assert set(by_pkg(container.files(out), "path")) == {"same", "alias", "twice"}


def test_amplification(spark):
    names = [f"f{i}".encode() for i in range(9)]
    df = table(spark, big=raw([(n, start(*names), 100) for n in names], body=b"y" * 100))
    assert set(by_pkg(container.extract(df, container.scan(df)), "error").values()) == {"extracted size exceeds package"}


def test_profile(spark):
    df = table(spark, std=STANDARD, four=FOUR_X, game=GAME, sub={"x/__APP__/a.js": b""}, enc=b"V1MMWX" + b"\0" * 2000, junk=b"broken")
    found = container.extract(df, container.scan(df))
    rows = {r["pkg_id"]: r for r in container.profile(df, found).collect()}
    assert {k: r["variant"] for k, r in rows.items()} == {"std": "standard", "four": "wechat4x", "game": "game", "sub": "subpackage", "enc": "encrypted", "junk": "unknown"}
    assert rows["std"]["index_file_count"] == 5 and rows["junk"]["index_file_count"] == 0 and rows["enc"]["needs_key_id"] and not rows["junk"]["supports_native"]


def test_block_cipher_vector(spark):
    key, plain = bytes(range(32)), bytes.fromhex("00112233445566778899aabbccddeeff")
    row = [tuple(map(bytearray, (bytes.fromhex("8ea2b7ca516745bfeafc49904b496089"), key, bytes(16))))]
    got = spark.createDataFrame(row, "blocks binary, key binary, vector binary").select(crypt.deciphered(F.col("blocks"), F.col("key"), F.col("vector")).alias("p")).first()["p"]
    assert bytes(got) == plain


def encrypted(spark, plain, key_id):
    """The cipher text by Spark's own AES: 1023 bytes and one of padding fill the 1024."""
    key = hashlib.pbkdf2_hmac("sha1", key_id.encode(), crypt.SALT, crypt.ROUNDS, 32)
    e = spark.createDataFrame([(bytearray(plain[:1023]), bytearray(key), bytearray(crypt.VECTOR))], "p binary, k binary, v binary").select(F.aes_encrypt("p", "k", F.lit("CBC"), F.lit("PKCS"), "v").alias("e")).first()["e"]
    return b"V1MMWX" + bytes(e)[16:] + bytes(b ^ ord(key_id[-2]) for b in plain[1023:])


def test_decrypt(spark):
    key_id = "wx0123456789abcdef"
    plain = container.encode({"a.js": b"q" * 3000, "app.json": b"{}"})
    data = encrypted(spark, plain, key_id)
    rows = [("ok", data, key_id), ("wrong", data, "wx0123456789abcdee"), ("none", data, None), ("bad", data, "wx1"), ("plain", plain, "nonsense"), ("small", b"V1MMWX" + b"x" * 20, key_id), ("junk", b"junk", key_id)]
    got = crypt.decrypted(spark.createDataFrame([(i, bytearray(d), k) for i, d, k in rows], "pkg_id string, content binary, key_id string"))
    assert "key_id" not in got.columns
    by = {r["pkg_id"]: r for r in got.collect()}
    assert bytes(by["ok"]["content"]) == plain and bytes(by["plain"]["content"]) == plain
    assert by["wrong"]["error"] is None and by["wrong"]["content"][0] != 0xBE
    assert [by[k]["error"] for k in ("none", "bad", "small", "junk")] == ["needs a key id", "bad key id", "too small", "bad header"]
