"""Codecs, scalar functions, readers and writers."""

from __future__ import annotations

import hashlib
import io
import random
import tarfile
import time
import zlib

import pytest
from pyspark.sql import functions as F

from arborlake.functions import binary as B
from arborlake.functions import ed25519, records, variant
from arborlake.functions import scalars as S
from arborlake.operators.transaction import StoreWriter
from arborlake.sources import archive, stores


@pytest.mark.parametrize("n", sorted({max(2 ** (7 * k) + d, 0) for k in range(10) for d in (-1, 0, 1)} | {2**64 - 1}))
def test_varint_round_trip(n):
    data = B.write_varint(n)
    assert len(data) <= 10 and B.read_varint(b"x" + data + b"y", 1) == (n, len(data))


def test_varint_faults():
    for bad in (b"", b"\x80", b"\xff" * 11):
        with pytest.raises(ValueError):
            B.read_varint(bad)


def test_size_entries(spark):
    entry = bytes(range(32)) + B.write_varint(54) + B.write_varint(2**63) + b"\x02"
    got = spark.createDataFrame([(entry,), (entry[:-1],)], "e binary").select(B.size_entry("e").alias("s")).select("s.*").collect()
    assert [(r["archived"], r["unpacked"], r["objtype"]) for r in got] == [(54, 2**63, 2), (54, 2**63, 1)]


def test_siphash_reference_vector():
    assert B.siphash24(bytes(range(16)), bytes(range(15))) == 0xA129CA6149BE45E5


def test_bloom(spark):
    b = B.Bloom()
    words = [f"ref/{k}/{k * k}" for k in range(12)]
    assert not any(w in b for w in words)
    for w in words:
        b.add(w)
    assert all(w in b for w in words) and all(w in B.Bloom(data=bytes(b)) for w in words)
    rows = spark.createDataFrame([("k", w) for w in words] + [("k", None)], "key string, item string").repartition(3)
    assert B.bloom_build(rows, "key", "item").first()["bloom"] == bytearray(bytes(b))


def slow_next(data, start):
    """The length up to the next boundary, one byte at a time; 0 where there is none."""
    window, s1, s2 = [0] * B.WINDOW, B.WINDOW * B.CHAR_OFFSET, B.WINDOW * (B.WINDOW - 1) * B.CHAR_OFFSET
    for i in range(len(data) - start):
        drop, add = window[i % B.WINDOW], data[start + i]
        window[i % B.WINDOW] = add
        s1 += add - drop
        s2 += s1 - B.WINDOW * (drop + B.CHAR_OFFSET)
        if s2 & 8191 == 8191:
            return i + 1
    return 0


def slow_chunk_ends(data):
    ends, start, over = [], 0, False
    while start < len(data):
        step = 0 if over else slow_next(data, start)
        over = over or not step
        start += min(step or B.CHUNK_CAP, B.CHUNK_CAP, len(data) - start)
        ends.append(start)
    return ends


def test_chunks_equal_a_byte_loop():
    rng = random.Random(1)
    data = [rng.randbytes(100_000) + bytes(40_000), b"", b"x", bytes(100_000), rng.randbytes(70) + bytes(33_000)]
    data += [bytes(rng.randrange(256) for _ in range(rng.randint(1, 300))) * (100_000 // 300) for _ in range(25)]
    for d in data:
        assert B.chunk_ends(d) == slow_chunk_ends(d)


def test_chunk_match_after_an_edit(spark):
    old = random.Random(2).randbytes(300_000)
    new = old[:1000] + b"inserted" + old[1000:]
    frame = lambda x: spark.createDataFrame([("f", x)], "k string, c binary")
    got = B.match_chunks(B.chunks(frame(old), "k", "c"), B.chunks(frame(new), "k", "c")).collect()
    assert sum(r["len"] for r in got) > 200_000
    assert all(old[r["from_start"] :][: r["len"]] == new[r["start"] :][: r["len"]] for r in got)


def test_binary_diff_round_trip():
    rng = random.Random(5)
    old = rng.randbytes(20_000)
    for new in (old, b"", old[5000:] + old[:5000], old[:7000] + b"x" * 100 + old[7100:], rng.randbytes(500)):
        assert B.binary_patch(old, B.binary_diff(old, new)) == new
    assert B.binary_patch(b"", B.binary_diff(b"", b"abc")) == b"abc"
    assert len(B.binary_diff(old, old[:9000] + b"!" + old[9000:])) < 400


def test_parts_are_whole_or_a_fault():
    data = bytes(5000)
    for how in ("none", "lzma"):
        part = B.encode_part(data, how)
        assert B.decode_part(part) == B.decode_part(part, 5000) == data
        with pytest.raises(ValueError):
            B.decode_part(part, 1000)
    with pytest.raises(ValueError):
        B.decode_part(B.encode_part(random.Random(1).randbytes(5000), "lzma")[:-40])


def test_operations_as_bytes():
    ops = [("open", 300, 1, 2), ("write", 7, 200), ("set_source", 40), ("write", 130, 90), ("patch", 5, 10), ("unset_source",), ("close",), ("open_splice_close", 1000, 4, 3, 0), ("open_splice_close", 9, 5)]
    code = B.write_operations(ops, (False, False, True))
    assert B.read_operations(code, (False, False, True)) == ops
    for bad in (b"?", b"w\x80", code[:2]):
        with pytest.raises(ValueError):
            B.read_operations(bad)
    source, name = b"old content", hashlib.sha256(b"old content").digest()
    program = [("open", 7), ("set_source", 0), ("write", 0, 3), ("unset_source",), ("write", 32, 4), ("close",)]
    modes, _, payload, back = B.read_part(B.part_bytes([(0, 0, 33188)], name + b"new!", B.write_operations(program)))
    assert modes == [(0, 0, 33188)] and B.run_part(back, payload, {name.hex(): source}) == [b"oldnew!"]
    with pytest.raises(ValueError):
        B.run_part(B.write_operations([("open_splice_close", 10, 10)]), b"short", {})


def test_a_broken_stream_is_null(spark):
    packed = zlib.compressobj(6, zlib.DEFLATED, -15)
    good = packed.compress(b"text") + packed.flush()
    got = spark.createDataFrame([(1, good), (2, good[:-2]), (3, b"\xff\xff"), (4, None)], "i int, d binary").select("i", B.inflate("d").alias("x")).collect()
    assert {r["i"]: r["x"] and bytes(r["x"]) for r in got} == {1: b"text", 2: None, 3: None, 4: None}


def test_binary_diff_of_long_files_is_quick():
    rng = random.Random(6)
    old = rng.randbytes(2_000_000)
    new = old[:700_000] + rng.randbytes(500_000) + old[900_000:]
    began = time.time()
    patch = B.binary_diff(old, new)
    assert B.binary_patch(old, patch) == new and len(patch) < 520_000 and time.time() - began < 20


def test_variants_round_trip():
    cases = [
        ("(uuua(ayay))", (1, 2, 3, [(b"a", b""), (b"bb", b"c" * 300)])), ("a{sv}", [("k", ("s", "v")), ("n", ("(tu)", (1, 2))), ("z", ("as", ["", "x" * 500]))]), ("(yty)", (1, 2**63, 3)), ("a(yt)", [(1, 2), (3, 4)]), ("as", []), ("(sas)", ("", [])),
        ("v", ("v", ("b", 1))), ("(a(say)a(sayay))", ([("f" * k, bytes(32)) for k in range(400)], [])), ("ai", [-1, 2, 2**31 - 1]), ("(si)", ("abc", -7)),
    ]
    for text, value in cases:
        assert variant.read(text, variant.write(text, value)) == value
    # The documented example of the format: a pair of a string and a number.
    assert variant.write("(si)", ("foo", -1)) == b"foo\0\xff\xff\xff\xff\x04" and variant.write("as", ["i", "can"]) == b"i\0can\0\x02\x06"


def test_forged_records_are_faults(spark):
    rng = random.Random(2)
    commit = records.commit_bytes("ab" * 32, "subject", "", 5, "cd" * 32, "ef" * 32, {"version": ("s", "1")})
    rows = [commit] + [bytes(b ^ (rng.random() < 0.2) * rng.randrange(256) for b in commit[: rng.randint(0, len(commit))]) for _ in range(300)]
    for read in (records.read_commit, records.read_dirtree, records.read_dirmeta, records.read_archive, records.read_summary):
        for r in rows:
            try:
                read(r)
            except ValueError:
                pass
    got = spark.createDataFrame([(r,) for r in rows] + [(None,)], "r binary").select(records.commit_of("r").alias("c")).collect()
    assert got[0]["c"]["subject"] == "subject" and got[0]["c"]["fault"] is None and sum(r["c"]["fault"] is not None for r in got) > 250
    with pytest.raises(ValueError):
        records.read_dirtree(variant.write(records.DIRTREE, ([("../f", bytes(32))], [])))


# The names that the store's format gives to these objects.
GOLDEN = [
    ((0, 0, 0o100644, "", [], b"hi"), "2301b5923720c3edc1f0467addb5c287fd5559e3e0cd1396e7f1edb6b01be9f0"),
    ((0, 0, 0o120777, "bash", [(b"security.selinux\0", b"system_u:object_r:bin_t:s0\0")], b""), "23a2e97d21d960ac7a4e39a8721b1baff7b213e00e5e5641334f50506012fcff"),
]


def test_content_has_the_names_of_the_format(spark):
    for args, name in GOLDEN:
        assert records.content_checksum(*args) == name
        assert records.read_archive(records.archive_bytes(*args))["checksum"] == name
    rows = [(1, 2, 0o100644, "", "é" * 9), (0, 0, 0o120777, "t" * 300, ""), (7, 7, 0o120777, "u" * 238, ""), (7, 7, 0o120777, "u" * 237, "")]
    got = spark.createDataFrame(rows, "u int, g int, m int, t string, c string").select("t", S.content_checksum(F.col("u"), F.col("g"), F.col("m"), F.col("t"), F.col("c")).alias("x")).collect()
    assert [r["x"] for r in got] == [records.content_checksum(u, g, m, t, [], c.encode()) for u, g, m, t, c in rows]


def test_summaries_and_trees_round_trip(spark):
    refs = [("b", 3, "ab" * 32, 7, None), ("a", 2**40, "cd" * 32, 9, "1.0")]
    assert records.read_summary(records.summary_bytes(refs)) == [refs[1], refs[0]]
    tree = spark.createDataFrame([([("z", "11" * 32), ("é", "22" * 32)], [("d", "33" * 32, "44" * 32)])], "f array<struct<name:string,checksum:string>>, d array<struct<name:string,tree:string,meta:string>>")
    got = tree.select(records.dirtree_of(records.dirtree_record("f", "d")).alias("t")).first()["t"]
    assert [f["name"] for f in got["files"]] == ["z", "é"] and got["dirs"][0]["meta"] == "44" * 32 and got["fault"] is None


def test_ed25519_vector():
    # Test 2 of RFC 8032.
    seed = bytes.fromhex("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb")
    key, signature = ed25519.public_key(seed), ed25519.sign(seed, b"\x72")
    assert key.hex() == "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c"
    assert signature.hex() == "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"
    assert ed25519.verify(key, b"\x72", signature) and not ed25519.verify(key, b"\x73", signature) and not ed25519.verify(key, b"\x72", signature[:-1] + b"\x10") and not ed25519.verify(key[:-1], b"", b"")


def test_part_codecs_and_operations():
    for how in ("none", "lzma"):
        assert B.decode_part(B.encode_part(b"data" * 100, how)) == b"data" * 100
    with pytest.raises(ValueError):
        B.decode_part(b"?")
    patch = B.binary_diff(b"source text", b"source texts")
    made = B.apply_operations([("open", 12), ("set_source", "s"), ("patch", 0, len(patch)), ("unset_source",), ("close",)], patch, {"s": b"source text"})
    assert made == [b"source texts"]
    with pytest.raises(ValueError):
        B.apply_operations([("open", 3), ("close",)], b"", {})


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_kernel_arguments(spark):
    args = S.parse_kargs(F.lit('root=/dev/sda quiet nosmt nosmt test=a test=b opt="x y" single=1'))
    r = one(
        spark, S.format_kargs(args), S.format_kargs(S.delete_karg(args, "nosmt")), S.format_kargs(S.delete_karg(args, "test")), S.format_kargs(S.delete_karg(args, "test", "b")),
        S.format_kargs(S.replace_karg(args, "single", "2")), S.format_kargs(S.replace_karg(args, "test", "c")), S.format_kargs(S.replace_karg(args, "test", "c", "a")), S.karg_last(args, "test"),
    )
    assert r[0] == 'root=/dev/sda quiet nosmt nosmt test=a test=b opt="x y" single=1'
    assert r[1].count("nosmt") == 1 and r[2] is None and "test=b" not in r[3]
    assert r[4].endswith("single=2") and r[5] is None and "test=c test=b" in r[6] and r[7] == "b"


def test_names_and_paths(spark):
    a, b = "a" * 64, "b" * 64
    r = one(spark, S.parse_delta_name(F.lit(f"{a}-{b}")), S.parse_delta_name(F.lit("junk")), S.parse_refspec(F.lit("origin:os/x86")), S.parse_refspec(F.lit("a:b:c")), S.parse_object_name(F.lit(f"{a}.dirtree")), S.split_path(F.lit("/a//./b/")), S.split_path(F.lit("a/../b")), S.tar_path(F.lit("./etc/x/")), S.http_date(F.lit("Sun, 06 Nov 1994 08:49:37 GMT")), S.http_date(F.lit("yesterday")), S.human_size(F.lit(1550)), S.min_free_space(F.lit("2GB")), S.min_free_space(F.lit("2XB")))
    assert (r[0]["old"], r[0]["new"], r[1]) == (a, b, None)
    assert (r[2]["remote"], r[2]["ref"], r[3], r[4]["objtype"]) == ("origin", "os/x86", None, 2)
    assert (r[5], r[6], r[7], r[8], r[9], r[10], r[11], r[12]) == (["a", "b"], None, "usr/etc/x", 784111777, None, "1.6 kB", 2 << 30, None)


def test_zbase32():
    assert B.zbase32(b"\x00") == "yy" and B.zbase32(b"\xf0\xbf\xc7") == "6n9hq"


def test_store_writer(spark, tmp_path):
    writer = StoreWriter(spark, str(tmp_path / "store"))
    objects = lambda *c: spark.createDataFrame([(x, x * 2) for x in c], "checksum string, content string")
    refs = lambda *r: spark.createDataFrame(list(r), "ref_name string, seq int, checksum string")
    assert writer.commit(objects("a", "b", "a"), refs(("main", 1, "a"))) == 2
    assert writer.commit(objects("b", "c"), refs(("main", 1, "b"), ("main", 2, "c"), ("old", 1, "b"), ("old", 2, None))) == 1
    assert sorted(r[0] for r in writer.objects().select("checksum").collect()) == ["a", "b", "c"]
    assert [tuple(r) for r in writer.refs().collect()] == [("main", "c")]
    # A transaction repeated under its name changes nothing.
    for _ in range(2):
        assert writer.commit(objects("d", "a"), refs(("main", 1, "d")), "t1") == 1
    assert writer.objects().count() == 4 and [tuple(r) for r in writer.refs().collect()] == [("main", "d")]
    # A writer that crashed before its version was whole is not seen.
    (tmp_path / "store/refs/00000099-crashed").mkdir()
    assert [tuple(r) for r in writer.refs().collect()] == [("main", "d")]
    (tmp_path / "store/claims/00000004").touch()
    with pytest.raises(RuntimeError):
        writer.commit(objects("e"), refs(("main", 1, "e")))
    assert [tuple(r) for r in writer.refs().collect()] == [("main", "d")]


def test_loose_objects_and_folder(spark, tmp_path):
    body = b"payload"
    name = hashlib.sha256(body).hexdigest()
    at = tmp_path / "repo/objects" / name[:2]
    at.mkdir(parents=True)
    (at / f"{name[2:]}.filez").write_bytes(zlib.compress(body))
    (at / f"{name[2:]}.dirtree").write_bytes(b"t")
    (at / "junk.file").write_bytes(b"x")
    got = stores.loose_objects(spark, str(tmp_path / "repo")).collect()
    assert sorted((r["checksum"], r["objtype"]) for r in got) == [(name, 1), (name, 2)]
    assert {r["path"] for r in stores.folder(spark, str(tmp_path / "repo")).collect()} == {f"objects/{name[:2]}/{x}" for x in (f"{name[2:]}.filez", f"{name[2:]}.dirtree", "junk.file")}


def test_tar_import_resolves_hard_links(spark, tmp_path):
    out = tmp_path / "a.tar"
    with tarfile.open(out, "w") as tar:
        for name, kind, link, body in (("./etc/link", tarfile.LNKTYPE, "./etc/x", b""), ("./etc/x", tarfile.REGTYPE, "", b"hi"), ("./d", tarfile.DIRTYPE, "", b""), ("./s", tarfile.SYMTYPE, "etc/x", b"")):
            info = tarfile.TarInfo(name)
            info.type, info.linkname, info.size = kind, link, len(body)
            tar.addfile(info, io.BytesIO(body))
    got = {r["path"]: (r["type"], r["content"] and bytes(r["content"])) for r in archive.read_tar(spark, str(out), usr_etc=True).collect()}
    assert got == {"usr/etc/link": ("f", b"hi"), "usr/etc/x": ("f", b"hi"), "d": ("d", None), "s": ("l", None)}


def test_broken_files_fail_no_other(spark):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        info = tarfile.TarInfo("a")
        info.size = 2
        tar.addfile(info, io.BytesIO(b"hi"))
    files = spark.createDataFrame([("good", out.getvalue()), ("bad", b"no archive" * 100), ("cut", out.getvalue()[:513])], "path string, content binary")
    got = {(r["archive"], r["type"]) for r in archive.tar_members(files).collect()}
    assert ("good", "f") in got and ("bad", "fault") in got
    links = stores.metalink_urls(spark.createDataFrame([("x", b"<no"), ("y", b'<metalink xmlns="http://www.metalinker.org/"><file name="f"><size> z</size><url protocol="http" preference="q">u</url></file></metalink>')], "path string, content binary")).collect()
    assert {(r["file"], r["url"], r["fault"] is None) for r in links} == {("x", None, False), ("y", "u", True)}


def test_tar_export(spark, tmp_path):
    rows = [("root/a", "file", None, b"1", 0o100644), ("root/b", "hardlink", "root/a", None, 0o100644), ("root", "dir", None, None, 0o40755)]
    archive.write_tar(spark.createDataFrame(rows, "path string, entry string, target string, content binary, mode int"), str(tmp_path / "o.tar"))
    with tarfile.open(tmp_path / "o.tar") as tar:
        assert [(m.name, m.mtime) for m in tar] == [("root", 0), ("root/a", 0), ("root/b", 0)] and tar.extractfile("root/b").read() == b"1"


def test_key_file_and_metalink(spark, tmp_path):
    (tmp_path / "config").write_text('# c\n[core]\nmode = bare\n[remote "o"]\nurl=http://x/?a=b\n')
    got = {(r["section"], r["key"]): r["value"] for r in stores.key_file(spark, str(tmp_path / "config")).collect()}
    assert got == {("core", "mode"): "bare", ('remote "o"', "url"): "http://x/?a=b"}
    body = b"summary"
    (tmp_path / "m.xml").write_text(f'<metalink xmlns="http://www.metalinker.org/"><files><file name="s"><size>7</size><verification><hash type="sha256">{hashlib.sha256(body).hexdigest()}</hash></verification><resources><url protocol="http" preference="90">http://bad/s</url><url protocol="http" preference="50">http://good/s</url></resources></file></files></metalink>')
    links = stores.metalink(spark, str(tmp_path / "m.xml"))
    fetched = spark.createDataFrame([("http://bad/s", b"forged!"), ("http://good/s", body)], "url string, content binary")
    assert [r["url"] for r in stores.accept_download(links, fetched).collect()] == ["http://good/s"]


def test_commit_stream(spark, tmp_path):
    from arborlake.streaming.follow import follow_commits

    schema = "checksum string, ref string, ts bigint"
    path = str(tmp_path / "commits")
    spark.createDataFrame([("a", "r", 1000), ("b", "r", 1001), ("a", "r", 1000)], schema).write.parquet(path)
    q = follow_commits(spark, path, schema).writeStream.format("memory").queryName("followed").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["checksum"] for r in spark.table("followed").collect()) == ["a", "b"]
