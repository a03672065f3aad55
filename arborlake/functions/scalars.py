"""Scalar functions of the store model as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arborlake.sources.project import COMMIT, COMMITMETA, DIRMETA, DIRTREE, FILE, PAYLOAD_LINK, TOMBSTONE

# The suffix of each object type.
SUFFIX = {FILE: "file", DIRTREE: "dirtree", DIRMETA: "dirmeta", COMMIT: "commit", TOMBSTONE: "commit-tombstone", COMMITMETA: "commitmeta", PAYLOAD_LINK: "payload-link"}
REPO_MODES = ("bare", "archive-z2", "bare-user", "bare-user-only", "bare-split-xattrs")


def suffix(objtype: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in SUFFIX.items():
        out = F.when(objtype == k, v).otherwise(out)
    return out


def content_header(uid: Column, gid: Column, mode: Column, target: Column) -> Column:
    """The header of a content object without xattrs, as bytes: its length, four zeros, owner, mode and device, the link's target (empty for a file), and where that ends."""
    end = F.octet_length(target) + 17
    size = F.when(end + 1 < 256, 1).otherwise(2)
    place = F.when(size == 1, F.format_string("%02x", end)).otherwise(F.format_string("%02x%02x", end % 256, F.floor(end / 256).cast("int")))
    number = lambda n: F.format_string("%08x", n)
    return F.unhex(F.concat(number(end + size), F.lit("00000000"), number(uid), number(gid), number(mode), F.lit("00000000"), F.hex(target.cast("binary")), F.lit("00"), place))


def content_checksum(uid: Column, gid: Column, mode: Column, target: Column, content: Column) -> Column:
    """The name of a content object without xattrs: the SHA-256 of header and content."""
    return F.sha2(F.concat(content_header(uid, gid, mode, target), F.coalesce(content.cast("binary"), F.lit(b""))), 256)


def commit_content_checksum(tree: Column, meta: Column) -> Column:
    """The identity of a commit's content: both root hashes, in binary."""
    return F.sha2(F.concat(F.unhex(tree), F.unhex(meta)), 256)


def modified_base64(checksum: Column) -> Column:
    """43 characters: base64 without padding, with _ for the slash."""
    return F.translate(F.regexp_replace(F.base64(F.unhex(checksum)), "=+$", ""), "/", "_")


def loose_path(checksum: Column, objtype: Column, compressed: bool = False) -> Column:
    name = F.concat(F.substring(checksum, 1, 2), F.lit("/"), F.substring(checksum, 3, 62), F.lit("."), suffix(objtype))
    return F.concat(name, F.when(objtype == FILE, "z").otherwise("")) if compressed else name


def delta_path(old: Column, new: Column) -> Column:
    """The folder of a delta: the name in modified base64, cut after two characters."""
    name = F.concat_ws("-", F.when(old.isNotNull(), modified_base64(old)), modified_base64(new))
    return F.concat(F.lit("deltas/"), F.substring(name, 1, 2), F.lit("/"), F.substring(name, 3, 200))


def parse_delta_name(name: Column) -> Column:
    """struct(old, new): ``new`` or ``old-new``; null where a part is no checksum."""
    parts = F.split(name, "-", -1)
    ok = name.rlike("^([0-9a-f]{64}-)?[0-9a-f]{64}$")
    return F.when(ok, F.struct(F.when(F.size(parts) == 2, F.element_at(parts, 1)).alias("old"), F.element_at(parts, -1).alias("new")))


def parse_refspec(spec: Column) -> Column:
    """struct(remote, ref) of ``[remote:]ref``; null where either is malformed."""
    name = r"[A-Za-z0-9_][A-Za-z0-9_.+-]*"
    ok = spec.rlike(rf"^({name}:)?{name}(/{name})*$")
    remote = F.regexp_extract(spec, r"^([^:]*):", 1)
    return F.when(ok, F.struct(F.when(remote != "", remote).alias("remote"), F.regexp_extract(spec, r"([^:]*)$", 1).alias("ref")))


def object_name(checksum: Column, objtype: Column) -> Column:
    return F.concat_ws(".", checksum, suffix(objtype))


def parse_object_name(name: Column) -> Column:
    """struct(checksum, objtype) of ``checksum.type``, cut at the last dot."""
    kind = F.substring_index(name, ".", -1)
    number = F.lit(None).cast("int")
    for k, v in SUFFIX.items():
        number = F.when(kind == v, k).otherwise(number)
    return F.struct(F.regexp_extract(name, r"^(.*)\.[^.]*$", 1).alias("checksum"), number.alias("objtype"))


def mode_type(mode: Column) -> Column:
    fmt = mode.bitwiseAND(0o170000)
    return F.when(fmt == 0o040000, "dir").when(fmt == 0o100000, "file").when(fmt == 0o120000, "symlink").otherwise("other")


def http_date(text: Column) -> Column:
    """A date of exactly 29 bytes (Sun, 06 Nov 1994 08:49:37 GMT) as epoch seconds, else null."""
    plain = F.substring(text, 6, 20)
    ok = (F.octet_length(text) == 29) & text.rlike(r"^[A-Z][a-z]{2}, \d{2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2} GMT$")
    return F.when(ok, F.unix_timestamp(F.try_to_timestamp(plain, F.lit("dd MMM yyyy HH:mm:ss"))))


def display_time(epoch: Column) -> Column:
    return F.when(epoch.between(0, 253402300799), F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd HH:mm:ss")).otherwise("invalid")


def split_path(path: Column) -> Column:
    """The components of a path without empty ones and dots; null if it climbs or is too long."""
    parts = F.filter(F.split(path, "/", -1), lambda p: (p != "") & (p != "."))
    return F.when(F.forall(parts, lambda p: p != "..") & (F.length(path) <= 4096), parts)


def tar_path(path: Column, usr_etc: bool = True) -> Column:
    """A tar member's path: without ./ and trailing slashes, with etc moved below usr."""
    out = F.regexp_replace(F.regexp_replace(path, r"^(\./)+", ""), "/+$", "")
    return F.regexp_replace(out, "^etc(?=/|$)", "usr/etc") if usr_etc else out


def human_size(n: Column) -> Column:
    """SI units with one decimal, half up, as a file manager shows them."""
    out = F.concat(n.cast("string"), F.lit(" bytes"))
    for power, unit in ((3, "kB"), (6, "MB"), (9, "GB"), (12, "TB"), (15, "PB")):
        tenths = F.floor((n * 10 + 10**power // 2) / 10**power)
        out = F.when(n >= 10**power, F.concat(F.floor(tenths / 10), F.lit("."), tenths % 10, F.lit(" " + unit))).otherwise(out)
    return F.when(n == 1, "1 byte").otherwise(out)


def min_free_space(spec: Column) -> Column:
    """Bytes of a size with suffix MB, GB or TB; null where it has none or overflows."""
    n, unit = F.regexp_extract(spec, r"^(\d{1,12})(MB|GB|TB)$", 1), F.regexp_extract(spec, r"^(\d{1,12})(MB|GB|TB)$", 2)
    shift = F.when(unit == "MB", 20).when(unit == "GB", 30).when(unit == "TB", 40)
    return F.when(unit != "", F.try_multiply(n.cast("bigint"), F.pow(F.lit(2), shift).cast("bigint")))


def version_at_least(year: Column, release: Column, need_year: int, need_release: int) -> Column:
    return (year > need_year) | ((year == need_year) & (release >= need_release))


def key_values(text: Column) -> Column:
    """KEY=VALUE lines as a map; blank lines and comments don't count, quotes around a value go, the last line of a key wins."""
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"^\s*[A-Za-z_][A-Za-z0-9_]*="))
    pairs = F.transform(lines, lambda s: F.struct(F.trim(F.substring_index(s, "=", 1)).alias("key"), F.regexp_replace(F.regexp_replace(s, "^[^=]*=", ""), "^[\"'](.*)[\"']$", "$1").alias("value")))
    last = F.aggregate(pairs, F.array().cast("array<struct<key:string,value:string>>"), lambda acc, p: F.concat(F.filter(acc, lambda q: q["key"] != p["key"]), F.array(p)))
    return F.map_from_entries(last)


# Kernel arguments: an ordered multimap as array<struct<key, value>>; a value is null where there is no equals sign.


def parse_kargs(line: Column) -> Column:
    """Split at spaces outside double quotes."""
    words = F.regexp_extract_all(line, F.lit(r'((?:[^ "]|"[^"]*")+)'), F.lit(1))
    return F.transform(words, lambda w: F.struct(F.substring_index(w, "=", 1).alias("key"), F.when(F.instr(w, "=") > 0, F.regexp_replace(w, "^[^=]*=", "")).alias("value")))


def format_kargs(args: Column) -> Column:
    return F.array_join(F.transform(args, lambda a: F.concat(a["key"], F.when(a["value"].isNull(), "").otherwise(F.concat(F.lit("="), a["value"])))), " ")


def karg_last(args: Column, key: str) -> Column:
    return F.element_at(F.filter(args, lambda a: a["key"] == key), -1)["value"]


def _struct(key: str, value: str | None) -> Column:
    return F.struct(F.lit(key).alias("key"), F.lit(value).cast("string").alias("value"))


def append_karg(args: Column, key: str, value: str | None) -> Column:
    return F.concat(args, F.array(_struct(key, value)))


def replace_karg(args: Column, key: str, new: str, old: str | None = None) -> Column:
    """The argument with a new value at its place; null where it is missing or, without ``old``, has several values."""
    hits = F.filter(args, lambda a: (a["key"] == key) & (F.lit(old is None) | (a["value"] == old)))
    at = F.array_position(args, F.element_at(hits, 1))
    swapped = F.concat(F.slice(args, F.lit(1), (at - 1).cast("int")), F.array(_struct(key, new)), F.slice(args, (at + 1).cast("int"), F.size(args)))
    ok = F.size(hits) == 1 if old is None else F.size(hits) >= 1
    return F.when(ok, swapped)


def delete_karg(args: Column, key: str, value: str | None = None) -> Column:
    """One such argument less (the first); by key alone only if all of its values are equal; null where it fails."""
    mine = F.filter(args, lambda a: a["key"] == key)
    hits = mine if value is None else F.filter(mine, lambda a: a["value"] == value)
    at = F.array_position(args, F.element_at(hits, 1))
    cut = F.concat(F.slice(args, F.lit(1), (at - 1).cast("int")), F.slice(args, (at + 1).cast("int"), F.size(args)))
    ok = (F.size(hits) >= 1) & (F.size(F.array_distinct(mine)) == 1 if value is None else F.lit(True))
    return F.when(ok, cut)


def boot_entry(text: Column) -> Column:
    """``key value`` lines as a map; the first of a key counts, comments don't."""
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"^[A-Za-z-]+[ \t]+\S"))
    pairs = F.transform(lines, lambda s: F.struct(F.regexp_extract(s, r"^(\S+)", 1).alias("key"), F.regexp_extract(s, r"^\S+\s+(.*)$", 1).alias("value")))
    first = F.aggregate(pairs, F.array().cast("array<struct<key:string,value:string>>"), lambda acc, p: F.when(F.exists(acc, lambda q: q["key"] == p["key"]), acc).otherwise(F.concat(acc, F.array(p))))
    return F.map_from_entries(first)


def boot_counting(filename: Column) -> Column:
    """struct(left, done) of ``name+LEFT[-DONE].conf``; done is 0 where it isn't given, both null without a counter."""
    left = F.regexp_extract(filename, r"\+(\d+)(?:-(\d+))?\.conf$", 1)
    done = F.regexp_extract(filename, r"\+(\d+)(?:-(\d+))?\.conf$", 2)
    return F.struct(F.when(left != "", left.cast("int")).alias("left"), F.when(left != "", F.when(done == "", 0).otherwise(done.cast("int"))).alias("done"))


def filter_xattrs(xattrs: Column, *dropped: str) -> Column:
    """Sorted by name, without the dropped ones."""
    return F.array_sort(F.filter(xattrs, lambda x: ~x["name"].isin(*dropped)))


def is_compressed_name(names: Column) -> Column:
    """Whether any name has the extension of an xz or bz2 file; such files get no binary delta."""
    return F.exists(names, lambda n: (F.instr(n, ".") > 0) & F.substring_index(n, ".", -1).isin("xz", "bz2"))
