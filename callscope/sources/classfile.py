"""Class files and jars as tables of classes, methods and call sites."""

from __future__ import annotations

import io
import lzma
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.functions import sig

ANNOTATIONS = "array<struct<name:string,values:map<string,array<string>>>>"
CALL = "struct<seq:int,owner:string,name:string,descriptor:string,invoke:string,line:int>"
METHOD = f"struct<name:string,descriptor:string,access:int,ord:int,annotations:{ANNOTATIONS},calls:array<{CALL}>>"
CLASS = f"class_name string, super_name string, interfaces array<string>, access int, location string, annotations {ANNOTATIONS}, methods array<{METHOD}>"
#: Bytes of operands of each opcode, in ranges; opcodes not listed have none.
OPERANDS = {16: 1, 17: 2, 18: 1, 19: 2, 20: 2, 169: 1, 132: 2, 188: 1, 197: 3, 200: 4, 201: 4, 185: 4, 186: 4} | {k: 1 for k in (*range(21, 26), *range(54, 59))} | {k: 2 for k in (*range(153, 169), *range(178, 185), 187, 189, 192, 193, 198, 199)}
#: Instructions that call a method.
INVOKES = {182: "VIRTUAL", 183: "SPECIAL", 184: "STATIC", 185: "INTERFACE"}


class Reader:
    """Big-endian numbers from a class file."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def u(self, size: int) -> int:
        value = int.from_bytes(self.data[self.at : self.at + size], "big")
        self.at += size
        return value


class Pool:
    """The constant pool: entries as (tag, value)."""

    def __init__(self, r: Reader):
        n, k = r.u(2), 1
        self.entries: list[tuple] = [(0, None)] * n
        while k < n:
            tag = r.u(1)
            if tag == 1:
                size = r.u(2)
                value = r.data[r.at : r.at + size].replace(b"\xc0\x80", b"\0").decode("utf-8", "replace")
                r.at += size
            elif tag in (3, 4):
                value = struct.unpack(">i" if tag == 3 else ">f", r.data[r.at : r.at + 4])[0]
                r.at += 4
            elif tag in (5, 6):
                value = struct.unpack(">q" if tag == 5 else ">d", r.data[r.at : r.at + 8])[0]
                r.at += 8
            elif tag in (7, 8, 16, 19, 20):
                value = r.u(2)
            elif tag == 15:
                value = (r.u(1), r.u(2))
            elif tag in (9, 10, 11, 12, 17, 18):
                value = (r.u(2), r.u(2))
            else:
                raise ValueError(f"constant pool tag {tag}")
            self.entries[k] = (tag, value)
            k += 2 if tag in (5, 6) else 1

    def text(self, k: int) -> str | None:
        return self.entries[k][1] if k else None

    def named(self, k: int) -> str | None:
        """The name of a class entry."""
        return self.text(self.entries[k][1]) if k else None

    def member(self, k: int) -> tuple[str, str, str]:
        owner, pair = self.entries[k][1]
        name, descriptor = self.entries[pair][1]
        return self.named(owner), self.text(name), self.text(descriptor)


def attributes(r: Reader, pool: Pool) -> list[tuple[str, int, int]]:
    """(name, start, end) of the attributes at the reader's place."""
    found = []
    for _ in range(r.u(2)):
        name, size = pool.text(r.u(2)), r.u(4)
        found.append((name, r.at, r.at + size))
        r.at += size
    return found


def element(r: Reader, pool: Pool) -> list[str]:
    """An annotation value as strings: an enum as its constant's name, a class as its descriptor."""
    tag = chr(r.u(1))
    if tag == "e":
        r.u(2)
        return [pool.text(r.u(2))]
    if tag == "[":
        return [s for _ in range(r.u(2)) for s in element(r, pool)]
    if tag == "@":
        return [one_annotation(r, pool)["name"]]
    value = pool.text(r.u(2))
    return [("true" if value else "false") if tag == "Z" else chr(value) if tag == "C" else str(value)]


def one_annotation(r: Reader, pool: Pool) -> dict:
    name = pool.text(r.u(2))
    values = {}
    for _ in range(r.u(2)):
        key = pool.text(r.u(2))
        values[key] = element(r, pool)
    return {"name": name[1:-1] if name.startswith("L") else name, "values": values}


def annotations(attrs: list[tuple[str, int, int]], data: bytes, pool: Pool) -> list[dict]:
    found = []
    for name, start, _ in attrs:
        if name in ("RuntimeVisibleAnnotations", "RuntimeInvisibleAnnotations"):
            r = Reader(data, start)
            found += [one_annotation(r, pool) for _ in range(r.u(2))]
    return found


def calls(data: bytes, code: tuple[int, int], pool: Pool, bootstraps: list[list[int]]) -> list[dict]:
    """The calls of a method body in order, each with the last line number before it."""
    r = Reader(data, code[0] + 4)
    size = r.u(4)
    start = r.at
    r.at = start + size
    r.at += 8 * r.u(2)
    lines: dict[int, int] = {}
    for name, at, _ in attributes(r, pool):
        if name == "LineNumberTable":
            t = Reader(data, at)
            for _ in range(t.u(2)):
                pc = t.u(2)
                lines.setdefault(pc, t.u(2))
    found, pc, line = [], 0, 0

    def add(member: tuple[str, str, str], kind: str) -> None:
        found.append({"seq": len(found), "owner": member[0], "name": member[1], "descriptor": member[2], "invoke": kind, "line": line})

    while pc < size:
        line = lines.get(pc, line)
        op, at = data[start + pc], start + pc
        if op in INVOKES:
            add(pool.member(int.from_bytes(data[at + 1 : at + 3], "big")), INVOKES[op])
        elif op == 186:
            boot = pool.entries[int.from_bytes(data[at + 1 : at + 3], "big")][1][0]
            for k in bootstraps[boot]:
                if pool.entries[k][0] == 15:
                    add(pool.member(pool.entries[k][1][1]), "DYNAMIC")
        if op in (170, 171):
            pad = at + 4 - pc % 4
            if op == 170:
                low, high = struct.unpack(">ii", data[pad + 4 : pad + 12])
                pc = pad - start + 12 + 4 * (high - low + 1)
            else:
                pc = pad - start + 8 + 8 * struct.unpack(">i", data[pad + 4 : pad + 8])[0]
        elif op == 196:
            pc += 6 if data[at + 1] == 132 else 4
        else:
            pc += 1 + OPERANDS.get(op, 0)
    return found


def parse_class(data: bytes, location: str) -> dict:
    """One class as a row of CLASS."""
    r = Reader(data, 8)
    if data[:4] != b"\xca\xfe\xba\xbe":
        raise ValueError("no class file")
    pool = Pool(r)
    access, name, parent = r.u(2), pool.named(r.u(2)), pool.named(r.u(2))
    faces = [pool.named(r.u(2)) for _ in range(r.u(2))]
    for _ in range(r.u(2)):  # fields
        r.at += 6
        attributes(r, pool)
    members = [(r.u(2), pool.text(r.u(2)), pool.text(r.u(2)), attributes(r, pool)) for _ in range(r.u(2))]
    own = attributes(r, pool)
    bootstraps: list[list[int]] = []
    for attr, at, _ in own:
        if attr == "BootstrapMethods":
            b = Reader(data, at)
            for _ in range(b.u(2)):
                b.u(2)
                bootstraps.append([b.u(2) for _ in range(b.u(2))])
    methods = []
    for k, (flags, method, descriptor, attrs) in enumerate(members):
        body = next(((s, e) for a, s, e in attrs if a == "Code"), None)
        methods.append({"name": method, "descriptor": descriptor, "access": flags, "ord": k, "annotations": annotations(attrs, data, pool), "calls": calls(data, body, pool, bootstraps) if body else []})
    return {"class_name": name, "super_name": parent, "interfaces": faces, "access": access, "location": location, "annotations": annotations(own, data, pool), "methods": methods}


#: What reading an entry of a damaged, encrypted or oddly packed jar raises.
UNREADABLE = (zipfile.BadZipFile, zlib.error, lzma.LZMAError, RuntimeError, NotImplementedError, EOFError, OSError, ValueError)


def class_bytes(path: str, data: bytes) -> Iterator[tuple[str, str, bytes | None, str | None]]:
    """(location, entry, bytes, error) of the class files in a file: itself, or those of a jar and of the jars in it.

    An entry that can't be read has an error and no bytes, and the rest of its jar goes on; so has a jar whose directory can't be read.
    """
    if path.endswith(".class"):
        yield path, path.rpartition("/")[2], data, None
        return
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as jar:
            for entry in jar.namelist():
                if not entry.endswith((".class", ".jar")) or entry.endswith(("module-info.class", "package-info.class")) or entry.startswith("META-INF/versions/"):
                    continue
                try:
                    raw = jar.read(entry)
                except UNREADABLE as e:
                    yield path, entry, None, f"{type(e).__name__}: {e}"
                    continue
                if entry.endswith(".jar"):
                    yield from class_bytes(f"{path}!/{entry}", raw)
                else:
                    yield path, entry, raw, None
    except UNREADABLE as e:
        yield path, "", None, f"{type(e).__name__}: {e}"


def _parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["class_name", "super_name", "interfaces", "access", "location", "annotations", "methods", "entry", "error"]
    for frame in frames:
        rows: list[dict] = []
        for path, data in zip(frame["path"], frame["content"], strict=True):
            for location, entry, raw, error in class_bytes(path, data):
                row = None
                if raw is not None:
                    try:
                        row = parse_class(raw, location)
                    except (ValueError, IndexError, TypeError, KeyError, AttributeError, struct.error) as e:
                        error = f"{type(e).__name__}: {e}"
                rows.append(dict.fromkeys(names) | (row or {"location": location, "error": error}) | {"entry": entry})
                if len(rows) >= 500:
                    yield pd.DataFrame(rows, columns=names).astype({"access": "Int32"})
                    rows = []
        yield pd.DataFrame(rows, columns=names).astype({"access": "Int32"})


def read_entries_of_jars(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A row for each class entry of class files and jars: the parsed class, or the `error` why it was passed over.

    Each file is one task's work, held whole, and many are read in parallel. For both class_rows() and skipped() at once, store these rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{class,jar}").load(paths).select("path", "content")
    return files.mapInPandas(_parsed, f"{CLASS}, entry string, error string")


def class_rows(entries: DataFrame, source: str = "PROJECT") -> DataFrame:
    """The parsed classes of read_entries_of_jars(), with their source. Platform classes are left out."""
    found = entries.filter("error IS NULL").drop("entry", "error")
    return found.filter(~sig.is_jdk(F.col("class_name"))).withColumn("source", F.lit(source))


def skipped(entries: DataFrame) -> DataFrame:
    """(location, entry, error) of what could not be read; the entry of a jar without a directory is empty."""
    return entries.filter("error IS NOT NULL").select("location", "entry", "error")


def read_class_files(spark: SparkSession, paths: list[str], source: str = "PROJECT") -> DataFrame:
    """Parsed classes of class files and jars: class columns, source, and the methods with their calls. Damaged entries are passed over."""
    return class_rows(read_entries_of_jars(spark, paths), source)


def class_tables(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, methods, call_sites) of read_class_files()."""
    classes = parsed.drop("methods")
    own = parsed.select(F.col("class_name").alias("owner"), F.explode("methods").alias("m"))
    methods = own.select("owner", "m.name", "m.descriptor", "m.access", "m.ord", "m.annotations")
    sites = own.select(F.col("owner").alias("caller_owner"), F.col("m.name").alias("caller_name"), F.col("m.descriptor").alias("caller_desc"), F.explode("m.calls").alias("c"))
    return classes, methods, sites.select("caller_owner", "caller_name", "caller_desc", "c.*")
