"""Method signatures as columns: descriptors, identifiers, labels, access flags, patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One parameter of a descriptor.
PARAM = r"\[*(?:L[^;]+;|[BCDFIJSZ])"
#: Descriptor letters of the primitive types.
PRIMITIVES = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "Z": "boolean"}
#: Package prefixes of the platform's own classes.
JDK = r"^(java/|javax/|jdk/|sun/|com/sun/|com/oracle/|org/w3c/dom/|org/xml/sax/|org/omg/)"
#: Labels of source and invoke codes.
SOURCE_LABELS = {"PROJECT": "项目", "DEPENDENCY": "依赖", "EXTERNAL": "外部"}
INVOKE_LABELS = {"VIRTUAL": "虚调用", "STATIC": "静态", "INTERFACE": "接口", "SPECIAL": "构造/super", "DYNAMIC": "lambda/方法引用", "IMPL": "接口实现分派"}
#: Access bits.
PUBLIC, STATIC, BRIDGE, NATIVE, INTERFACE, ABSTRACT, SYNTHETIC, ENUM = 0x1, 0x8, 0x40, 0x100, 0x200, 0x400, 0x1000, 0x4000


def _lookup(values: dict[str, str], code: Column, otherwise: Column | None = None) -> Column:
    found = F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), code)
    return found if otherwise is None else F.coalesce(found, otherwise)


def short_name(internal: Column) -> Column:
    """What follows the last / or $."""
    return F.regexp_extract(internal, r"([^/$]*)$", 1)


def simple_name(internal: Column) -> Column:
    """What follows the last /."""
    return F.regexp_extract(internal, r"([^/]*)$", 1)


def class_name(internal: Column) -> Column:
    return F.replace(internal, F.lit("/"), F.lit("."))


def _params(desc: Column) -> Column:
    return F.regexp_extract_all(F.regexp_extract(desc, r"^\(([^)]*)\)", 1), F.lit(PARAM), F.lit(0))


def param_types(desc: Column) -> Column:
    """Short names of a descriptor's parameter types, [] for each dimension."""

    def one(d: Column) -> Column:
        base = F.regexp_replace(d, r"^\[+", "")
        name = F.when(base.startswith("L"), short_name(F.regexp_replace(base, "^L|;$", ""))).otherwise(_lookup(PRIMITIVES, base))
        return F.concat(name, F.repeat(F.lit("[]"), F.length(d) - F.length(base)))

    return F.transform(_params(desc), one)


def param_count_desc(desc: Column) -> Column:
    return F.size(_params(desc))


def identifier(owner: Column, name: Column, desc: Column) -> Column:
    """fq.Class#name(T1, T2)."""
    return F.concat(class_name(owner), F.lit("#"), name, F.lit("("), F.array_join(param_types(desc), ", "), F.lit(")"))


def display(owner: Column, name: Column, desc: Column) -> Column:
    """new Simple(args), static {} or name(args)."""
    args = F.concat(F.lit("("), F.array_join(param_types(desc), ", "), F.lit(")"))
    return F.when(name == "<init>", F.concat(F.lit("new "), short_name(owner), args)).when(name == "<clinit>", F.lit("static {}")).otherwise(F.concat(name, args))


def param_count_sig(sig: Column) -> Column:
    """Parameters of a readable signature; commas within <> or () inside it do not count."""
    args = F.regexp_extract(sig, r"\((.*)\)", 1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(1).alias("n"))

    def step(s: Column, c: Column) -> Column:
        depth = s.getField("depth") + F.when(c.isin("<", "("), 1).when(c.isin(">", ")"), -1).otherwise(0)
        n = s.getField("n") + F.when((c == ",") & (s.getField("depth") == 0), 1).otherwise(0)
        return F.struct(depth.alias("depth"), n.alias("n"))

    counted = F.aggregate(F.split(args, ""), start, step, lambda s: s.getField("n"))
    return F.when(F.trim(args) == "", F.lit(0)).otherwise(counted)


def split_signature(sig: Column) -> Column:
    """Struct of class_name, simple_class, method_name, param_count; without # the class is empty."""
    at = F.instr(sig, "#")
    cls = F.when(at > 0, F.substring(sig, F.lit(1), at - 1)).otherwise(F.lit(""))
    method = F.regexp_extract(F.when(at > 0, F.substring(sig, at + 1, F.length(sig))).otherwise(sig), r"^([^(]*)", 1)
    return F.struct(cls.alias("class_name"), F.regexp_extract(cls, r"([^.]*)$", 1).alias("simple_class"), method.alias("method_name"), param_count_sig(sig).alias("param_count"))


def full_signature(cls: Column, method: Column, desc: Column) -> Column:
    """Class only without a method; a method without a descriptor has no brackets."""
    bare = F.concat(cls, F.lit("#"), method)
    args = F.concat(F.lit("("), F.array_join(param_types(desc), ", "), F.lit(")"))
    return F.when(F.coalesce(method, F.lit("")) == "", cls).when(F.coalesce(desc, F.lit("")) == "", bare).otherwise(F.concat(bare, args))


def params_to_descriptor(params: Column) -> Column:
    """Readable parameters to a descriptor without its result: `String, int[]` to `(Ljava/lang/String;[I)`."""
    letters = {v: k for k, v in PRIMITIVES.items()} | {"String": "Ljava/lang/String;", "Object": "Ljava/lang/Object;"}

    def one(p: Column) -> Column:
        p = F.trim(p)
        base = F.regexp_replace(p, r"(\[\])+$", "")
        dims = (F.length(p) - F.length(base)) / 2
        return F.concat(F.repeat(F.lit("["), dims.cast("int")), _lookup(letters, base, F.concat(F.lit("L"), F.replace(base, F.lit("."), F.lit("/")), F.lit(";"))))

    inner = F.when(F.trim(params) == "", F.lit("")).otherwise(F.array_join(F.transform(F.split(params, ","), one), ""))
    return F.concat(F.lit("("), inner, F.lit(")"))


def parse_entry(text: Column) -> Column:
    """Struct of class_name, method_name, descriptor from Class, Class#m, Class#m(args) or Class#m(desc)ret."""
    text = F.trim(text)
    cls, rest = F.regexp_extract(text, r"^([^#]*)", 1), F.regexp_extract(text, r"#(.*)$", 1)
    name, args = F.regexp_extract(rest, r"^([^(]*)", 1), F.regexp_extract(rest, r"(\(.*)$", 1)
    inner = F.regexp_extract(args, r"^\(([^)]*)\)", 1)
    raw = args.rlike(rf"^\(({PARAM})*\)\[*(V|L[^;]+;|[BCDFIJSZ])$")
    desc = F.when(args == "", F.lit(None)).when(raw, args).otherwise(params_to_descriptor(inner))
    return F.struct(cls.alias("class_name"), F.when(name == "", F.lit(None)).otherwise(name).alias("method_name"), desc.alias("descriptor"))


def has_flag(access: Column, bit: int) -> Column:
    return access.bitwiseAND(bit) != 0


def is_interface(access: Column) -> Column:
    return has_flag(access, INTERFACE)


def is_abstract(access: Column) -> Column:
    return has_flag(access, ABSTRACT)


def is_public(access: Column) -> Column:
    return has_flag(access, PUBLIC)


def is_static(access: Column) -> Column:
    return has_flag(access, STATIC)


def is_synthetic_or_bridge(access: Column) -> Column:
    return has_flag(access, SYNTHETIC | BRIDGE)


def is_concrete(access: Column) -> Column:
    """A declared method with a body in bytecode: neither abstract nor native."""
    return ~has_flag(access, ABSTRACT | NATIVE)


def is_jdk(internal: Column) -> Column:
    return internal.rlike(JDK)


def wildcard_to_regex(pattern: str) -> str:
    """** is any text, * any text without a dot, all else itself but for ?, which stays a quantifier."""
    special = set("\\.[]{}()+-^$|")
    out = []
    for part in re.findall(r"\*\*|\*|[^*]", pattern):
        out.append(".*" if part == "**" else "[^.]*" if part == "*" else "\\" + part if part in special else part)
    return "^" + "".join(out) + "$"


def wildcard_match(value: Column, pattern: str) -> Column:
    """A pattern that is no valid regex matches nothing."""
    try:
        re.compile(regex := wildcard_to_regex(pattern))
    except re.error:
        return F.lit(False)
    return F.coalesce(value.rlike(regex), F.lit(False))


def normal_path(path: Column) -> Column:
    """A leading /, and none at the end; the empty path is /."""
    led = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    bare = F.regexp_replace(led, "/+$", "")
    return F.when(bare == "", F.lit("/")).otherwise(bare)


def join_path(base: Column, path: Column) -> Column:
    """The URL path of a method: the class's base path, then its own with a leading /."""
    base, path = F.coalesce(base, F.lit("")), F.coalesce(path, F.lit(""))
    led = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.when(base == "", normal_path(path)).when(path == "", normal_path(base)).otherwise(F.concat(normal_path(base), led))


def result_name(cls: Column, method: Column, depth: Column, nodes: Column, source: Column) -> Column:
    """Simple#method_, eight hex digits of a hash of what the result depends on, .json; odd characters become _."""
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r'[\\/:*?"<>|]', "_")
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (cls, method, depth, nodes, source)]
    named = F.when(clean(method) == "", F.lit("")).otherwise(F.concat(F.lit("#"), clean(method)))
    return F.concat(clean(F.regexp_extract(cls, r"([^.]*)$", 1)), named, F.lit("_"), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 8), F.lit(".json"))


def cap_text(text: Column, most: int = 32767, mark: str = "…（超长已截断）") -> Column:
    """Text for a report cell: too long a text is cut and ends with the mark."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - len(mark)), F.lit(mark))).otherwise(text)


def is_entry_file(name: Column) -> Column:
    return name.rlike(r"_[0-9a-f]{8}\.json$") & (name != "analysis_result.json")


def source_label(code: Column) -> Column:
    return _lookup(SOURCE_LABELS, code, code)


def invoke_label(code: Column) -> Column:
    return _lookup(INVOKE_LABELS, code, code)
