"""Signatures and boilerplate rules on cases of a made-up lending library."""

import pytest
from pyspark.sql import functions as F

from callscope.functions import rules, sig

P = "org/libris/"
#: owner, name, descriptor, identifier, display
SIGNATURES = [
    (P + "LoanDesk", "close", "()Z", "org.libris.LoanDesk#close()", "close()"),
    (P + "LoanDesk", "lend", f"(L{P}Book;I)L{P}Receipt;", "org.libris.LoanDesk#lend(Book, int)", "lend(Book, int)"),
    (P + "Shelf", "fill", "(BCSFZ)V", "org.libris.Shelf#fill(byte, char, short, float, boolean)", "fill(byte, char, short, float, boolean)"),
    (P + "Shelf", "times", "([J[[D)V", "org.libris.Shelf#times(long[], double[][])", "times(long[], double[][])"),
    (P + "Shelf", "sort", f"([[[L{P}Book;Ljava/util/Comparator;)V", "org.libris.Shelf#sort(Book[][][], Comparator)", "sort(Book[][][], Comparator)"),
    (P + "Shelf$Row", "next", f"(L{P}Shelf$Row$Slot;)V", "org.libris.Shelf$Row#next(Slot)", "next(Slot)"),
    (P + "Shelf$Row", "<init>", f"(L{P}Shelf;J)V", "org.libris.Shelf$Row#<init>(Shelf, long)", "new Row(Shelf, long)"),
    (P + "Receipt", "<init>", "()V", "org.libris.Receipt#<init>()", "new Receipt()"),
    (P + "Receipt", "<clinit>", "()V", "org.libris.Receipt#<clinit>()", "static {}"),
    ("Tool", "run", "(LTool;[Ljava/lang/Object;)V", "Tool#run(Tool, Object[])", "run(Tool, Object[])"),
]


def test_signatures(spark):
    rows = spark.createDataFrame(SIGNATURES, "owner string, name string, descriptor string, identifier string, display string")
    o, n, d = F.col("owner"), F.col("name"), F.col("descriptor")
    found = rows.select(sig.identifier(o, n, d), sig.display(o, n, d), "identifier", "display", sig.param_count_desc(d), sig.param_count_sig(F.col("identifier"))).collect()
    assert [(r[0], r[1]) for r in found] == [(r[2], r[3]) for r in found]
    assert [r[4] for r in found] == [r[5] for r in found] == [0, 2, 5, 2, 2, 1, 2, 0, 0, 2]


def test_readable_parameters(spark):
    texts = {"A#m(Map<K, List<V>>, int)": 2, "A#m(Function<Pair<A, B>, C>)": 1, "A#m( )": 0, "A#m(a,b,c)": 3, "m(x)": 1}
    rows = spark.createDataFrame(list(texts.items()), "s string, n int")
    assert all(r[0] == r[1] for r in rows.select(sig.param_count_sig(F.col("s")), "n").collect())
    back = {"": "()", "int": "(I)", "String, int[]": "(Ljava/lang/String;[I)", "a.b.C[][], boolean": "([[La/b/C;Z)"}
    rows = spark.createDataFrame(list(back.items()), "s string, d string")
    assert all(r[0] == r[1] for r in rows.select(sig.params_to_descriptor(F.col("s")), "d").collect())


def rule(method="", cls="", source="ALL", params=None, enabled=True):
    return rules.Rule("r", "rule", method, cls, source, params, enabled)


LEND, RENEW = "org.libris.LoanDesk#lend(Book, int)", "org.libris.LoanDesk#renewAll()"
#: What is tested: signature, source, rules, whether the method is noise.
NOISE = {
    "a pattern is found anywhere in the name": (RENEW, "PROJECT", [rule("new")], True),
    "an anchored pattern is not": (RENEW, "PROJECT", [rule("^new")], False),
    "alternatives": (LEND, "PROJECT", [rule("borrow|lend|give")], True),
    "case counts": (LEND, "PROJECT", [rule("LEND")], False),
    "no limit matches all": (LEND, "EXTERNAL", [rule()], True),
    "a disabled rule matches nothing": (LEND, "EXTERNAL", [rule(enabled=False)], False),
    "method and class must both match": (LEND, "PROJECT", [rule("lend", "Desk$")], True),
    "the class does not": (LEND, "PROJECT", [rule("lend", "^Desk")], False),
    "the class has dots": (LEND, "PROJECT", [rule("", r"^org\.libris\.")], True),
    "source in another case": (LEND, "DEPENDENCY", [rule("lend", source="dependency")], True),
    "another source": (LEND, "DEPENDENCY", [rule("lend", source="EXTERNAL")], False),
    "empty source is no limit": (LEND, "DEPENDENCY", [rule("lend", source="")], True),
    "the number of parameters": (LEND, "PROJECT", [rule("lend", params=2)], True),
    "another number": (LEND, "PROJECT", [rule("lend", params=1)], False),
    "no parameters": (RENEW, "PROJECT", [rule("renew", params=0)], True),
    "commas in type arguments do not count": ("org.libris.Index#find(Map<Title, Set<Book>>, int)", "PROJECT", [rule("find", params=2)], True),
    "constructors": ("org.libris.Receipt#<init>()", "PROJECT", [rule("<init>")], True),
    "a blank pattern is a space": (LEND, "PROJECT", [rule("  ")], False),
    "a blank class too": (LEND, "PROJECT", [rule("lend", " ")], False),
    "a bad pattern matches nothing": (LEND, "PROJECT", [rule("[lend")], False),
    "a bad class pattern too": (LEND, "PROJECT", [rule("lend", "*")], False),
    "any of several": (LEND, "PROJECT", [rule("[lend"), rule("close"), rule("lend")], True),
    "none of several": (LEND, "PROJECT", [rule("close"), rule("lend", params=0)], False),
}


@pytest.mark.parametrize("case", NOISE)
def test_noise(spark, case):
    identifier, source, applied, noise = NOISE[case]
    row = spark.createDataFrame([(identifier, source)], "sig string, source string")
    assert row.select(rules.is_noise(rules.usable(spark, applied), F.col("sig"), F.col("source"))).collect()[0][0] is noise


def test_parse_entry(spark):
    texts = {
        "org.libris.Desk": ("org.libris.Desk", None, None),
        " org.libris.Desk#open ": ("org.libris.Desk", "open", None),
        "org.libris.Desk#open()": ("org.libris.Desk", "open", "()"),
        "org.libris.Desk#lend(String, long[])": ("org.libris.Desk", "lend", "(Ljava/lang/String;[J)"),
        "org.libris.Desk#lend([JLa/B;)La/C;": ("org.libris.Desk", "lend", "([JLa/B;)La/C;"),
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [tuple(r[0]) for r in rows.select(sig.parse_entry(F.col("t"))).collect()] == list(texts.values())
