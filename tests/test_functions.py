"""Column functions against plain Python on small inputs."""

import re

import pytest
from pyspark.sql import functions as F

from gramlode.functions import marks, paths, regex, text
from gramlode.functions.encodings import canonical_encoding, canonical_encoding_str, decode_text, is_binary
from gramlode.functions.ignore import parse_rule
from gramlode.sources.files import assign_root, parse_root_specs, read_roots, resolve_roots


def values(spark, rows, expr, schema="v string"):
    df = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema)
    return [r[0] for r in df.coalesce(1).select(expr).collect()]


TEXTS = ["", "a", "ab", "ABC", "a\nb", "aaaa", "契約", "契約者の", "a😀b😀c", "ÉcOle", "xKſy", "İI", "tab\t \r\nend"]


def grams(t):
    t = text.fold_gram_text(t)
    return {t[i : i + 2] for i in range(len(t) - 1)} | {t[i : i + 3] for i in range(len(t) - 2)}


def test_distinct_ngrams(spark):
    got = values(spark, TEXTS, text.distinct_ngrams("v"))
    assert [set(g) for g in got] == [grams(t) for t in TEXTS]
    assert all(len(g) == len(set(g)) for g in got)
    assert set(values(spark, ["Hello"], text.distinct_ngrams("v"))[0]) == {"he", "el", "ll", "lo", "hel", "ell", "llo"}


def test_query_ngrams(spark):
    assert text.query_ngrams("") == text.query_ngrams("a") == []
    assert text.query_ngrams("AB") == ["ab"] and text.query_ngrams("abc") == ["abc"]
    assert text.query_ngrams("abcd", "契約") == ["abc", "bcd", "契約"]
    assert text.query_ngrams("aaaa") == ["aaa"]
    got = values(spark, TEXTS, text.query_ngrams_col("v"))
    assert [sorted(g) for g in got] == [text.query_ngrams(t) for t in TEXTS]


def test_folding_and_trimming(spark):
    assert values(spark, TEXTS, text.ascii_lower("v")) == [text.ascii_lower_str(t) for t in TEXTS]
    assert text.ascii_lower_str("ÉA") == "Éa"
    assert values(spark, ["a \t\r", "b　ü  ", " c", "\n"], text.trim_end("v")) == ["a", "b　ü", " c", ""]


def test_lines(spark):
    df = spark.createDataFrame([("a\nb\r\n\nc\r\n",), ("x",), ("",)], "text string").coalesce(1)
    plain = [(r.line, r.text) for r in text.split_lines(df).collect()]
    assert plain == [(1, "a"), (2, "b\r"), (3, ""), (4, "c\r"), (5, ""), (1, "x"), (1, "")]
    rx = [(r.line, r.text) for r in text.split_lines(df, regex=True).collect()]
    assert rx == [(1, "a"), (2, "b"), (3, ""), (4, "c"), (1, "x")]


def test_literals(spark):
    cases = {
        "foobar": ["foobar"], "foo.*bar": ["foo", "bar"], "foo_bar": ["foo_bar"], "a.b": [], "x+y": [],
        "ab.cd": ["ab", "cd"], "契約.*者": ["契約"], "a.者.b": [], r"\d{3}": [], "[A-Z]+": [], r"\s+": [],
        r"foo\d+bar": ["foo", "bar"], "FooBar": ["foobar"],
    }
    # the letter of an escape joins the run that follows
    cases[r"\dabc"] = ["dabc"]
    for pattern, want in cases.items():
        assert regex.extract_literals(pattern) == want, pattern
    got = values(spark, list(cases), regex.extract_literals_col("v"))
    assert got == list(cases.values())


@pytest.mark.parametrize(
    "pattern, ignoring, exact",
    [
        ("foo|bar", [], []),
        ("abc*", ["ab"], ["ab"]),
        ("(foo)?bar", ["bar"], ["bar"]),
        ("parse[A-Za-z]+Request", ["parse", "request"], ["parse", "request"]),
        (r"\bfoo", ["foo"], ["foo"]),
        (r"\x41bc", ["bc"], ["bc"]),
        (r"\pLbc", ["bc"], ["bc"]),
        (r"\p{Greek}bc", ["bc"], ["bc"]),
        ("x{10,20}yz", ["yz"], ["yz"]),
        ("(?P<name>ab)cd", ["cd"], ["cd"]),
        ("(?i)École", ["cole"], ["cole"]),
        ("École", ["cole"], ["École"]),
        ("(?x)foo bar", [], []),
        ("(a|b)cd", ["cd"], ["cd"]),
        ("[]ab]cd", ["cd"], ["cd"]),
        ("[^]ab]cd", ["cd"], ["cd"]),
        ("[a[bc]de]fg", ["fg"], ["fg"]),
        (r"foo\.bar", ["foo.bar"], ["foo.bar"]),
        ("fo{0}ob", ["ob"], ["ob"]),
        ("ab+?c", ["ab"], ["ab"]),
        ("契約.*情報", ["契約", "情報"], ["契約", "情報"]),
    ],
)
def test_required_literals(pattern, ignoring, exact):
    assert regex.required_literals(pattern) == ignoring
    assert regex.required_literals(pattern, case_sensitive=True) == exact


def test_required_literals_are_required(spark):
    """Whatever matches holds all grams of the required literals."""
    lines = ["foo", "bar", "foobar", "fobar", "XfooY bar", "abab", "parseHttpRequest", "K kelvin", "ſharp", "ÉCOLE"]
    patterns = ["foo|bar", "fo*bar", "(foo)?bar", "parse[a-z]+request", "a(ba)?b", "kelvin", "k kel", "sharp", "école", "fo{1,2}b"]
    for case in (False, True):
        for p in patterns:
            need = set(text.query_ngrams(*regex.required_literals(p, case)))
            hit = values(spark, lines, F.col("v").rlike(regex.java_regex(p, case)))
            for line, ok in zip(lines, hit):
                assert not ok or need <= grams(line), (p, line)


def test_java_spelling(spark):
    for bad in ("(?=a)b", "(?!a)b", "(?<=a)b", "(?>ab)", r"(a)\1", r"\k<x>", r"\Qab", "a++", r"[a--b]"):
        with pytest.raises(ValueError):
            regex.to_java(bad)
    checks = [
        ("[[:digit:]]x", "5x", True), ("[[:digit:]]x", "٣x", False), (r"\dx", "٣x", True), ("(?-u:x)y", "xy", True),
        (r"\x{41}b", "Ab", True), (r"\u{41}b", "Ab", True), (r"[]a]b", "]b", True), ("(?P<n>a)b", "ab", True),
        ("(?U)a+b", "aab", True), (r"\vb", "\x0bb", True), ("é", "É", True), (r"\p{Greek}b", "αb", True),
        ("a.b", "a b", True), ("ab$", "ab\r", False), ("a{,2}b", "ab", True), (r"foo\b{end}", "foo x", True),
    ]
    for pattern, line, want in checks:
        got = values(spark, [line], F.col("v").rlike(regex.java_regex(pattern)))
        assert got == [want], pattern
    with pytest.raises(ValueError):
        regex.check_java(spark, regex.java_regex("foo("))


def test_quote(spark):
    needles = [r"a.b*c", r"\E\Q", "[x]{2}^$", "a\nb\tc", "#x y-&~", "é(契)"]
    for n in needles:
        assert values(spark, ["<" + n + ">", "none"], F.col("v").rlike("(?i)" + regex.quote(n))) == [True, False]


def test_encodings(spark):
    names = ["Shift_JIS", "SJIS", "cp932", "EUC-JP", "eucjp", "EUC_JP", "utf-8", "latin1", ""]
    want = ["shift_jis"] * 3 + ["euc-jp"] * 3 + ["utf-8"] * 3
    assert values(spark, names, canonical_encoding("v")) == want == [canonical_encoding_str(n) for n in names]
    rows = [
        ("日本".encode("cp932"), "shift_jis"), ("日本".encode("euc_jp"), "euc-jp"), ("日本".encode(), "utf-8"),
        (b"a\xffb", "utf-8"), (b"\xef\xbb\xbfx", "shift_jis"), ("é".encode("utf-16"), "utf-8"), (b"", "utf-8"),
    ]
    got = values(spark, rows, decode_text("c", "e"), "c binary, e string")
    assert got == ["日本", "日本", "日本", "a�b", "x", "é", ""]
    blobs = [b"a" * 8191 + b"\0", b"a" * 8192 + b"\0", b"", b"\x10\x01"]
    assert values(spark, blobs, is_binary("v"), "v binary") == [True, False, False, False]


def test_globs_and_filters(spark):
    assert paths.glob_to_regex("a/**/b*.t?") == r"a\/.*b[^/]*\.t[^/]"
    names = ["src/a/b.ts", "src/b.TS", "lib/x/y.ts", "srcab"]
    def keep(p):
        return [n for n, k in zip(names, values(spark, names, paths.path_matches("v", p))) if k]
    assert keep("src/**/b.ts") == ["src/a/b.ts", "src/b.TS"]
    assert keep("src/*.ts") == ["src/b.TS"]
    assert keep(" LIB ") == ["lib/x/y.ts"]
    assert keep("  ") == names
    assert keep("src??") == ["srcab"]


def test_path_parts(spark):
    rows = ["/r/a/b.txt", "/rx/c.txt", "/r", "plain"]
    assert values(spark, rows, paths.rel_path("v", F.lit("/r"))) == ["a/b.txt", "/rx/c.txt", "/r", "plain"]
    assert values(spark, rows, paths.base_name("v")) == ["b.txt", "c.txt", "r", "plain"]
    assert values(spark, rows, paths.dir_name("v")) == ["/r/a", "/rx", "", ""]
    assert values(spark, rows, paths.ancestors("v"))[0] == ["", "/r", "/r/a"]


def test_roots(spark, tmp_path):
    specs = spark.createDataFrame([("a/b@sjis",), ("a@b@EUCJP",), ("plain",), ("tail@",), ("x@nope",)], "spec string")
    got = [tuple(r) for r in parse_root_specs(specs.coalesce(1)).collect()]
    assert got == [("a/b", "shift_jis"), ("a@b", "euc-jp"), ("plain", "utf-8"), ("tail@", "utf-8"), ("x", "utf-8")]
    settings = tmp_path / "settings.json"
    with pytest.raises(ValueError):
        read_roots(spark, str(settings))
    assert [tuple(r) for r in read_roots(spark, str(settings), strict=False).collect()] == [(".", "utf-8", 0)]
    settings.write_text('{"roots": [{"path": "src"}, {"path": "/abs", "encoding": "SJIS"}]}')
    roots = read_roots(spark, str(settings))
    assert resolve_roots(roots, str(tmp_path)) == [(str((tmp_path / "src").resolve()), "utf-8"), ("/abs", "shift_jis")]
    files = spark.createDataFrame([("/a/b/x",), ("/ab/x",), ("/a/y",)], "path string")
    table = spark.createDataFrame([("/a", "one", 0), ("/a/b", "two", 1), ("/a", "three", 2)], "path string, encoding string, seq int")
    assert {(r.path, r.root, r.enc) for r in assign_root(files, table).collect()} == {("/a/b/x", "/a", "three"), ("/a/y", "/a", "three")}


def test_ignore_rules():
    def hit(rule, path):
        return re.search(parse_rule(rule).regex.replace("\\/", "/"), path) is not None

    assert parse_rule("") is None and parse_rule("# c") is None and parse_rule("   ") is None
    assert parse_rule("!keep").negated and parse_rule("dir/").dir_only
    assert hit("*.log", "a/b.log") and hit("*.log", "b.log") and not hit("*.log", "b.logs")
    assert hit("/top", "top") and not hit("/top", "a/top") and hit("a/b", "a/b") and not hit("a/b", "x/a/b")
    assert hit("a/**/b", "a/b") and hit("a/**/b", "a/x/y/b") and hit("**/b", "b") and hit("a/**", "a/x") and not hit("a/**", "a")
    assert hit("[!a].c", "b.c") and not hit("[!a].c", "a.c") and hit("[a-c]?", "bz") and hit(r"\#x", "#x")


def test_marks(spark):
    def spans(t, q, **kw):
        return [(r.start, r.end) for r in values(spark, [t], marks.match_ranges("v", q, **kw))[0]]

    assert spans("foo Foo foo", "FOO") == [(0, 3), (4, 7), (8, 11)]
    assert spans("foo Foo", "Foo", case_sensitive=True) == [(4, 7)]
    assert spans("aaaa", "aa") == [(0, 2), (2, 4)]
    assert spans("ÉcoLE x", "école") == [(0, 5)]
    assert spans("x1 y22", r"\d+", regex=True) == [(1, 2), (4, 6)]
    assert spans("xaay", "a*", regex=True) == [(1, 3)]
    assert spans("abc", "(", regex=True) == []
    assert spans("abc", "") == [] and spans("abc", "(?=a)", regex=True) == []
    assert spans("$1 \\ $1", "$1") == [(0, 2), (5, 7)]
    assert len(spans("a" * 500, "a")) == 201
    assert values(spark, ["xxfoo", "none"], marks.first_column("v", "foo")) == [2, 0]
    html = values(spark, ['<a href="x">&foo</a>'], marks.highlight("v", "FOO"))
    assert html == ['&lt;a href=&quot;x&quot;&gt;&amp;<span class="hl">foo</span>&lt;/a&gt;']
    assert values(spark, ["a<b"], marks.highlight("v", "zz")) == ["a&lt;b"]


def test_nested_repeats():
    from gramlode.functions.regex import nested_repeats
    from gramlode.plans.search import compile_query

    for pattern in ("(a+)+", "(?:ab*c)*x", "((a+)b){2,}", "(?i:x*)*"):
        assert nested_repeats(pattern), pattern
    for pattern in ("a+b+", "(ab)+", "(a+)?", "(a+){3}", "[(a+)+]", r"\(a+\)+", "(a?)+"):
        assert not nested_repeats(pattern), pattern
    with pytest.raises(ValueError):
        compile_query("(needle+)+", regex=True, allow_nested=False)
