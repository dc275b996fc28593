"""End to end on small trees: write files, build, search."""

import pytest

from gramlode.constants import CANDIDATE_LIMIT


def test_substring_case(tree):
    t = tree()
    t.write("a.ts", "function calculateTotal(x, y) {}")
    t.build()
    for q in ("calculateTotal", "calculatetotal", "CALCULATETOTAL"):
        assert t.lines(q) == [("a.ts", 1)]
    assert t.lines("calculateTotal", case_sensitive=True) == [("a.ts", 1)]
    assert t.lines("CALCULATETOTAL", case_sensitive=True) == []
    assert t.lines("c") == [] and t.lines("") == []
    assert t.lines("missing") == []
    assert t.lines("ca") == [("a.ts", 1)] and t.lines("cal") == [("a.ts", 1)]


def test_only_ascii_folds(tree):
    t = tree()
    t.write("a.txt", "École ÀB\nécole àb")
    t.build()
    assert t.lines("École") == [("a.txt", 1)]
    assert t.lines("éCOLE") == [("a.txt", 2)]
    assert t.lines("école", regex=True) == [("a.txt", 1), ("a.txt", 2)]
    assert t.lines("école", regex=True, case_sensitive=True) == [("a.txt", 2)]


def test_lines(tree):
    t = tree()
    t.write("a.txt", "TARGET one\nother\nTARGET two\n")
    t.write("b.txt", "foo foo foo\n")
    t.write("c.txt", "first\r\nMARKED\r\nthird\r\n")
    t.write("d.txt", "x\nspan one\ntwo span\nspan one\ntwo\nspan one")
    t.write("e.txt", "ab　 \t\nend\n\n")
    t.build()
    assert t.lines("target") == [("a.txt", 1), ("a.txt", 3)]
    assert t.lines("foo") == [("b.txt", 1)]
    assert t.hits("MARKED") == [("c.txt", 2, "MARKED")]
    assert t.hits("marked$", regex=True) == [("c.txt", 2, "MARKED")]
    assert t.hits("ONE\ntwo") == [("d.txt", 2, "span one"), ("d.txt", 4, "span one")]
    assert t.hits("ONE\ntwo", case_sensitive=True) == []
    assert t.hits("one\ntwo", per_file=1) == [("d.txt", 2, "span one")]
    assert t.hits("ab") == [("e.txt", 1, "ab")]


def test_encodings(tree):
    t = tree({"u": "utf-8", "s": "sjis", "e": "EUC_JP"}, store_text=False)
    t.write("u/a.txt", "def calculate_total():\n  保険契約の状態区分\n")
    t.write("u/bom.txt", b"\xef\xbb\xbfbommed start")
    t.write("s/b.txt", "検索テスト用ファイル\nマッチすべき行\n計算処理\n".encode("cp932"))
    t.write("s/bad.txt", b"valid start \xff\xff\n" + "続き行".encode("cp932"))
    t.write("e/c.txt", "データ処理プログラム\n結果を出力する\n".encode("euc_jp"))
    t.build()
    assert t.lines("calculate_total") == [("u/a.txt", 1)]
    assert t.lines("契約") == [("u/a.txt", 2)]
    assert t.lines("契約.*区分", regex=True) == [("u/a.txt", 2)]
    assert t.hits("^bommed", regex=True) == [("u/bom.txt", 1, "bommed start")]
    assert t.lines("マッチすべき") == [("s/b.txt", 2)]
    assert t.lines("計算") == [("s/b.txt", 3)]
    assert t.lines("続き行") == [("s/bad.txt", 2)]
    assert t.lines("valid start �") == [("s/bad.txt", 1)]
    assert t.lines("データ処理") == [("e/c.txt", 1)]


def test_regex(tree):
    t = tree()
    t.write("a.txt", "calculateTotal(100)\n")
    t.write("b.txt", "foo123bar\n")
    t.write("c.txt", "only foo here\nonly bar here\n")
    t.write("d.txt", "parseHttpRequest and x٣y\n")
    t.build()
    assert t.lines("calc.*total", regex=True) == [("a.txt", 1)]
    assert t.lines("calc.*total", regex=True, case_sensitive=True) == []
    assert t.lines(r"foo\d+bar", regex=True) == [("b.txt", 1)]
    assert sorted(t.lines("foo|bar", regex=True)) == [("b.txt", 1), ("c.txt", 1), ("c.txt", 2)]
    assert t.lines("foo|bar", regex=True, prefilter="compat") == [("b.txt", 1), ("c.txt", 1), ("c.txt", 2)]
    assert t.lines("only|zzz", regex=True, prefilter="compat") == []
    assert t.lines("only|zzz", regex=True) == [("c.txt", 1), ("c.txt", 2)]
    assert t.lines("parse[A-Za-z]+Request", regex=True) == [("d.txt", 1)]
    assert t.lines("parse[A-Za-z]+Request", regex=True, prefilter="compat") == []
    assert t.lines(r"and x\dy", regex=True) == [("d.txt", 1)]
    for bad in (r"\d{3}", "[A-Z]+", "a.b"):
        with pytest.raises(ValueError):
            t.hits(bad, regex=True)
    for bad in ("foo(", "(?=foo)bar", r"(foo)\1", "[foo"):
        with pytest.raises(ValueError):
            t.hits(bad, regex=True)
    assert sorted(t.lines(r"\d{3}", regex=True, allow_scan=True)) == [("a.txt", 1), ("b.txt", 1)]


def test_caps_and_order(tree):
    t = tree()
    t.write("big.txt", "".join(f"TARGET line {i}\n" for i in range(60)))
    for i in range(20):
        t.write(f"f{i:02}.txt", "TARGET" + "x" * 0)
    t.build()
    found = t.lines("TARGET", max_results=None)
    assert sum(f == "big.txt" for f, _ in found) == 50
    assert [n for f, n in found if f == "big.txt"] == list(range(1, 51))
    assert found[:20] == [(f"f{i:02}.txt", 1) for i in range(20)]
    assert len(t.lines("TARGET", max_results=None, per_file=None)) == 80
    assert t.lines("TARGET", max_results=5) == found[:5]
    assert t.lines("TARGET", max_results=0) == []
    assert t.lines("TARGET", candidate_limit=20, max_results=None) == found[:20]


def test_candidates_truncated(tree):
    from gramlode import search

    t = tree(store_text=True)
    for i in range(3):
        t.write(f"f{i}.txt", f"needle {i}")
    t.build()
    assert search(t.index, "needle", candidate_limit=3).candidates_truncated
    assert not search(t.index, "needle", candidate_limit=4).candidates_truncated
    assert not search(t.index, "needle", candidate_limit=CANDIDATE_LIMIT).candidates_truncated
    out = search(t.index, "needle", candidate_limit=2)
    assert tuple(out.summary().first()) == (2, 2, True)


def test_what_is_indexed(tree):
    t = tree()
    t.write(".ignore", "ignored.txt\nskip/\n*.log\n!keep.log\n/top.md\n")
    for name in ("ignored.txt", "skip/x.txt", "a.log", "keep.log", "top.md", "sub/top.md", "sub/ignored.txt"):
        t.write(name, "TARGET")
    t.write("sub/.ignore", "!ignored.txt\n")
    t.write(".env", "TARGET")
    t.write(".hidden/a.txt", "TARGET")
    t.write("_kept/_a.py", "TARGET")
    t.write("__init__.py", "TARGET")
    t.write("bin.dat", b"TARGET\x00rest")
    t.write("late.dat", b"TARGET" + b"a" * 8186 + b"\x00")
    t.write("edge.dat", b"TARGET" + b"a" * 8185 + b"\x00")
    t.write("huge.txt", "TARGET" + "A" * 1_999_995)
    t.write("limit.txt", "TARGET" + "A" * 1_999_994)
    t.write(".gitignore", "nogit.txt\n")
    t.write("nogit.txt", "TARGET")
    t.build()
    assert {f for f, _ in t.lines("TARGET")} == {
        "keep.log", "sub/top.md", "sub/ignored.txt", "_kept/_a.py", "__init__.py", "late.dat", "limit.txt",
        "nogit.txt",
    }


def test_gitignore_inside_repository(tree):
    t = tree()
    (t.folder / ".git" / "info").mkdir(parents=True)
    t.write(".git/info/exclude", "private.txt\n")
    t.write(".gitignore", "build\n**/gen/*.c\ndocs/**/x.md\n[ab].txt\n")
    (t.folder / "nested" / ".git").mkdir(parents=True)
    t.write("nested/a.txt", "TARGET")
    t.write("nested/own.txt", "TARGET")
    t.write("nested/.gitignore", "own.txt\n")
    for name in ("private.txt", "build/a.txt", "m/build/b.txt", "m/gen/c.c", "m/gen/d/c.c", "docs/x.md",
                 "docs/p/q/x.md", "a.txt", "c.txt"):
        t.write(name, "TARGET")
    t.build()
    assert {f for f, _ in t.lines("TARGET")} == {"m/gen/d/c.c", "c.txt", "nested/a.txt"}


def test_overlapping_roots_last_wins(tree):
    t = tree({"": "utf-8", "s": "shift_jis"})
    t.write("s/b.txt", "計算処理".encode("cp932"))
    t.write("sx/c.txt", "計算処理")
    t.build()
    assert sorted(t.lines("計算")) == [("s/b.txt", 1), ("sx/c.txt", 1)]
    rows = {(r.path.rsplit("/", 1)[1], r.enc) for r in t.index.files().collect()}
    assert rows == {("b.txt", "shift_jis"), ("c.txt", "utf-8")}
