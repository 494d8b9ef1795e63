from pyspark.sql import functions as F

from bindery.functions import paths

X = F.col("x")


def check(evaluate, column, cases):
    assert evaluate(column, list(cases)) == list(cases.values())


def test_extension(evaluate):
    check(evaluate, paths.extension(paths.base_name(X)), {
        ".bashrc": "", "a.tar.gz": ".gz", "a.": ".", "d.x/Makefile": "", "A.C": ".C", "x": "",
        "": "", "..a": ".a",
    })


def test_names(evaluate):
    check(evaluate, paths.base_name(X), {"a/b/c.txt": "c.txt", "c": "c", "/c": "c"})
    check(evaluate, paths.parent(X), {"a/b/c.txt": "a/b", "c": "", "/c": "", "é/日/c": "é/日"})


def test_types():
    assert paths.parse_types(" c, .md,,txt") == [".c", ".md", ".txt"]
    assert paths.parse_types(["c", ".c", " "]) == [".c"]
    assert paths.parse_types("") == []


def test_type_list(evaluate):
    check(evaluate, paths.type_list(X), {" c, .md,,txt": [".c", ".md", ".txt"], "": [], "c,.c": [".c"]})


def test_hidden_tree(evaluate):
    check(evaluate, paths.in_hidden_tree(X), {
        "a/b": False, ".a/b": True, "a/.b/c": True, "a/b.c": False, "a/.c": True,
    })


def test_repo_urls(evaluate):
    check(evaluate, paths.is_repo_url(X), {
        "http://a/b": True, "https://a": True, "git://a": True, "ssh://a": True, "git@a:b": True,
        "ftp://a": False, "/srv/http://": False, "GIT@a": False,
    })


def test_repo_name(evaluate):
    check(evaluate, paths.repo_name(X), {
        "git@host:owner/r.git": "r", "https://host/o/r.git": "r", "https://host/o/r": "r",
        "https://host/o/r.git.git": "r", "https://host/o/r/": "", "git@host:r": "r",
        "git@host/owner/r.git": "r", "git@host:a/b:c/d": "b",
    })


def test_safe_path(evaluate):
    check(evaluate, paths.is_safe_path(X), {
        "a/b": True, "/a": False, "../a": False, "a/..": False, "a/../b": False, "a/..b": True,
        "": False, "  ": False, "a\0b": False, "..": False, "a b": True, "...": True,
    })


def test_relative_path(evaluate):
    check(evaluate, paths.relative_path(X, "src/"), {"src/a": "a", "a/src/": "a/src/"})


def test_bundle_name(evaluate):
    assert evaluate(paths.bundle_name(X, F.lit(17)), ["n"]) == ["n_17.txt"]
