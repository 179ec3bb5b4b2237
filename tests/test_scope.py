import os

import pytest

from notelake.sources import ignore
from notelake.sources.registry import Registry, installed, sources_of
from notelake.sources.scope import Config, ConfigError, Scope, inside, scope_summary
from notelake.sources import vault as V

def put(root, files):
    for rel, body in files.items():
        path = os.path.join(root, rel)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(body)

def keys(root, **config):
    return Scope(root, Config(**config)).keys()

def test_names(tmp_path):
    put(tmp_path, {"a.md": "", "b.MD": "", ".md": "", "c.txt": "", ".h/x.md": "", ".x.md": "", "_u/_y.md": "", "d.md.bak": ""})
    os.symlink(tmp_path / "a.md", tmp_path / "link.md")
    assert keys(tmp_path) == ["_u/_y.md", "a.md"]

def test_ignore_files(tmp_path):
    put(tmp_path, {".gitignore": "drafts/\n*.tmp.md\n!keep.tmp.md\n/only.md\n", "drafts/a.md": "", "x/drafts/b.md": "", "a.tmp.md": "", "keep.tmp.md": "", "only.md": "", "x/only.md": ""})
    assert keys(tmp_path) == ["keep.tmp.md", "x/only.md"]
    assert len(keys(tmp_path, follow_gitignore=False)) == 6
    put(tmp_path, {".vaultignore": "!only.md\nx/\n"})
    assert keys(tmp_path) == ["keep.tmp.md", "only.md"]

def test_nested_ignore_and_excluded_parent(tmp_path):
    put(tmp_path, {"x/.gitignore": "a.md\n", "x/a.md": "", "a.md": "", ".gitignore": "build/\n!build/keep.md\n", "build/keep.md": ""})
    assert keys(tmp_path) == ["a.md"]

def test_exclude_depth_dir(tmp_path):
    put(tmp_path, {"docs/a.md": "", "docs/x/b.md": "", "docs/x/y/c.md": "", "top.md": ""})
    assert keys(tmp_path, notes_dir="docs") == ["docs/a.md", "docs/x/b.md", "docs/x/y/c.md"]
    assert keys(tmp_path, notes_dir="docs", max_depth=1) == ["docs/a.md"]
    assert keys(tmp_path, notes_dir="docs", max_depth=2) == ["docs/a.md", "docs/x/b.md"]
    assert keys(tmp_path, notes_dir="./docs/", exclude=("x/y/",)) == ["docs/a.md", "docs/x/b.md"]
    assert keys(tmp_path, exclude=("*.md",)) == []

def test_dependencies_and_includes(tmp_path):
    put(tmp_path, {"n.md": "", "node_modules/p/README.md": "", "node_modules/p/docs/g.md": "", "node_modules/p/docs/.h.md": "", "vendor.md": "", ".gitignore": "node_modules\n"})
    assert keys(tmp_path) == ["n.md", "vendor.md"]
    s = Scope(tmp_path, Config(include=("node_modules/p/docs", "gone")))
    assert s.keys() == ["n.md", "node_modules/p/docs/g.md", "vendor.md"]
    assert [n.key for n in s.notes() if n.reference] == ["node_modules/p/docs/g.md"] and s.missing_includes() == ["gone"]
    a = s.audit()
    assert (a.included, a.reference, a.skipped, a.skipped_dependency, a.skipped_by_dir, a.truncated) == (3, 1, 1, 1, [("node_modules", 1)], False)
    assert s.audit(limit=2).truncated and "at least" in scope_summary(s.audit(limit=2))
    assert s.may_include("node_modules/p/docs/new.md") and not s.may_include("node_modules/p/new.md") and not s.may_include("a/.h/x.md") and not s.may_include("x.txt")
    assert [os.path.relpath(t, tmp_path) for t in s.watch_targets()] == [".", "node_modules/p/docs"]
    top = tmp_path / "vendor"
    put(top, {"a.md": ""})
    assert keys(top) == ["a.md"]

def test_include_inside_the_scan_is_listed_once(spark, tmp_path):
    put(tmp_path, {"lib/a.md": "one", "b.md": "two", "lib/in/c.md": "", "vault.toml": '[scope]\ninclude = ["lib", "lib/in"]\n'})
    assert Scope(tmp_path).keys() == ["b.md", "lib/a.md", "lib/in/c.md"]
    got = V.read_vaults(spark, {"v": str(tmp_path)}).select("key", "reference", "body", "title").collect()
    assert sorted(map(tuple, got)) == [("b.md", False, "two", "b"), ("lib/a.md", True, "one", "a"), ("lib/in/c.md", True, "", "c")]

@pytest.mark.parametrize("text", ["[vault]\nnme = 'x'", "[scop]\n", "x = 1", "not toml", "[scope]\nmax_depth = 'a'", "[scope]\nmax_depth = -1", "[scope]\nexclude = 'a'", "vault = 3"])
def test_bad_config(text):
    with pytest.raises(ConfigError):
        Config.parse(text)

@pytest.mark.parametrize("path", ["", "/abs", "../x", "a/../b", "a//b", "C:/x", "."])
def test_paths_stay_inside(path):
    with pytest.raises(ConfigError):
        inside(path, "x")

def test_exclude_may_not_negate(tmp_path):
    with pytest.raises(ConfigError):
        Scope(tmp_path, Config(exclude=("!a",)))
    assert Config.load(tmp_path) == Config()

@pytest.mark.parametrize(
    "line, path, is_dir, hit",
    [("*.md", "a/b.md", False, True), ("/a", "x/a", True, False), ("a/", "a", False, False), ("a/", "x/a", True, True), ("a/**/b", "a/x/y/b", False, True), ("**/c", "c", False, True), ("d/**", "d/e/f", False, True), ("d/**", "d", True, False), ("[ab].md", "b.md", False, True), ("[!ab].md", "b.md", False, False), ("a?c", "abc", False, True), ("\\#x", "#x", False, True), ("x/y", "z/x/y", False, False)],
)
def test_patterns(line, path, is_dir, hit):
    assert ignore.parse_line(line).matches(path, is_dir) is hit

def test_no_rule_in_comments():
    assert ignore.parse("# c\n\n   \n!x\n") [0].negated and ignore.parse_line("# c") is None

def test_data_source(spark, tmp_path):
    put(tmp_path, {"A.md": "a", "x/_u.md": "b", "ก/โน้ต.md": "ไทย", "sp ace/%20.md": ""})
    df = V.read_vaults(spark, {"v": str(tmp_path)})
    assert sorted(r["key"] for r in df.collect()) == sorted(["A.md", "x/_u.md", "ก/โน้ต.md", "sp ace/%20.md"])
    assert df.where("key = 'A.md'").select("hash", "body").collect()[0] == (V.content_hash("a"), "a")
    assert V.read_vaults(spark, {"v": str(tmp_path)}, bodies=False).columns == ["vault", "key", "title", "reference", "mtime_ns"]

def test_one_note(tmp_path):
    root = str(tmp_path)
    put(tmp_path, {"vault.toml": '[scope]\ninclude = ["lib"]\n', "lib/r.md": "r"})
    assert V.create_note(root, "New") == "New.md" and V.get_note(root, "New.md") == ("# New\n\n", "New", False)
    with pytest.raises(V.NoteError):
        V.create_note(root, "New")
    assert V.put_note(root, "a/b.md", "x") is True and V.put_note(root, "vendor/b.md", "x") is False
    for key in ("lib/r.md", "../x.md", "a.txt", ""):
        with pytest.raises(V.NoteError):
            V.put_note(root, key, "x")
    os.symlink("/tmp", tmp_path / "out")
    with pytest.raises(V.NoteError):
        V.resolve_key(root, "out/x.md")
    V.delete_note(root, "New.md")
    with pytest.raises(V.NoteError):
        V.get_note(root, "New.md")

def test_registry(spark, tmp_path):
    r = Registry(tmp_path / "conf" / "v.json")
    (tmp_path / "b").mkdir(), (tmp_path / "a").mkdir()
    r.add("b", tmp_path / "b"), r.add("a", tmp_path / "a")
    assert list(r.list()) == ["a", "b"] and r.name_of(tmp_path / "b") == "b" and r.get("zz") is None
    for name, root in (("a", tmp_path / "a"), ("x/y", tmp_path / "a"), ("", tmp_path / "a"), ("c", tmp_path / "none")):
        with pytest.raises(ConfigError):
            r.add(name, root)
    assert r.remove("a") and not r.remove("a") and r.table(spark).count() == 1

def test_sources(tmp_path):
    put(tmp_path, {"vendor/h/vault.toml": "[vault]\nname = 'Hand'\nlicense = 'MIT'\n", "vendor/bad/vault.toml": "nonsense", "vendor/h/.git/config": ""})
    s = Scope(tmp_path, Config(include=("vendor/h", "vendor/bad", "vendor/none")))
    assert [(x[1], x[3], x[4]) for x in sources_of("v", s)] == [("vendor/h", "Hand", "MIT"), ("vendor/bad", "bad", None)]
    assert installed(s) == ["vendor/h"]
