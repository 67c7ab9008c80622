"""The engine's own operators: configuration, globs, Python front end, plans, reports."""

import json
import textwrap

import pytest

from dupeloom.cli import main
from dupeloom.config import Config, ConfigError, ScanConfig, from_mapping, load_config
from dupeloom.functions.globs import glob_to_regex
from dupeloom.operators.pairs import band_shape
from dupeloom.operators.templates import generalise, hole_kind, holes_of, judge, render
from dupeloom.plans.scan import scan
from dupeloom.report import format_json, format_sarif, format_text
from dupeloom.sources.files import discover_files, read_focus_list
from dupeloom.sources.pyast import fragments_of, packed_tree

FIRST = '''
def gather(rows, limit):
    """Collect."""
    kept = []
    for row in rows:
        if row.size > limit:
            kept.append(row.name)
        else:
            log(row.name, "small")
    kept.sort()
    total = len(kept)
    report(total)
    flush(kept)
    return kept, total
'''
RENAMED = FIRST.replace("gather", "collect").replace("kept", "chosen").replace("rows", "items").replace("row", "item").replace("# ", "#").replace('"""Collect."""', "# other words")
NEAR = FIRST.replace("gather", "nearly").replace("    report(total)\n", "    report(total)\n    notify(total, rows)\n")
OTHER = '''
def walk(tree):
    while tree:
        left, right = tree.split()
        if left is None:
            return right
        tree = left
    raise ValueError(tree)
'''


def tree(tmp_path, **files):
    for name, text in files.items():
        path = tmp_path / name.replace("__", "/")
        path = path.with_name(path.name + ".py")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return tmp_path


def found(source, **settings):
    config = Config()
    for section, values in settings.items():
        config = config.with_settings(section, **values)
    return fragments_of("x.py", source.encode(), config)


def test_floors_and_their_alias():
    assert (ScanConfig().exact_floor, ScanConfig().similar_floor, ScanConfig().extraction_floor) == (5, 9, 5)
    assert ScanConfig(min_lines=7).exact_floor == ScanConfig(min_lines=7).similar_floor == 7
    with pytest.raises(ConfigError):
        Config(scan=ScanConfig(exact_min_lines=9, similar_min_lines=5)).validate()
    with pytest.raises(ConfigError):
        Config(scan=ScanConfig(exact_min_stmts=0)).validate()
    assert from_mapping({"scan": {"threshold": 0.7, "unknown": 1}}).scan.threshold == 0.7


def test_own_settings_come_before_the_projects(tmp_path):
    (tmp_path / "pyproject.toml").write_text("[tool.dupeloom.scan]\nthreshold = 0.5\n")
    assert load_config(tmp_path).scan.threshold == 0.5
    (tmp_path / "dupeloom.toml").write_text("[scan]\nthreshold = 0.6\nexclude = ['a/**']\n")
    assert load_config(tmp_path).scan.threshold == 0.6 and load_config(tmp_path).scan.exclude == ("a/**",)


@pytest.mark.parametrize(
    ("glob", "path", "hit"),
    [("**/*.py", "a.py", 1), ("**/*.py", "x/y/a.py", 1), ("tests/", "tests/a.py", 0), ("tests/**", "tests/x/a.py", 1), ("*.py", "x/a.py", 0), ("**/test_?.py", "q/test_a.py", 1), ("a[bc].py", "ab.py", 1), ("{a,b}/**", "b/c", 1), ("a.py", "axpy", 0)],
)
def test_globs(glob, path, hit):
    import re

    assert bool(re.match(glob_to_regex(glob), path)) == bool(hit)


def test_discovery_respects_ignore_files(tmp_path):
    tree(tmp_path, a="x", tests__test_a="x", build__b="x", keep__c="x")
    (tmp_path / ".gitignore").write_text("build/\n*.tmp.py\n")
    assert [p.removeprefix(str(tmp_path)) for p in discover_files(tmp_path)] == ["/a.py", "/keep/c.py"]
    assert [p.removeprefix(str(tmp_path)) for p in discover_files(tmp_path, ScanConfig().scoped_to_tests())] == ["/tests/test_a.py"]
    (tmp_path / "list").write_bytes(b"\xef\xbb\xbfa.py\r\n\r\n  b.py \n")
    assert read_focus_list(str(tmp_path / "list")) == ["a.py", "b.py"]


def test_names_prose_and_operators_leave_no_trace():
    _, (a,) = found(FIRST)
    _, (b,) = found(RENAMED)
    _, (c,) = found(FIRST.replace(">", "<=").replace("limit):", "limit):  # why"))
    assert a["root_hash"] == b["root_hash"] == c["root_hash"]
    assert a["exec_lines"] == 11 and a["exec_stmts"] == 7 and a["n"] > 10
    assert found(FIRST.replace('"small"', '"large"'))[1][0]["root_hash"] != a["root_hash"]
    same = {"normalization": {"anonymize_literals": True}}
    assert found(FIRST.replace('"small"', '"large"'), **same)[1][0]["root_hash"] == found(FIRST, **same)[1][0]["root_hash"]


def test_measures():
    source = "def f(a,\n      b):\n    x = [\n        a,\n    ]\n    try:\n        pass\n    finally:\n        y = '''\n1\n'''\n    return x\n"
    _, (f,) = found(source, scan={"min_lines": 1})
    # lone brackets and the words that open a block do not count; a text of three lines counts three
    assert f["exec_lines"] == 9 and f["exec_stmts"] == 3
    assert found("def g(): ...\n", scan={"min_lines": 1})[1][0]["has_body"] is False
    assert found("def g():\n    'doc'\n", scan={"min_lines": 1})[1][0]["exec_stmts"] == 0


def test_every_definition_is_found_once_and_broken_files_give_what_parses():
    source = "class K:\n    @mark\n    def a(self):\n        def inner():\n            return 1\n        return inner\n\ndef b():\n    return 2\n"
    one = {"scan": {"min_lines": 1}}
    assert [(f["name"], f["start_line"]) for f in found(source, **one)[1]] == [("a", 1), ("inner", 3), ("b", 7)]
    assert [f["name"] for f in found(source + "\n)))\n", **one)[1]] == ["a", "inner", "b"]
    assert found("\x00\xff((", **one) == ("ok", []) and found("", **one) == ("ok", [])


def test_directives():
    assert found("# dupeloom: ignore-file\n" + FIRST) == ("file_comment", [])
    assert found("#\n" * 5 + "# dupeloom: ignore-file\n" + FIRST)[0] == "ok"
    assert found(FIRST.replace("    kept.sort()", "    # dupeloom: ignore -- why\n    kept.sort()"))[1][0]["status"] == "inline"
    assert found("# dupeloom: ignore\n" + FIRST.lstrip())[1][0]["status"] == "inline"
    assert found(FIRST, suppress={"directive": "other"})[1][0]["status"] == "ok"


def test_scan_of_renamed_near_and_other_functions(spark, tmp_path):
    root = tree(tmp_path, a=FIRST, b=RENAMED, c=NEAR, d=OTHER)
    report = scan(spark, root)
    rows = report.pairs.orderBy("left_id", "right_id").collect()
    names = {r.frag_id: r.name for r in report.fragments.collect()}
    assert sorted(names.values()) == ["collect", "gather", "nearly", "walk"]
    assert [(names[r.left_id], names[r.right_id], r.tier) for r in rows][0] == ("gather", "collect", "exact")
    assert rows[0].similarity == 1.0
    loose = scan(spark, root, Config().with_settings("scan", threshold=0.5))
    scores = {(names2(loose)[r.left_id], names2(loose)[r.right_id]): r for r in loose.pairs.collect()}
    assert scores["gather", "nearly"].tier == "similar" and 0.5 <= scores["gather", "nearly"].similarity < 1
    assert loose.clusters.first().size == 3 and loose.clusters.first().tier == "similar"
    minhash = scan(spark, root, Config().with_settings("scan", threshold=0.5), method="minhash")
    assert {(r.left_id, r.right_id, r.similarity) for r in minhash.pairs.collect()} <= {(r.left_id, r.right_id, r.similarity) for r in loose.pairs.collect()}
    focused = scan(spark, root, focus=[str(root / "d.py")])
    assert focused.pairs.isEmpty() and focused.fragments.count() == 4
    assert scan(spark, root, focus=[]).pairs.isEmpty()
    assert scan(spark, root, focus=[str(root / "a.py"), "missing.py"]).pairs.count() == 1


def names2(report):
    return {r.frag_id: r.name for r in report.fragments.select("frag_id", "name").collect()}


SUPER = FIRST.replace("gather", "more").replace("    return kept, total\n", "    for k in kept:\n        show(k)\n    close(total)\n    x = total + 1\n    y = x * 2\n    publish(x, y)\n    archive(kept, y)\n    return kept, total, x, y\n")
PART = FIRST.replace("    return kept, total\n", "")


def test_containment_of_a_leading_run(spark, tmp_path):
    root = tree(tmp_path, a=PART, b=SUPER)
    config = Config().with_settings("containment", enabled=True, min_fragment_lines=8)
    report = scan(spark, root, config)
    names = names2(report)
    (f,) = report.containments.collect()
    assert (names[f.contained_id], names[f.container_id], f.role, f.statement_count, f.tier, f.score) == ("gather", "more", "prefix", 6, "exact", 1.0)
    assert (f.start_line, f.end_line) == (3, 12)
    assert report.pairs.isEmpty()
    for guard in ({"min_fragment_lines": 40}, {"max_run_fraction": 0.3}, {"min_ratio": 0.99}):
        assert scan(spark, root, config.with_settings("containment", **guard)).containments.isEmpty()
    nested = tree(tmp_path / "n", a="def outer():\n" + textwrap.indent(PART, "    ") + "    return gather\n")
    assert scan(spark, nested, config).containments.isEmpty()


def test_tiers_are_refused_by_the_named_guard_alone(spark, tmp_path):
    short = "def {0}(a):\n    b = first(a)\n    c = second(b)\n    return c, b\n"
    root = tree(tmp_path, a=short.format("p"), b=short.format("q"))
    assert scan(spark, root).fragments.isEmpty()
    four = Config().with_settings("scan", exact_min_lines=4)
    assert scan(spark, root, four).pairs.first().tier == "exact"
    assert scan(spark, root, four.with_settings("scan", exact_min_stmts=4)).pairs.isEmpty()
    assert scan(spark, root, four.with_settings("scan", exact_min_stmts=4, similar_min_lines=4)).pairs.first().tier == "similar"


def test_templates():
    a, b = ([packed_tree(f["tree"]) for f in found(s)[1]][0] for s in (FIRST, FIRST.replace('"small"', '"large"').replace("    flush(kept)\n", "")))
    template = generalise(a, b)
    kinds = [h.kind for h in holes_of(template)]
    assert kinds[0] == "literal" and "optional" in kinds
    settings = Config().suggest
    quality = judge(template, a, b, settings)
    assert quality.hole_count == len(kinds) and 0 < quality.score < 1
    text = render(template, FIRST[1:].encode(), 1)
    assert 'log(row.name, $HOLE_0)' in text and '\n# $HOLE_0, literal: "small" | "large"' in text and "nothing" not in text.split("# $HOLE_0")[0]
    assert text.startswith("def gather(rows, limit):") and "optional: a return | nothing" in text
    assert not list(holes_of(generalise(a, a))) and judge(generalise(a, a), a, a, settings).score == 1
    node = lambda kind: [kind, None, 0, 0, []]
    assert [hole_kind(node(x), node(y)) for x, y in (("identifier", "identifier"), ("integer", "string"), ("call", "call"), ("if_statement", "block"), ("call", "list"))] == ["name", "literal", "call", "statements", "expression"]


def test_reports_and_command_line(spark, tmp_path, capsys):
    root = tree(tmp_path, a=FIRST, b=RENAMED, d=OTHER, e="# dupeloom: ignore-file\n" + FIRST)
    report = scan(spark, root, Config().with_settings("suggest", enabled=True))
    data = json.loads(format_json(report))
    assert data["schema_version"] == 3 and data["suppressed"]["file_comments"] == 1 and "containments" not in data
    (cluster,) = data["clusters"]
    assert cluster["tier"] == "exact" and [f["start_line"] for f in cluster["functions"]] == [2, 2] and "source" in cluster["functions"][0]
    assert data["suggestions"][0]["pair_index"] == 0 and data["suggestions"][0]["quality_score"] == 1.0
    sarif = json.loads(format_sarif(report))
    (result,) = sarif["runs"][0]["results"]
    assert sarif["version"] == "2.1.0" and len(result["relatedLocations"]) == 1
    assert "Cluster 1: 2 functions, similarity 1.00 (exact)" in format_text(report)
    assert main(["scan", str(root), "--format", "json"], spark) == 1
    assert json.loads(capsys.readouterr().out)["clusters"]
    assert main(["scan", str(root), "--focus", str(root / "d.py")], spark) == 0
    assert main(["scan", str(root), "--suggest", "--save", str(tmp_path / "out")], spark) == 1
    assert {p.name: spark.read.parquet(str(p)).count() for p in (tmp_path / "out").iterdir()} == {"files": 4, "functions": 3, "members": 2, "clusters": 1, "pairs": 1, "suggestions": 1}
    assert capsys.readouterr().out
    assert main(["overview", str(root)], spark) == 0 and "gather (lines 2-14): like collect" in capsys.readouterr().out
    assert main(["stats", str(root), "--format", "json"], spark) == 0
    assert json.loads(capsys.readouterr().out)["clone_pairs"] == 1
    assert main(["scan", str(root), "--exact-min-lines", "10", "--similar-min-lines", "5"], spark) == 2
    assert main(["scan", str(root / "none")], spark) == 2 and main(["guide", "triage"]) == 0


def test_guide_and_completions(tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "tox.ini").write_text("")
    assert main(["guide"]) == 0 and "Found here:\n  tox.ini: an environment" in capsys.readouterr().out
    assert main(["guide", "tune"]) == 0 and "Found" not in capsys.readouterr().out
    for shell in ("bash", "zsh", "fish"):
        assert main(["completions", shell]) == 0
        text = capsys.readouterr().out
        assert "overview" in text and "focus-from" in text and "completions" in text


def test_bands_find_pairs_at_the_threshold():
    for threshold in (0.5, 0.7, 0.85, 0.95):
        bands, rows = band_shape(threshold)
        assert bands * rows <= 128 and 1 - (1 - threshold**rows) ** bands >= 0.99
    assert band_shape(0.9)[1] > band_shape(0.5)[1]


def test_odd_sources_end_no_scan(spark, tmp_path):
    body = "    x = 1\n    y = 2\n    z = 3\n"
    tree(tmp_path, sum="def a(v):\n" + body + "    return " + "+".join(["v"] * 1500) + "\n", chain="def b(v):\n" + body + "    return v" + ".a()" * 600 + "\n", deep="def c(v):\n" + body + "    return " + "+".join(["v"] * 90_000) + "\n", good=FIRST)
    (tmp_path / "returns.py").write_bytes(b"def d(v):\r" + body.replace("\n", "\r").encode() + b"    return v\r")
    (tmp_path / "latin.py").write_bytes("# coding: latin-1\ndef e(v):\n    x = 'é'\n    y = 2\n    z = 3\n    return v\n".encode("latin-1"))
    (tmp_path / "gone.py").symlink_to(tmp_path / "nowhere.py")
    report = scan(spark, tmp_path, Config().with_settings("suggest", enabled=True))
    rows = {r.name: r for r in report.fragments.collect()}
    assert set(rows) == {"a", "b", "d", "e", "gather"}
    assert [(rows[n].start_line, rows[n].end_line, rows[n].exec_lines) for n in "de"] == [(0, 4, 5), (1, 5, 5)]
    assert rows["d"].source_text.endswith("return v") and "'é'" in rows["e"].source_text
    assert report.left_out() == 1 and {r.status for r in report.files.collect()} == {"ok", "unreadable"}


def test_one_files_failure_is_its_status(spark, monkeypatch):
    from dupeloom.sources import pyast

    files = spark.createDataFrame([("a.py", b"def f(a):\n    b = 1\n    c = 2\n    d = 3\n    return b\n", "ok"), ("b.py", None, "ok")], "file_path string, source binary, status string")
    rows = pyast.python_fragments(files, Config()).collect()
    assert {r.status for r in rows if r.file_path == "b.py"} == {"file:ok"} and [r.name for r in rows if r.name] == ["f"]
    broken = Config().with_settings("suppress", directive=None)
    object.__setattr__(broken, "normalization", None)  # whatever goes wrong inside
    assert {r.status for r in pyast.python_fragments(files.where("file_path = 'a.py'"), broken).collect()} == {"file:failed, AttributeError"}


def test_parameters_keep_their_order_and_signs():
    body = "    return [a, b, c, d]\n" + "    e = 1\n" * 5
    kinds = lambda source: [n[0] for n in packed_tree(found(source)[1][0]["tree"])[4][1][4]]
    assert kinds("def f(a, /, b, *, c, **d):\n" + body) == ["identifier", "positional_separator", "identifier", "keyword_separator", "identifier", "dictionary_splat_pattern"]
    assert kinds("def f(a, b=1, *c, d=2):\n" + body) == ["identifier", "default_parameter", "list_splat_pattern", "default_parameter"]
    one, two = (found(f"def f({p}):\n" + body)[1][0]["root_hash"] for p in ("a, b, *c, d", "p, q, *r, s"))
    assert one != two and found("def f(a, b, *c, d):\n" + body)[1][0]["root_hash"] == found("def f(p, q, *r, s):\n" + body.replace("a, b, c, d", "p, q, r, s"))[1][0]["root_hash"]
    assert found("def f(a, b, c, d):\n" + body)[1][0]["root_hash"] != found("def f(a, b, /, c, d):\n" + body)[1][0]["root_hash"]


def test_suppressed_files_are_not_read(spark, tmp_path):
    root = tree(tmp_path, a=FIRST, gen__b=RENAMED)
    (root / "gen" / "c.py").symlink_to(root / "nowhere.py")
    report = scan(spark, root, Config().with_settings("suppress", files=("gen/**",)))
    assert report.suppressed()["config_files"] == 2 and report.left_out() == 0 and report.fragments.count() == 1


def test_ranks_follow_the_order(spark):
    from dupeloom.operators.pairs import with_rank

    rows = [(i * 7919 % 1000, i) for i in range(1000)]
    got = with_rank(spark.createDataFrame(rows, "a int, b int").repartition(7), "a", "b").collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r["rank"])] == sorted(rows) and sorted(r["rank"] for r in got) == list(range(1, 1001))


@pytest.mark.parametrize("tier", ["exact", "renamed", "restructured", "augmented"])
def test_mutated_functions_parse_and_differ_as_they_should(tier):
    from dupeloom.operators.inject import mutated

    source = FIRST.lstrip().replace('"', "'")  # as Python itself writes texts
    text = mutated(source, tier, 7)
    one, two = (found(s)[1][0] for s in (source, text))
    shared = len(set(one["shingles"]) & set(two["shingles"]))
    alike = shared / len(set(one["shingles"]) | set(two["shingles"]))
    assert (text == source) == (tier == "exact") and (one["root_hash"] == two["root_hash"]) == (tier in ("exact", "renamed"))
    assert alike == 1 if tier in ("exact", "renamed") else 0 < alike < 1


def test_injected_duplicates_are_found(spark):
    from dupeloom.operators.inject import inject, recall_of_injected

    text = lambda i: f"import x{i}\n\n\ndef own_{i}(rows, limit):\n" + "".join(f"    a_{j} = call_{i}_{j}(rows, {i * 31 + j}, limit)\n    if a_{j} > {j} + limit:\n        log_{i}(a_{j}, rows[{j}])\n" for j in range(6)) + "    return limit\n"
    files = spark.createDataFrame([(f"src/f{i:02}.py", text(i).encode(), "ok") for i in range(24)], "file_path string, source binary, status string")
    longer, manifest = inject(files, 2)
    rows = manifest.collect()
    assert sorted(r.tier for r in rows) == sorted(["exact", "renamed", "restructured", "augmented", "semantic"] * 2)
    sources = {r.file_path: bytes(r.source).decode().split("\n") for r in longer.collect()}
    assert len(sources) == 24
    for r in rows:
        assert sources[r.target_file][r.target_start].startswith("def ") and sources[r.source_file][r.source_start].startswith("def ")
        assert sources[r.target_file][r.target_end].strip() and sources[r.target_file][r.target_end + 1 :] == [""]
    quality = {r.tier: r for r in recall_of_injected(files, Config().with_settings("scan", threshold=0.5), 2).collect()}
    assert quality["exact"].recall == quality["renamed"].recall == 1 and quality["total"].fp == 0
    assert sorted(map(tuple, inject(files, 2)[1].collect())) == sorted(map(tuple, rows))
