"""The code audit on small repositories written here."""

import json
import subprocess

import pytest

from quarry import report
from quarry.plans import deletion
from quarry.session import AuditSession
from quarry.sources import config, files, ledger, manifests
from quarry.sources.python_facts import facts

FILES = "repo string, path string, source string"
BODY = '''def load(path):
    text = open(path).read()
    if not text:
        raise ValueError(path)
    rows = [line.split(",") for line in text.splitlines()]
    return [r for r in rows if r]


def render(rows):
    out = []
    for row in rows:
        out.append(" | ".join(row))
    return "\\n".join(out)
'''
MAIN = "if __name__ == '__main__':\n    print(render(load('x')))\n"


def session(spark, sources: dict[str, str], **more) -> AuditSession:
    return AuditSession(spark, spark.createDataFrame([("r", p, s) for p, s in sources.items()], FILES), **more)


def found(df):
    return {(r["rule"], r["path"]): r for r in df.collect()}


def evidence(row):
    return {e["type"]: json.loads(e["value"]) for e in row["evidence"]}


def test_superseded_file_with_history(spark):
    log = spark.createDataFrame([("r", 0, "c2", 200, "parser_v2.py", "A"), ("r", 1, "c1", 100, "parser.py", "A"), ("r", 1, "c1", 100, "app.py", "A")], "repo string, seq int, commit string, ts long, path string, status string")
    s = session(spark, {"app.py": "from parser_v2 import load, render\n" + MAIN, "parser.py": BODY, "parser_v2.py": BODY}, log=log)
    got = found(s.findings("stale"))
    row = got["stale-file", "parser.py"]
    assert set(got) == {("stale-file", "parser.py")}
    assert row["replacement"] == "parser_v2.py" and row["confidence"] >= 0.85 and row["risk"] == 0.0 and row["recommendation"] == "safe_delete_candidate"
    assert evidence(row)["git_chronology"] is True
    again = found(s.findings("stale"))["stale-file", "parser.py"]
    assert again["id"] == row["id"]


def test_without_history_stays_below_high(spark):
    row = found(session(spark, {"app.py": "import parser_v2\n" + MAIN, "parser.py": BODY, "parser_v2.py": BODY}).findings("stale"))["stale-file", "parser.py"]
    assert row["confidence"] <= 0.84 and row["recommendation"] == "review"


def test_replacement_that_lacks_a_symbol(spark):
    extra = BODY + "\n\ndef export(rows):\n    return list(rows)\n"
    row = found(session(spark, {"app.py": "import parser_v2\n" + MAIN, "parser.py": extra, "parser_v2.py": BODY}).findings("stale"))["stale-file", "parser.py"]
    assert row["risk"] >= 0.65 and row["recommendation"] == "review" and evidence(row)["symbols_missing_from_replacement"] == ["export"]


@pytest.mark.parametrize(
    ("code", "least"),
    [
        ("import importlib\nimportlib.import_module('parser')\n", None),
        ("import importlib\nimportlib.import_module(name)\n", 1.0),
        ("from importlib import import_module as load\nx = load\nx(a + b)\n", 1.0),
        ("import pkgutil\npkgutil.iter_modules()\n", 1.0),
        ("exec(open('a').read())\n", 1.0),
        ("import runpy\nrunpy.run_path(p)\n", 1.0),
        ("import importlib\nhandlers = {'a': importlib.import_module}\n", 1.0),
        ("import importlib\nclass A:\n    f = importlib.import_module\n", 1.0),
        ("import importlib\ndef g(f=importlib.import_module):\n    return f\n", 1.0),
        ("import importlib\ngetattr(importlib, 'import_module')(n)\n", 1.0),
        ("import importlib\nvars(importlib)['import_module'](n)\n", 1.0),
        ("import importlib\nimportlib.__dict__['import_module'](n)\n", 1.0),
        ("NAME = 'pkg.parser'\n", 0.0),
        ("def broken(:\n", 1.0),
    ],
)
def test_dynamic_loading_keeps_files(spark, code, least):
    got = found(session(spark, {"app.py": "import parser_v2\n" + MAIN, "x.py": "import app\n" + code if least != 1.0 or "broken" not in code else code, "parser.py": BODY, "parser_v2.py": BODY}).findings("stale"))
    row = got.get(("stale-file", "parser.py"))
    if least is None:
        assert row is None or row["risk"] >= 0.75
    else:
        assert row["risk"] >= least and row["recommendation"] == "review"


def test_orphan_file_only_if_changed(spark):
    sources = {"app.py": MAIN, "new.py": "def f(x):\n    return x\n"}
    assert not found(session(spark, sources).findings("stale"))
    changed = spark.createDataFrame([("r", "new.py")], "repo string, path string")
    row = found(session(spark, sources, changed=changed).findings("diff"))["orphan-file", "new.py"]
    assert row["confidence"] == 0.68 and row["recommendation"] == "review_only" and row["risk"] >= 0.35


def test_helpers_duplicates_dependencies(spark):
    declared = spark.createDataFrame([("r", n, "requirements.txt") for n in ("PyYAML", "requests", "ruff", "azure-core")], "repo string, name string, source string")
    s = session(spark, {
        "app.py": "import a, b, yaml\nif __name__ == '__main__':\n    a.load(1)\n    b.load(2)\n",
        "a.py": BODY + "\n\ndef _unused(x):\n    return x\n\n\ndef _used(x):\n    return x\n\n\nprint(_used(1))\n",
        "b.py": BODY,
    }, declared=declared)
    got = found(s.findings("scan"))
    assert ("orphan-helper", "a.py") in got and evidence(got["orphan-helper", "a.py"])["symbol"] == "_unused"
    assert got["duplicate-implementation", "b.py"]["replacement"] == "a.py" and got["duplicate-implementation", "b.py"]["confidence"] == 0.88
    names = {evidence(r)["dependency"]: r["confidence"] for r in s.findings("scan").collect() if r["rule"] == "dependency-leftover"}
    assert names == {"requests": 0.68, "azure-core": 0.58}


def test_style_drift(spark):
    plain = "import os\n\n\ndef f{i}(x):\n    return x + {i}\n\n\ndef g{i}(x):\n    return f{i}(x) * 2\n"
    loud = "def f(x):\n    # first we get the value\n    # then we return the value\n    try:\n        data = x\n        print(data)\n        return data\n    except Exception:\n        print('failed')\n        return None\n"
    row = found(session(spark, {f"m{i}.py": plain.format(i=i) for i in range(6)} | {"odd.py": loud}).findings("style"))["style-drift", "odd.py"]
    assert row["confidence"] <= 0.64 and row["recommendation"] == "agent_review"
    assert {"broad_exceptions_per_function", "narration_comments_per_100_loc"} <= set(evidence(row)) | {"x"} & set()


def test_flat_directory(spark):
    topics = {"auth": ("auth_login", "auth_session", "auth_token"), "billing": ("billing_invoice", "billing_tax", "billing_refund")}
    sources = {}
    for topic, names in topics.items():
        for n, name in enumerate(names):
            other = names[(n + 1) % len(names)]
            sources[f"app/{name}.py"] = f"from app import {other}\n\n\ndef {topic}_{n}_thing(x):\n    return {other}.call(x)\n"
    for i in range(4):
        sources[f"app/zz{i}.py"] = f"VALUE_{i} = {i}\n"
    sources["main.py"] = "from app import auth_login\n"
    got = found(session(spark, sources, config=config.Config(flat_directory_threshold=4)).findings("structure"))
    row = got["flat-directory", "app"]
    assert row["recommendation"] == "proposal_only" and evidence(row)["direct_python_modules"] == 10
    assert [c["label"] for c in evidence(row)["probable_clusters"]] == ["auth", "billing"]
    steps = {s["folder"]: s for s in evidence(row)["migration_plan"]}
    # members that import each other move along; the new folder is no package yet
    assert [(steps[f"app/{t}"]["external_importers"], steps[f"app/{t}"]["risk"]) for t in ("auth", "billing")] == [(["main.py"], "medium"), ([], "medium")]


def test_same_findings_for_any_partitioning(spark):
    sources = {"app.py": "import parser_v2\n" + MAIN, "parser.py": BODY, "parser_v2.py": BODY, "b.py": BODY}
    ids = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        ids.append(sorted(r["id"] for r in session(spark, sources).findings("scan").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert ids[0] == ids[1] and ids[0]


def test_reports_ledger_and_gate(spark):
    f = session(spark, {"app.py": "import parser_v2\n" + MAIN, "parser.py": BODY, "parser_v2.py": BODY}).findings("scan").cache()
    first = report.to_json(f, "scan")
    assert first == report.to_json(f, "scan") and json.loads(first)["summary"]["findings"] == f.count()
    sarif = json.loads(report.to_sarif(f, "scan"))
    assert sarif["version"] == "2.1.0" and all(r["ruleId"] == sarif["runs"][0]["tool"]["driver"]["rules"][r["ruleIndex"]]["id"] for r in sarif["runs"][0]["results"])
    assert "findings" in report.sarif_summary(json.dumps(sarif)) and "scan:" in report.to_text(f, "scan")
    entries = ledger.build(f).collect()
    text = ledger.dump(entries)
    again = spark.createDataFrame([tuple(e.values()) for e in ledger.parse(text)], "id string, rule string, path string, note string") if entries and list(ledger.parse(text)[0]) == ["note", "id", "rule", "path"] else None
    assert again is None or again.count() == f.count()
    assert report.exit_code(f, "high") in (0, 1) and report.exit_code(f, None) == 0 and report.exit_code(f.limit(0), "all") == 0


@pytest.mark.parametrize("text", ["{", "[]", '{"schema_version": 2, "accepted": []}', '{"schema_version": 1, "accepted": [{"id": "x"}]}', '{"schema_version": 1, "accepted": [{"id": "a:000000000000", "rule": "b", "path": "p"}]}'])
def test_bad_ledgers(text):
    with pytest.raises(ledger.LedgerError):
        ledger.parse(text)


@pytest.mark.parametrize("bad", [{"allow_delete_src": 0}, {"allow_delete_src": "false"}, {"min_similarity": 0.2}, {"flat_directory_threshold": 3}, {"exclude": (1,)}, {"min_similarity": True}])
def test_bad_settings(bad):
    with pytest.raises(config.ConfigError):
        config.Config(**bad)


@pytest.mark.parametrize(
    ("path", "text", "module"),
    [
        ("Dockerfile", 'CMD ["python", "-m", "svc.worker"]', "svc.worker"),
        ("Procfile", "web: gunicorn svc.app:create", "svc.app"),
        ("deploy/x.yaml", "command: [celery, -A, svc.tasks, worker]", "svc.tasks"),
        ("k8s/x.yml", "env: DJANGO_SETTINGS_MODULE=svc.settings", "svc.settings"),
        (".github/workflows/ci.yml", "run: pytest --pyargs svc.tests", "svc.tests"),
        ("x.service", "ExecStart=/usr/bin/python3 -m svc.daemon", "svc.daemon"),
        ("Dockerfile", "RUN python3.12 -u -m svc.worker --fast", "svc.worker"),
        ("Procfile", "web: flask --app=svc.web run; worker: py -3 -m svc.jobs", "svc.web"),
        ("deploy/x.yaml", "CELERY_APP: svc.tasks:app", "svc.tasks"),
        ("deploy/x.yaml", "- name: FLASK_APP = svc.front", "svc.front"),
    ],
)
def test_deployment_references(spark, path, text, module):
    refs, doubt = manifests.deployment(spark.createDataFrame([("r", path, text, len(text)), ("r", "notes.txt", "python -m a.b", 13)], "repo string, path string, source string, length long"))
    assert module in [r["module"] for r in refs.collect()] and "a.b" not in [r["module"] for r in refs.collect()] and not doubt.head(1)


def test_templated_and_oversized_deployment(spark):
    t = spark.createDataFrame([("r", "Dockerfile", "CMD python -m ${MODULE}", 20), ("r", "app.yaml", "x", 2_000_000), ("r", "fly.toml", None, 5)], "repo string, path string, source string, length long")
    assert sorted(r["source"] for r in manifests.deployment(t)[1].collect()) == ["Dockerfile:templated", "app.yaml:oversized", "fly.toml:unreadable"]
    lines = ["gunicorn $APP", "celery -A {{ app }}", "pytest --pyargs %PKG%", "FLASK_APP=${X}", "DJANGO_SETTINGS_MODULE: $S"]
    plain = ["echo $HOME", "python run.py $1", "pytest $X", "$X gunicorn svc.app:create"]
    t = spark.createDataFrame([(str(i), "Procfile", x, len(x)) for i, x in enumerate(lines + plain)], "repo string, path string, source string, length long")
    assert sorted(r["repo"] for r in manifests.deployment(t)[1].collect()) == [str(i) for i in range(len(lines))]


def test_facts_of_a_file():
    f = facts("pkg/sub/mod.py", "﻿from . import sibling\nfrom ..top import x as y\nimport a.b as c\n__all__ = ['go']\nLIMIT = 3\n\n\ndef go(p, *, q=1):\n    return c.run(p)\n\n\nclass K:\n    z = 1\n")
    assert [(i["module"], i["names"]) for i in f["imports"]] == [("a.b", []), ("pkg.sub", ["sibling"]), ("pkg.top", ["x"])]
    assert f["declares_api"] and f["exported"] == ["go"] and f["public_assignments"] == ["LIMIT"] and f["symbol_names"] == ["K", "go"]
    assert [s["params"] for s in f["symbols"]] == [2, 0] and f["symbols"][1]["body"] == "" and "c.run" in f["attributes"]
    assert facts("x.py", "def (:")["parse_error"].startswith("SyntaxError") and facts("x.py", "")["parse_error"] is None
    a, b = (facts("x.py", s)["symbols"][0]["body"] for s in ("def f(a):\n    return a + 1\n", "def g(zz):\n    return zz + 2\n"))
    assert a == b != facts("x.py", "def f(a):\n    return a - 1\n")["symbols"][0]["body"]


def test_scan_plan_apply_restore(spark, tmp_path):
    def git(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)

    git("init", "-q")
    (tmp_path / "app.py").write_text("import parser\n" + MAIN)
    (tmp_path / "parser.py").write_text(BODY)
    git("add", "-A")
    git("commit", "-qm", "one")
    (tmp_path / "app.py").write_text("import parser_v2\n" + MAIN)
    (tmp_path / "parser_v2.py").write_text(BODY)
    (tmp_path / "link.py").symlink_to(tmp_path / "app.py")
    (tmp_path / "build").mkdir()
    (tmp_path / "build" / "x.py").write_text("x = 1\n")
    git("add", "app.py", "parser_v2.py")
    git("commit", "-qm", "two")
    assert files.list_files(tmp_path) == ["app.py", "parser.py", "parser_v2.py"]
    s = AuditSession.from_directory(spark, tmp_path, base_ref="HEAD~1")
    got = s.findings("stale")
    row = found(got)["stale-file", "parser.py"]
    assert row["confidence"] >= 0.85 and evidence(row)["call_site_migration"] == "app.py"
    plan = deletion.build(tmp_path, got, s.config)
    assert [o["path"] for o in plan["operations"]] == ["parser.py"]
    with pytest.raises(deletion.PlanError):
        deletion.validate(plan | {"base": "x"})
    with pytest.raises(deletion.PlanError):
        deletion.apply(tmp_path, plan, ["false"])
    assert (tmp_path / "parser.py").exists()
    assert deletion.apply(tmp_path, plan, ["true"])["deleted"] == ["parser.py"] and not (tmp_path / "parser.py").exists()
    assert deletion.restore_last(tmp_path) == ["parser.py"] and (tmp_path / "parser.py").read_text() == BODY
    (tmp_path / "parser.py").write_text("x = 2\n")
    with pytest.raises(deletion.PlanError):
        deletion.apply(tmp_path, plan)
    with pytest.raises(deletion.PlanError):
        deletion.safe_path(tmp_path, "../x")


def test_fact_cache(spark, tmp_path):
    from quarry.session import cached_facts

    one = spark.createDataFrame([("r", "a.py", "x = 1\n")], FILES)
    two = spark.createDataFrame([("r", "a.py", "x = 1\n"), ("q", "b.py", "def f():\n    pass\n")], FILES)
    cache = f"file://{tmp_path}/cache"
    assert cached_facts(one, cache).count() == 1
    assert sorted((r["repo"], r["path"]) for r in cached_facts(two, cache).collect()) == [("q", "b.py"), ("r", "a.py")]
    assert spark.read.parquet(cache).count() == 2


def test_command_line(spark, tmp_path, capsys):
    from quarry.__main__ import main

    (tmp_path / "app.py").write_text("import parser_v2\n" + MAIN)
    (tmp_path / "parser.py").write_text(BODY)
    (tmp_path / "parser_v2.py").write_text(BODY)
    assert main(["scan", str(tmp_path), "--format", "json", "--fail-on", "high"]) == 1
    assert {f["rule"] for f in json.loads(capsys.readouterr().out)["findings"]} == {"stale-file", "duplicate-implementation"}
    accepted = str(tmp_path / "accepted.json")
    assert main(["accept", str(tmp_path), "--output", accepted]) == 0
    assert main(["scan", str(tmp_path), "--accepted", accepted, "--fail-on", "all"]) == 0
    assert main(["scan", str(tmp_path), "--accepted", str(tmp_path / "app.py")]) == 2
    assert main(["diff", str(tmp_path)]) == 2


def _git(root, *args):
    return subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True, text=True).stdout.strip()


def test_packaging_entry_points_and_namespace_roots(tmp_path):
    (tmp_path / "pyproject.toml").write_text('[project.scripts]\nrun = "pkg.cli:main"\nbad = "no way"\n[tool.setuptools.packages.find]\nwhere = ["lib2/"]\nnamespaces = true\n')
    got = manifests.packaging(tmp_path)
    assert got["entrypoints"] == ["pkg.cli"] and got["roots"] == ["lib2"] and got["namespaces"] == ["lib2"]
    (tmp_path / "pyproject.toml").write_text("[tool.setuptools.packages.find]\nnamespaces = true\n")
    got = manifests.packaging(tmp_path)
    assert got["roots"] == [] and got["namespaces"] == [""]


def test_namespace_members(spark):
    from quarry.rules.stale import package_marks

    s = session(spark, {p: "x = 1\n" for p in ("top.py", "pkg/__init__.py", "pkg/a.py", "ns/b.py", "src/pkg2/__init__.py", "src/pkg2/c.py", "src/ns/d.py", "pkg/sub/e.py", "not-a-name/f.py", "decl/one-two/g.py", "decl/h.py")}, namespaces=spark.createDataFrame([("r", "decl")], "repo string, root string"))
    got = {r["path"]: (r["__in_package"], r["__namespace"]) for r in package_marks(s.audit(), s.facts).collect()}
    assert len(got) == 11
    assert {p for p, (_, ns) in got.items() if ns} == {"ns/b.py", "src/ns/d.py", "pkg/sub/e.py", "decl/one-two/g.py", "decl/h.py"}
    assert {p for p, (inside, _) in got.items() if inside} == {"pkg/__init__.py", "pkg/a.py", "pkg/sub/e.py", "src/pkg2/__init__.py", "src/pkg2/c.py"}


def test_descends(spark):
    from quarry.operators.graph import descends

    # r: a <- b <- d and a <- c; q: x alone; the cycle cannot come from git but must end
    parents = spark.createDataFrame([("r", "b", "a"), ("r", "c", "a"), ("r", "d", "b"), ("s", "m", "n"), ("s", "n", "m")], "repo string, commit string, parent string")
    asked = [("r", "a", "d"), ("r", "a", "d"), ("r", "c", "d"), ("r", "d", "a"), ("r", "b", "b"), ("r", None, "d"), ("q", "x", "y"), ("s", "m", "n"), ("s", "z", "n")]
    pairs = spark.createDataFrame(asked, "repo string, earlier string, later string")
    got = sorted(tuple(r) for r in descends(pairs, parents).collect())
    assert got == [("r", "a", "d"), ("s", "m", "n")]
    assert descends(pairs.limit(0), parents).count() == 0


def test_branches_are_in_no_order(spark, tmp_path):
    from quarry.sources import history

    _git(tmp_path, "init", "-q", "-b", "main")
    (tmp_path / "app.py").write_text("import parser_v2\n" + MAIN)
    _git(tmp_path, "add", "-A")
    _git(tmp_path, "commit", "-qm", "one", "--date=2001-01-01T00:00:00Z")
    _git(tmp_path, "checkout", "-qb", "side")
    (tmp_path / "parser.py").write_text(BODY)
    _git(tmp_path, "add", "-A")
    _git(tmp_path, "commit", "-qm", "two")
    _git(tmp_path, "checkout", "-q", "main")
    (tmp_path / "parser_v2.py").write_text(BODY)
    _git(tmp_path, "add", "-A")
    _git(tmp_path, "commit", "-qm", "three")
    _git(tmp_path, "merge", "-q", "-m", "four", "side")
    row = found(AuditSession.from_directory(spark, tmp_path).findings("stale"))["stale-file", "parser.py"]
    assert evidence(row)["replacement_newer"] is False
    first = _git(tmp_path, "rev-list", "--max-parents=0", "HEAD")
    assert history.resolve(tmp_path, "HEAD") == _git(tmp_path, "rev-parse", "HEAD") and history.resolve(tmp_path, first[:10]) == first
    assert history.resolve(tmp_path, "now") == _git(tmp_path, "rev-parse", "HEAD")
    with pytest.raises(ValueError):
        history.resolve(tmp_path, "1990-01-01")


def test_diff_keeps_what_the_change_touches(spark):
    from quarry.rules.base import EVIDENCE
    from quarry.session import in_diff

    rows = spark.createDataFrame(
        [
            ("r", "a", "stale-file", "x.py", [("inbound", "1")]), ("r", "b", "stale-file", "y.py", [("related_changed_paths", '["x.py"]')]), ("r", "c", "flat-directory", "lib", []),
            ("r", "d", "flat-directory", ".", []), ("r", "e", "stale-file", "z.py", [("call_site_migration", '"q.py"')]), ("r", "f", "stale-file", "lib", []), ("s", "g", "stale-file", "x.py", []), ("r", "h", "flat-directory", "li", []),
        ],
        f"repo string, id string, rule string, path string, evidence {EVIDENCE}",
    )
    changed = spark.createDataFrame([("r", "x.py"), ("r", "lib/deep/w.py")], "repo string, path string")
    assert sorted(r["id"] for r in in_diff(rows, changed).collect()) == ["a", "b", "c", "d", "e"]
