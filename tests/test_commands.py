"""The commands on small source trees: scan, manifest, index, documents, checks and knowledge."""

import json
import os
import time

import pytest

from fathomline import __main__ as cli
from fathomline.operators.structure import OWN
from fathomline.sources import sinks
from fathomline.plans import manifest, render


def tree(root, **files):
    for name, text in files.items():
        target = root / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    return str(root)


NODE = {"package.json": '{"name": "my-app", "version": "2.1.0", "dependencies": {"express": "1"}, "scripts": {"lint": "x", "test": "y"}}', "tsconfig.json": '{"compilerOptions": {"strict": true}}', "src/index.ts": "export function go(): void {\n}\n", "src/utils.ts": "import { go } from './index';\n", "__tests__/index.test.ts": "import { go } from '../src/index';\n", ".gitignore": ".env\nout/\n", "out/x.ts": "x"}


def test_run_writes_documents_and_remembers(spark, tmp_path, capsys):
    root, knowledge = tree(tmp_path / "app", **NODE), str(tmp_path / "knowledge")
    # A fresh collection fails no check once its documents are there.
    assert cli.main(["run", "--target", root, "--tier", "full", "--knowledge", knowledge], spark) == 0
    own = tmp_path / "app" / OWN
    told = json.loads((own / "manifest.json").read_text())
    assert told["identity"]["name"] == "my-app" and told["stack"]["language"] == "typescript" and told["commands"]["test"] == "npm run test" and told["structure"]["total_files"] == 6
    meta = json.loads((own / "index.json").read_text())["_meta"]
    assert meta["total_files"] == 3 and meta["total_symbols"] == 1 and meta["top_files"][0] == {"path": "src/index.ts", "importance": 1000}
    guide = (tmp_path / "app/GUIDE.md").read_text()
    for part in ("# GUIDE.md — my-app", "## Commands", "npm run lint", "## Architecture", "## Key Files", "`src/index.ts`", "## Key Locations", "`src/`", "`__tests__/`", "## Invariants", "INV-1", "tsconfig.json"):
        assert part in guide, part
    assert (tmp_path / "app/vault/wiki/entities/src-index-ts.md").exists() and "Dependencies" in (tmp_path / "app/vault/wiki/concepts/architecture.md").read_text()
    assert (tmp_path / "app/.githooks/pre-push").stat().st_mode & 0o100
    out = capsys.readouterr().out
    assert "0 FAIL" in out and "quality-gate" in out
    assert cli.main(["stats", "--knowledge", knowledge], spark) == 0 and "1 collections, 3 files, 1 symbols, typescript" in capsys.readouterr().out
    # A later discovery doesn't know totals and leaves them.
    cli.main(["discover", "--target", root, "--no-index", "--knowledge", knowledge], spark)
    assert sinks.read_newest(spark, knowledge).first().total_files == 3
    assert cli.main(["report", "--target", root], spark) == 0 and "my-app 2.1.0" in capsys.readouterr().out
    (tmp_path / "app/src/new.ts").write_text("import './index';\n")
    assert cli.refresh(spark, root, "lean") and json.loads((own / "index.json").read_text())["_meta"]["total_files"] > 3
    later = time.time() + 60
    os.utime(own / "manifest.json", (later, later))
    assert not cli.refresh(spark, root)


def test_dry_run_and_verify(spark, tmp_path, capsys, monkeypatch):
    root = tree(tmp_path / "x", **{"Makefile": "install:\n\tx\nlint:\n\tx\ntest:\n\tx\nbuild:\n\tx\n", "app.sh": "echo"})
    assert cli.main(["run", "--target", root, "--no-index", "--dry-run"], spark) == 0
    told = json.loads((tmp_path / "x" / OWN / "manifest.json").read_text())
    assert [told["commands"][c] for c in ("install", "lint", "test", "build")] == ["make install", "make lint", "make test", "make build"] and told["commands"]["makefile_targets"] == ["install", "lint", "test", "build"]
    assert not (tmp_path / "x/GUIDE.md").exists()
    assert cli.main(["verify", "--target", root], spark) == 1  # no guide
    assert "GUIDE.md" in capsys.readouterr().out
    monkeypatch.chdir(tmp_path / "x")
    assert cli.main([], spark) == 0 and capsys.readouterr().out.startswith("none")


@pytest.mark.parametrize(
    "files,want",
    [
        ({"requirements.txt": "fastapi\n", "pyproject.toml": '[project]\nname = "my-api"\nversion = "0.5.0"\n', "app/main.py": "", "app/routes.py": "", "tests/test_main.py": "", "Makefile": "lint:\n\tx\ntest:\n\tx\n"}, {"name": "my-api", "version": "0.5.0", "language": "python", "lint": "make lint", "test": "make test", "framework": "fastapi"}),
        ({"Cargo.toml": '[package]\nname = "my-cli"\nversion = "3.0.0"\n', "src/main.rs": "", "src/lib.rs": "", "tests/i.rs": ""}, {"name": "my-cli", "version": "3.0.0", "language": "rust", "sources": ["src"], "test": "cargo test"}),
        ({"go.mod": "module x\n", "go.sum": "", "main.go": "", "handlers/api.go": ""}, {"language": "go", "manager": "go", "archetype": "api-service"}),
        ({"README.txt": "x"}, {"name": "r", "version": "0.0.0", "language": "unknown", "framework": "none"}),
    ],
)
def test_manifests_of_kinds(spark, files, want):
    rows = manifest.manifest(spark.createDataFrame([("r", p, c) for p, c in files.items()], "repo string, path string, content string"))
    row = rows.first()
    got = {"name": row.identity.name, "version": row.identity.version, "language": row.stack.language, "framework": row.stack.framework, "manager": row.stack.package_manager, "lint": row.commands.lint, "test": row.commands.test, "sources": row.structure.source_dirs, "archetype": row.archetype.archetype}
    assert {k: got[k] for k in want} == want


def test_guides_show_what_is_there(spark):
    files = [
        ("full", "requirements.txt", "fastapi\n"), ("full", "ruff.toml", ""), ("full", "pytest.ini", ""), ("full", "app/auth/login.py", ""), ("full", "app/models/user.py", ""), ("full", "app/routes/x.py", ""), ("full", ".env.example", "DATABASE_URL=x\nPORT=1\n"),
        ("full", ".github/workflows/ci.yml", "on: push\njobs:\n  lint:\n    x: y\n  test:\n    x: y\n"), ("mono", "turbo.json", "{}"), ("mono", "tsconfig.json", "{}"), ("empty", "x", ""),
    ]
    rows = manifest.manifest(spark.createDataFrame(files, "repo string, path string, content string"))
    guides = {r.repo: r.content for r in render.documents(rows, "lean").where("path = 'GUIDE.md'").collect()}
    for part in ("INV-AUTH", "INV-DB", "INV-API", "## Environment Variables", "| DATABASE_URL | Yes |", "| PORT | No |", "## Quality Tools", "ruff", "ruff.toml", "pytest", "## CI", "github-actions", "lint, test", "typecheck, security", "Virtual environment"):
        assert part in guides["full"], part
    assert "**Monorepo**: yes (turborepo)" in guides["mono"] and "# GUIDE.md — empty" in guides["empty"] and "## Commands" in guides["empty"] and "## Invariants" in guides["empty"]
