"""Command line: init, schema, check, plan, generate, status, run, dry-run, adopt, rollback.

Exit codes: 0 fine, 1 usage or broken files, 2 refused.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
import uuid
from pathlib import Path

from morphlake.functions.numbers import join_versions, percent_of, version_stem
from morphlake.plans.compile import compile_step, draft
from morphlake.plans.diff import DENIED, INFO, TAGS, WARNING, diff, key_space_diff
from morphlake.plans.model import ShapeError
from morphlake.sources import declare
from morphlake.sources.control import MigrationError
from morphlake.sources.project import KEY_SPACE, Project, scaffold


class Refused(Exception):
    pass


def _declared(project: Project, args) -> list:
    """Shapes of the declaring module and of the project's source folders."""
    if args.declared:
        importlib.import_module(args.declared)
    for folder in project.config.sources:
        declare.load_sources(project.root / folder)
    return list(declare.REGISTRY)


def _pairs(project: Project, args):
    shapes = project.shapes()
    for name in [args.schema] if args.schema else shapes.names():
        for a, b in shapes.pairs(name):
            if (args.from_version is None or a.version == args.from_version) and (args.to_version is None or b.version == args.to_version):
                yield name, a, b


def _key_space_drift(project: Project, watched: bool) -> list[dict]:
    """The declared key space against the committed one. Absence on either side is refused: without
    a baseline, or without a declaration, no change would ever be seen."""
    row = lambda severity, detail, name="(key space)": {"shape": name, "version": 0, "severity": TAGS[severity], "detail": detail}
    try:
        declared = declare.declared_key_space()
        committed = project.key_space()
    except (ShapeError, ValueError, KeyError) as e:
        return [row(DENIED, f"the key space can't be read, so no change to it was checked: {e}")]
    if declared is None:
        return [row(DENIED, f"{KEY_SPACE} is committed, and no key space is declared")] if committed and watched else []
    name = f"{declared.name} (key space)"
    if committed is None:
        return [row(DENIED, f"no {KEY_SPACE} is committed: export it to record a baseline", name)]
    out = [row(INFO, f"the committed one is named {committed.name}; only variants are encoded", name)] if committed.name != declared.name else []
    return out + [row(f.severity, f"{f.field} {f.kind}".strip() + (f": {f.old} -> {f.new}" if f.old or f.new else ""), name) for f in key_space_diff(committed, declared, project.config.crates)]


def check(project: Project, args) -> dict:
    """Drift and findings of all pairs; fails at the threshold if anything reaches it."""
    shapes, watched = project.shapes(), bool(args.declared or project.config.sources)
    drift = [{"shape": n, "version": v, "severity": TAGS[DENIED], "detail": state} for n, v, state in (project.drift(_declared(project, args)) if watched else []) if state in ("changed", "missing")]
    drift += _key_space_drift(project, watched)
    stems: dict[str, list[str]] = {}
    for name in shapes.names():
        if stem := version_stem(name):
            stems.setdefault(stem, []).append(name)
    drift += [{"shape": ", ".join(m), "version": 0, "severity": TAGS[DENIED], "detail": f"versions of one shape {stem}, declared as shapes of their own: no pair of them is ever checked"} for stem, m in stems.items() if len(m) > 1]
    migrations = []
    for name, a, b in _pairs(project, args):
        row = {"name": name, "from": a.version, "to": b.version}
        if b.version != a.version + 1:
            migrations.append(row | {"verdict": "Denied", "findings": [{"field": "", "kind": "SkipsVersions", "severity": TAGS[DENIED]}], "notes": []})
            continue
        d = diff(a, b, project.plan(name, a.version, b.version), project.config.crates)
        path, notes = project.transform_path(name, a.version, b.version), []
        if d.severity < DENIED:
            there = path.exists()
            notes.append({"severity": TAGS[INFO if there else WARNING], "detail": f"{'transform at' if there else 'no transform at'} {project.relative(path)}"})
        migrations.append(row | {"verdict": d.verdict, "findings": [{"field": f.field, "kind": f.kind, "severity": TAGS[f.severity]} for f in d.findings], "notes": notes})
    levels = [TAGS.index(x["severity"]) for x in (*drift, *(y for m in migrations for y in (*m["findings"], *m["notes"])))]
    denied, broken = sum(m["verdict"] == "Denied" for m in migrations), sum(x["severity"] == TAGS[DENIED] for x in drift)
    return {
        "drift": drift, "migrations": migrations, "verdict": TAGS[max(levels, default=INFO)],
        "summary": {"pairs": len(migrations), "denied": denied, "broken": broken}, "failed": sum(x >= TAGS.index(args.fail_on) for x in levels),
    }


def check_text(report: dict) -> str:
    lines = [f"[{x['severity']}] {x['shape']}" + (f" v{x['version']}" if x["version"] else "") + f": {x['detail']}" for x in report["drift"]]
    for m in report["migrations"]:
        lines.append(f"{m['name']} v{m['from']} -> v{m['to']}: {m['verdict']}")
        lines += [f"  [{f['severity']}] {f['field'] or '(shape)'}: {f['kind']}" for f in m["findings"]] + [f"  [{n['severity']}] {n['detail']}" for n in m["notes"]]
    n = report["summary"]
    lines.append(f"{n['pairs']} version pair{'' if n['pairs'] == 1 else 's'}, {n['denied']} denied, {n['broken']} broken snapshot{'' if n['broken'] == 1 else 's'}; verdict: {report['verdict']}")
    return "\n".join(lines)


def _schema(project: Project, args) -> int:
    """export (or with --check, what an export would change), list and show."""
    shapes = project.shapes()
    if args.action == "show":
        name = args.schema or (shapes.names()[0] if len(shapes.names()) == 1 else None)
        found = name and (shapes.get(name, args.version) if args.version else shapes.latest(name))
        if not found:
            raise ShapeError(f"no committed shape {name or '(name one)'}" + (f" v{args.version}: {join_versions(shapes.versions(name))}" if name and args.version else ""))
        print(found.to_json() if args.json else found.summary() + (f"note: {found.note}\n" if found.note else ""), end="")
        return 0
    if args.action == "list":
        rows = []
        for name in [args.schema] if args.schema else shapes.names():
            if not shapes.versions(name):
                raise ShapeError(f"no committed shape {name}")
            exists = lambda path: path.exists()
            rows.append({
                "name": name, "versions": shapes.versions(name), "gaps": shapes.gaps(name),
                "pairs": [{"from": a.version, "to": b.version, "plan": exists(project.plan_path(name, a.version, b.version)), "transform": exists(project.transform_path(name, a.version, b.version))} for a, b in shapes.pairs(name)],
            })
        if args.json:
            print(json.dumps(rows, indent=2))
            return 0
        for r in rows:
            print(f"{r['name']}: {join_versions(r['versions'])}")
            for x in r["pairs"]:
                print(f"  v{x['from']} -> v{x['to']}: {'plan' if x['plan'] else 'no plan'}, {'transform' if x['transform'] else 'no transform'}")
            for a, b in r["gaps"]:
                print(f"  v{a} -> v{b}: skips versions")
        return 0
    declared = _declared(project, args)
    drift = project.drift(declared)
    space = declare.declared_key_space()
    if args.check:
        bad = [f"{n} v{v}: {state}" for n, v, state in drift if state in ("changed", "missing")]
        if space and project.key_space() != space:
            bad.append(f"{KEY_SPACE}: {'missing' if project.key_space() is None else 'changed'}")
        print("\n".join(bad) or "up to date")
        return 2 if bad else 0
    for s in declared:
        print(f"{s.name} v{s.version}: {project.write_shape(s, args.force)}")
    if space:
        print(f"{KEY_SPACE}: {project.write_key_space(space)}")
    for n, v, state in drift:
        if state == "undeclared":
            print(f"{n} v{v} is committed and not declared; it is kept, so that the step into it stays checkable")
    for name in project.shapes().names():
        print(f"{name}: {join_versions(project.shapes().versions(name))}")
    return 0


def _diff(project: Project, args):
    """The declared step between two versions, if it may be taken."""
    shapes = project.shapes()
    a, b = shapes.get(args.schema, args.from_version), shapes.get(args.schema, args.to_version)
    if a is None or b is None:
        raise ShapeError(f"{args.schema}: v{args.from_version} or v{args.to_version} is not recorded")
    plan = project.plan(args.schema, a.version, b.version)
    bare = diff(a, b, crates=project.config.crates)
    if plan is None and bare.undeclared():
        raise Refused("a plan is needed:\n" + bare.report())
    if plan and plan.unfilled():
        raise Refused(f"the plan has placeholders for {', '.join(plan.unfilled())}")
    d = diff(a, b, plan, project.config.crates)
    if d.verdict == "Denied":
        raise Refused(d.report())
    return d


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("morphlake")
    p.add_argument("--project", default=".")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("init", "schema", "check", "plan", "generate", "status", "run", "dry-run", "adopt", "rollback"):
        s = sub.add_parser(name)
        if name == "schema":
            s.add_argument("action", nargs="?", choices=("export", "list", "show"), default="export")
        s.add_argument("--schema")
        s.add_argument("--from", dest="from_version", type=int)
        s.add_argument("--to", dest="to_version", type=int)
        s.add_argument("--declared", help="module whose import declares shapes")
        s.add_argument("--store")
        s.add_argument("--batch", type=int)
        s.add_argument("--max", type=int, default=1000 if name == "dry-run" else 50)
        s.add_argument("--fail-on", choices=TAGS, default="deny")
        s.add_argument("--json", action="store_true")
        s.add_argument("--force", action="store_true")
        s.add_argument("--check", action="store_true")
        s.add_argument("--submit", action="store_true", help="without it, run only simulates")
        s.add_argument("--version", type=int)
        s.add_argument("--cap", action="append", default=[], metavar="RESOURCE=MOST", help="of a batch in a dry run: seconds, bytes or rows")
    args = p.parse_args(argv)
    try:
        return _dispatch(args)
    except (Refused, MigrationError) as e:
        print(e, file=sys.stderr)
        return 2
    except (ShapeError, OSError, ValueError, ImportError) as e:
        print(e, file=sys.stderr)
        return 1


def _dispatch(args) -> int:
    if args.command == "init":
        project = scaffold(Path(args.project))
        for s in _declared(project, args):
            project.write_shape(s)
        return 0
    project = Project.discover(args.project)
    if args.command == "schema":
        return _schema(project, args)
    if args.command == "check":
        report = check(project, args)
        print(json.dumps(report, indent=2) if args.json else check_text(report))
        return 2 if report["failed"] else 0
    if args.command == "plan":
        for name, a, b in _pairs(project, args):
            print(project.write_plan(name, draft(diff(a, b)), args.force))
        return 0
    if args.command == "generate":
        step = compile_step(_diff(project, args))
        path = project.transform_path(args.schema, args.from_version, args.to_version)
        if path.exists() and not args.force:
            raise ShapeError(f"{path.name} exists")
        path.write_text(step.sql())
        print(path)
        return 0
    return _on_store(project, args)


def _on_store(project: Project, args) -> int:
    from pyspark.sql import SparkSession

    from morphlake.operators.executor import Executor, assert_upgradeable, inspect
    from morphlake.operators.replay import Forked, fits, replay
    from morphlake.sources.store import Store

    if not args.store:
        raise ShapeError("--store is needed")
    store = Store(SparkSession.builder.getOrCreate(), args.store)
    batch = args.batch or project.config.batch
    if args.command == "status":
        m = store.control().migration
        left = {"progress_bp": m.progress_bp, "remaining": m.remaining, "batches_left": -(-m.remaining // batch), "status": m.status, "from": m.from_version, "to": m.to_version} if m else {}
        print(json.dumps(inspect(store) | left, indent=2))
        return 0
    if args.command == "adopt":
        store.adopt(args.version)
        return 0
    step = store.compile(_diff(project, args))
    if args.command == "rollback":
        run = Executor(store, step)
        run.begin_rollback()
        print(run.rollback_to_completion(batch, args.max)[-1])
        return 0
    assert_upgradeable(store, step.from_version, step.to_version)
    if args.command == "dry-run" or not args.submit:
        caps = {k: float(v) for k, v in (x.split("=", 1) for x in args.cap)}
        fork = f"{store.root}/forks/{uuid.uuid4().hex}"  # where the store is, so that executors see it too
        got = replay(Forked(store, lambda s: Executor(s, step), fork), batch, args.max)
        store.folder.delete(fork.removeprefix(f"{store.root}/"))
        print(f"{len(got.batches)} batches, {got.entries} entries, " + ("completed" if got.completed else got.refused or "not completed"))
        for what in ("seconds", "bytes", "rows") if got.batches else ():
            most = max(cost[what] for _, cost in got.batches)
            print(f"  {what}: {got.total(what):g} in all, {most:g} at most in a batch" + (f", {percent_of(most, caps[what])} of the cap" if what in caps else ""))
        over = [i for i, (_, cost) in enumerate(got.batches) if not fits(cost, caps)]
        if over:
            print(f"  over a cap: batches {', '.join(map(str, over))}")
        return 2 if got.refused or over else 0
    run = Executor(store, step)
    run.begin()
    for _ in range(args.max):
        outcome = run.batch_within(batch, project.config.timeout_seconds)
        print(outcome)
        if outcome.is_stall:
            raise Refused("no progress")
        if outcome.done:
            break
    return 0


if __name__ == "__main__":
    sys.exit(main())
