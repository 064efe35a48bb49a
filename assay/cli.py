"""Command line: ingest raw files, check plans, run controls.

    python -m assay.cli ingest  --control control.yaml --out work [--dataset ID] [--force] [--dry-run]
    python -m assay.cli build   --control control.yaml --out work [--provider module:function] [--force plans|compile|all]
    python -m assay.cli execute --control control.yaml --out work [--group ID] [--as-of 2026-01-31]
    python -m assay.cli run     --control control.yaml --out work

``--control`` is a control file, the id of one in the settings' folder of controls, or left out for all of these. ``build``
writes a manifest of the plans' hashes; ``execute`` warns of plans that were edited since. With ``--dry-run`` nothing is
read but plans and schemas, and nothing is written.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import logging
import os
import sys
from importlib import import_module
from pathlib import Path

from assay.operators import Context
from assay.pipeline import run_control, write_run
from assay.plans.generate import Provider, stored_or_generated
from assay.plans.model import Control, Group, PlanError
from assay.plans.planner import build as build_plan
from assay.plans.validate import validate
from assay.results import dumps
from assay.session import create_session
from assay.settings import Settings, load_settings
from assay.sources.reader import sample_rows
from assay.sources.store import ingest, load, load_control, load_schema, save

log = logging.getLogger("assay")


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        line = {"time": self.formatTime(record), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        if record.exc_info:
            line["exception"] = self.formatException(record.exc_info)
        return json.dumps(line)


def _logging(level: str, as_json: bool) -> None:
    handler = logging.StreamHandler()
    handler.setFormatter(JsonLines() if as_json else logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
    logging.basicConfig(level=level, handlers=[handler], force=True)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="assay")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("ingest", "build", "execute", "run"):
        s = sub.add_parser(name)
        s.add_argument("--control", help="control file or id; plans are in a folder 'plans' beside it")
        s.add_argument("--settings", help="settings file")
        s.add_argument("--out", "--output-dir", help="folder for datasets, schemas and results")
        s.add_argument("--force", nargs="?", const="all", choices=["plans", "compile", "all"], help="make again what is there: plans, compiled plans, or all, datasets too")
        s.add_argument("--dry-run", action="store_true", help="say what would be done")
        s.add_argument("--dataset", help="only this dataset")
        s.add_argument("--group", help="only this group")
        s.add_argument("--provider", help="module:function that writes plans where there are none")
        s.add_argument("--skip-llm", action="store_true", help="only plans that are there")
        s.add_argument("--instruction", default="", help="what plans are to check, for the provider")
        s.add_argument("--as-of", type=dt.date.fromisoformat, help="the day that counts as today")
        s.add_argument("--log-level")
        s.add_argument("--log-json", action="store_true")
    return p


def provider_named(name: str) -> Provider:
    """The function called ``module:function``."""
    module, _, function = name.partition(":")
    try:
        found = getattr(import_module(module), function)
    except (ImportError, AttributeError, ValueError) as e:
        raise PlanError(f"no provider {name!r}: {e}") from e
    if not callable(found):
        raise PlanError(f"provider {name!r} can't be called")
    return found


def control_files(named: str | None, settings: Settings) -> list[Path]:
    """The control file that is named, or all controls of the settings' folder."""
    folder = Path(settings.controls)
    if named is None:
        found = sorted(folder.glob("*/control.yaml"))
        if not found:
            raise FileNotFoundError(f"no controls in {folder}")
        return found
    for path in (Path(named), folder / named / "control.yaml"):
        if path.is_file():
            return [path]
    raise FileNotFoundError(f"no control {named}")


class Work:
    """One control's command: its files and what is made of them."""

    def __init__(self, args: argparse.Namespace, settings: Settings, control_path: Path, out: Path, spark):
        self.args, self.settings, self.path, self.out, self._spark = args, settings, control_path, out, spark
        self.control: Control = load_control(control_path)
        self.failed: dict[str, str] = {}

    @property
    def spark(self):
        if self._spark is None:
            self._spark = create_session(master=self.settings.master or None, conf=dict(self.settings.spark))
        return self._spark

    def schema_file(self, dataset: str) -> Path:
        return self.out / "schemas" / f"{dataset}.schema.yaml"

    def datasets(self, force: bool) -> dict:
        """The control's datasets; one that can't be read is logged, and missing for the groups that need it."""
        found = {}
        for d in self.control.datasets:
            if self.args.dataset and d.dataset_id != self.args.dataset:
                continue
            raw = d.path if os.path.isabs(d.path) or "://" in d.path else str(self.path.parent / d.path)
            try:
                found[d.dataset_id] = ingest(self.spark, raw, str(self.out / "datasets" / d.dataset_id), self.schema_file(d.dataset_id), d.dataset_id, d.sheet, d.required_columns, force, tuple(self.settings.null_tokens))
            except Exception as e:  # noqa: BLE001  the groups that don't need it run
                self.failed[d.dataset_id] = f"{type(e).__name__}: {e}"
                log.error("dataset %s: %s", d.dataset_id, e)
        return found

    def schemas(self) -> dict[str, dict[str, str]]:
        """Column types of the datasets that have been ingested."""
        return {d.dataset_id: {c.normalized_name: c.type for c in load_schema(self.schema_file(d.dataset_id))} for d in self.control.datasets if self.schema_file(d.dataset_id).exists()}

    def groups(self, schemas: dict, samples: dict | None = None) -> list[Group]:
        """The control's groups with valid plans, from files or else from the provider."""
        named = "" if self.args.skip_llm else self.args.provider or self.settings.provider
        force = bool(named) and self.args.force in ("plans", "all") and not self.args.dry_run
        provider = provider_named(named) if named and not self.args.dry_run else None
        known = [d.dataset_id for d in self.control.datasets]
        groups = stored_or_generated(self.path.parent / "plans", provider, self.args.instruction or self.control.description, {d: schemas.get(d, {}) for d in known}, samples, force, self.settings.retries)
        if self.args.group and self.args.group not in [g.group_id for g in groups]:
            raise PlanError(f"no group {self.args.group}")
        for g in groups:
            validate(g.plan, known, [c.check_id for c in self.control.checks])
        return groups

    @property
    def manifest(self) -> Path:
        return self.out / "build_manifest.json"

    def recorded(self) -> dict[str, str]:
        return {g["group_id"]: g["plan_hash"] for g in load(self.manifest)["groups"]} if self.manifest.exists() else {}

    def record(self, groups: list[Group], datasets: dict, schemas: dict) -> None:
        """The manifest, and each group's compiled plan; what is there stays unless forced."""
        force = self.args.force in ("compile", "all")
        known = {} if force else self.recorded()
        for g in groups:
            compiled = self.out / "compiled" / f"{g.group_id}.txt"
            if (force or not compiled.exists()) and all(d in datasets for d in g.datasets or datasets):
                frames = {d: datasets[d] for d in g.datasets or datasets}
                save(compiled, build_plan(g.plan, Context(frames, schemas, self.args.as_of, self.settings.collision_naming, frozenset(frames))).explain(), replace=force)
        kept = [{"group_id": g.group_id, "plan_hash": known.get(g.group_id, g.plan.digest), "compiled": f"compiled/{g.group_id}.txt"} for g in groups]
        save(self.manifest, {"control_id": self.control.control_id, "groups": kept})

    def run(self) -> int:
        args = self.args
        if args.command == "ingest":
            if args.dry_run:
                log.info("datasets to ingest: %s", ", ".join(d.dataset_id for d in self.control.datasets))
                return 0
            datasets = self.datasets(bool(args.force))
            log.info("datasets: %s", ", ".join(datasets))
            return 2 if self.failed else 0
        if args.dry_run:
            log.info("plans are valid: %s", ", ".join(g.group_id for g in self.groups(self.schemas())))
            return 0
        datasets = self.datasets(args.command == "run" and args.force == "all")
        schemas = self.schemas()
        groups = self.groups(schemas, {d: sample_rows(df) for d, df in datasets.items()} if args.provider or self.settings.provider else None)
        if args.command in ("build", "run"):
            self.record(groups, datasets, schemas)
        if args.command == "build":
            log.info("plans are built: %s", ", ".join(g.group_id for g in groups))
            return 0
        folder = self.out / "results"
        done = run_control(
            self.spark, self.control.control_id, groups, datasets, schemas=schemas, control=self.control, as_of=args.as_of, only=args.group, recorded=self.recorded(),
            collision_naming=self.settings.collision_naming, table=str(folder / "violations.parquet"), stripped=frozenset(datasets),
        )
        write_run(done, folder)
        print(dumps(done.report()))
        return 0 if done.status == "success" and done.overall == "PASS" else 1


def main(argv: list[str] | None = None, spark=None) -> int:
    """0: done, and a run passed; 1: a run that didn't; 2: an error of plans, files or settings. Of several controls the worst."""
    args = parser().parse_args(argv)
    try:
        settings = load_settings(args.settings)
        _logging(args.log_level or settings.log_level, args.log_json or settings.log_json)
        worst = 0
        paths = control_files(args.control, settings)
        for path in paths:
            out = Path(args.out or settings.out)
            try:
                worst = max(worst, Work(args, settings, path, out / path.parent.name if args.control is None else out, spark).run())
            except (PlanError, ValueError, FileNotFoundError, KeyError) as e:
                log.error("%s: %s", path, e, exc_info=args.log_json)
                worst = 2
        return worst
    except (PlanError, ValueError, FileNotFoundError, KeyError) as e:
        log.error("%s", e)
        return 2


if __name__ == "__main__":
    sys.exit(main())
